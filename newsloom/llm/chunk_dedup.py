"""Substring dedup by content-defined chunks.

A gear hash rolls over a text's bytes. Each word start has the hash of the few bytes before it, and a chunk ends where
this hash is the smallest of some window of SPREAD words around it. So boundaries depend on nearby text alone: an
insertion moves none but those beside it. A chunk is known by the digest of its words and MARGIN words on either side.
Chunks are deduplicated by digest: the first document of each is found by a pre-aggregated minimum, and a document loses
each stretch of at least min_words words that chunks of earlier documents, margins included, cover together.

What is found: every stretch of FOUND words that two texts share holds whole chunks of both, whatever its words, and
these cover at least min_words of it; up to MARGIN words at either end may stay. What is not: a chunk and its margins
are fewer than min_words words, so no stretch goes by one digest; it takes two, 128 bits, at least.

Words are apart by ASCII white space; Chinese and Japanese characters are words of their own, and unbroken runs of over
LONG bytes (encoded data, scripts without spaces) are cut into words where the gear hash says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import carried, cut, restored, row_key

#: Words of the shortest stretch that is taken out, of a boundary's window, and of a chunk's margin; words from which on
#: every stretch is found.
MIN_WORDS, SPREAD, MARGIN, FOUND = 30, 9, 10, 51
#: Bytes that a gear hash looks back over; bytes of the longest unbroken word.
GEAR_BYTES, LONG = 8, 48
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(2024)
#: The gear table and the values of bytes within a word's hash; a space has none.
GEAR, BYTE = (_RNG.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
BYTE[32] = 0
#: Odd bases: of bytes within a word, and twice of words within a stretch.
BASES = [int(x) | 1 for x in _RNG.integers(1 << 62, size=3)]
INVERSE = {b: pow(b, -1, 1 << 64) for b in BASES}
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    if len(_POWERS.get(base, ())) < n:
        steps = np.full(max(1 << 12, 2 * n), base, dtype=np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * GOLDEN
    return (x ^ (x >> np.uint64(32))) * GOLDEN


def stretches(values: np.ndarray, base: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The hash of each stretch values[start:stop], wherever it stands."""
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * powers(base, len(values)), dtype=np.uint64)])
    return mixed((sums[stop] - sums[start]) * powers(INVERSE[base], len(sums))[start] + (stop - start).astype(np.uint64))


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, over the last GEAR_BYTES."""
    h, k = GEAR[data], 1
    while k < GEAR_BYTES:
        more = h.copy()
        more[k:] += h[:-k] << np.uint64(k)
        h, k = more, 2 * k
    return h


class Words:
    """The words of a text: where they start and stop in its bytes, their hashes and the gear hash before each."""

    def __init__(self, text: str):
        self.raw = text.encode("utf-8", "surrogatepass")
        data = np.frombuffer(self.raw, dtype=np.uint8)
        white = (data == 32) | ((data >= 9) & (data <= 13))
        keep = ~white
        keep[1:] |= ~white[:-1]  # one byte of each run of white space stays, as a space
        at = np.flatnonzero(keep)
        data = np.where(white[at], np.uint8(32), data[at])
        gap = data == 32
        start = ~gap
        start[1:] &= gap[:-1]
        wide = ((data >= 0xE3) & (data <= 0xE9)) | (data >= 0xF0)
        if wide.any():
            inside = wide.copy()
            inside[1:] |= wide[:-1]
            inside[2:] |= wide[:-2]
            inside[3:] |= data[:-3] >= 0xF0
            start |= wide
            start[1:] |= inside[:-1] & ~gap[1:] & ((data[1:] & 0xC0) != 0x80)
        rolled = gear(data) if len(data) else np.zeros(0, dtype=np.uint64)
        first = np.flatnonzero(start)
        stop = self._stops(first, gap)
        if (stop - first > LONG).any():
            edge = np.zeros(len(data) + 1, dtype=np.int8)
            many = stop - first > LONG
            edge[first[many]] += 1
            edge[stop[many]] -= 1
            start[1:] |= (np.cumsum(edge[:-1])[1:] > 0) & (mixed(rolled[:-1]) >> np.uint64(61) == 0) & ((data[1:] & 0xC0) != 0x80) & ~gap[1:]
            first = np.flatnonzero(start)
            stop = self._stops(first, gap)
        self.hash = stretches(BYTE[data], BASES[0], first, stop) if len(first) else np.zeros(0, dtype=np.uint64)
        self.before = mixed(rolled[np.maximum(first - 1, 0)]) if len(first) else self.hash
        self.start = at[first]

    @staticmethod
    def _stops(first: np.ndarray, gap: np.ndarray) -> np.ndarray:
        stop = np.append(first[1:], len(gap))
        return stop - gap[stop - 1] if len(first) else first

    def __len__(self) -> int:
        return len(self.start)

    def runs(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The digest of each run of words from first to before last."""
        return stretches(self.hash, BASES[1], first, last).view(np.int64)

    def without(self, spans: list[tuple[int, int]]) -> str:
        """The text without stretches of words and the white space after each."""
        kept, last = [], 0
        for a, b in spans:
            kept.append(self.raw[last : self.start[a]])
            last = self.start[b] if b < len(self) else len(self.raw)
        return (b"".join(kept) + self.raw[last:]).decode("utf-8", "surrogatepass")


def slid(values: np.ndarray, n: int, of) -> np.ndarray:
    """of over each n neighbours."""
    out = values[: len(values) - n + 1].copy()
    for k in range(1, n):
        of(out, values[k : len(values) - n + 1 + k], out=out)
    return out


def boundaries(words: Words) -> np.ndarray:
    """Words that chunks start with, and the number of words: no more than SPREAD words apart in any text."""
    n = len(words)
    inner = np.zeros(0, dtype=np.int64)
    if n >= SPREAD:
        none = np.zeros(SPREAD - 1, dtype=np.uint64)
        least = slid(words.before, SPREAD, np.minimum)
        inner = np.flatnonzero(slid(np.concatenate([none, least, none]), SPREAD, np.maximum) == words.before)
    return np.unique(np.concatenate([[0], inner, [n]]))


def chunks(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each chunk the words that its digest stands for, first and before last, and the digest."""
    edges = boundaries(words)
    first, last = np.maximum(edges[:-1] - MARGIN, 0), np.minimum(edges[1:] + MARGIN, len(words))
    return first, last, words.runs(first, last) if len(words) else np.zeros(0, dtype=np.int64)


def repeated_within(words: Words, min_words: int) -> np.ndarray:
    """Words that begin a run of min_words words that has stood in the text before, wholly before this one starts."""
    at = np.arange(max(0, len(words) - min_words + 1))
    _, first, of = np.unique(words.runs(at, at + min_words), return_index=True, return_inverse=True)
    return at[at - first[of] >= min_words]


def spans_of(words: Words, known: np.ndarray, within: bool, min_words: int) -> list[tuple[int, int]]:
    """Stretches of words that known chunks cover together, and, if within, those that came before in the text."""
    first, last, digests = chunks(words)
    hit = np.isin(digests, known)
    covered = _together(first[hit], last[hit], len(words))
    spans = [(a, b) for a, b in covered if b - a >= min_words]
    if within:
        at = repeated_within(words, min_words)
        a, b = (np.concatenate([np.array([s[k] for s in spans], dtype=np.int64), x]) for k, x in ((0, at), (1, at + min_words)))
        spans = _together(a, b, len(words))
    return spans


def _together(first: np.ndarray, last: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The words of overlapping or touching stretches, as stretches."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last, -1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(step) > 0).astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def sketch(text: Column, min_words: int) -> Column:
    """digests array<long> (of the distinct chunks) and own (whether runs of words come twice within the text)."""

    @F.pandas_udf("digests array<long>, own boolean")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found, own = [], []
            for text in part:
                words = Words(text or "")
                edges = boundaries(words)
                plain = words.runs(edges[:-1], edges[1:]) if len(words) else np.zeros(0, dtype=np.int64)
                found.append(np.unique(chunks(words)[2]))
                # A run that comes again holds a chunk that does; only then are all runs looked at.
                own.append(len(np.unique(plain)) < len(plain) and bool(len(repeated_within(words, min_words))))
            yield pd.DataFrame({"digests": pd.Series(found, dtype=object), "own": own})

    return of(text)


def rest(text: Column, known: Column, within: Column, min_words: int) -> Column:
    """text (what stays), spans (word stretches taken out) and n_removed (their words)."""

    @F.pandas_udf("text string, spans array<struct<start:int,stop:int>>, n_removed int")
    def of(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, sets, withins in parts:
            rows = []
            for text, own, inside in zip(texts, sets, withins, strict=True):
                words = Words(text or "") if own is not None else None
                spans = spans_of(words, own, inside, min_words) if words else []
                rows.append((words.without(spans) if spans else text, spans))
            yield pd.DataFrame({"text": [r[0] for r in rows], "spans": pd.Series([[{"start": a, "stop": b} for a, b in r[1]] for r in rows], dtype=object), "n_removed": [sum(b - a for a, b in r[1]) for r in rows]})

    return of(text, known, within)


def order(docs: DataFrame) -> Column:
    """The place of a document among others: its doc_id; rows without one come after all ids below 2 ** 62, each text
    as a document of its own."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(row_key(F.col("text")), 2))


def marks(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text, ...) -> doc, known (digests of chunks that an earlier document has) and own (runs of words come
    twice within a text of this document), for documents with either."""
    held = cut(docs.where(F.length("text") > 0).select(order(docs).alias("doc"), sketch(F.col("text"), min_words).alias("s")).select("doc", "s.digests", "s.own"))
    each = held.select("doc", F.explode("digests").alias("digest"))
    # Checkpointed, so that the join has two shuffles of its own and Spark splits a hot chunk.
    first = cut(each.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("digest", "first"))
    known = each.join(first, "digest").where("first < doc").groupBy("doc").agg(F.collect_set("digest").alias("known"))
    known = known.select("doc", "known", F.lit(False).alias("own"))
    own = held.where("own").select("doc", F.array().cast("array<long>").alias("known"), F.lit(True).alias("own"))
    return known.unionByName(own).groupBy("doc").agg(F.flatten(F.collect_list("known")).alias("known"), F.max("own").alias("own"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Each row of docs as a struct column row, and repeated: text (what stays), spans (word stretches taken out, start
    and stop) and n_removed (their words).

    A stretch stays in the document with the smallest doc_id that has it; rows without an id come after all others, each
    text as one document. Texts that share an id are one document, and are not compared with each other. Within a text
    the first of stretches that come again stays, and those that come after it go to the word. Repeated rows stay. A
    document may lose its whole text. A null text stays null, an empty one empty; texts of any length are read whole. An
    empty table gives an empty one. Columns may have any names.
    """
    rows = carried(docs, order(docs).alias("doc"))
    met = rows.join(marks(docs, min_words), "doc", "left")
    # Only texts with something repeated go to Python.
    text = F.col("row.text")
    some = F.col("known").isNotNull() & text.isNotNull()
    met = met.withColumn("found", rest(F.when(some, text), F.when(some, F.col("known")), F.coalesce("own", F.lit(False)), min_words))
    none = F.struct(text.alias("text"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"), F.lit(0).alias("n_removed"))
    return met.select("row", F.when(some, F.col("found")).otherwise(none).alias("repeated"))


def apply(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with their texts (and n_chars, where texts change) after dedup()."""
    changed = {"text": F.col("repeated.text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("repeated.n_removed") > 0, F.char_length("repeated.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return restored(dedup(docs, min_words), docs.columns, **changed)


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text (what stays), n_spans, n_removed (words), spans ("start-stop", comma-joined) for every row."""
    spans = F.array_join(F.transform("repeated.spans", lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")
    return dedup(docs.select("doc_id", "text"), min_words).select("row.doc_id", "repeated.text", F.size("repeated.spans").alias("n_spans"), "repeated.n_removed", spans.alias("spans"))
