"""Windows of so many tokens over texts, and vectors of windows pooled to documents."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tokenizer's file of public_tokenizers, and tokens of a window.
TOKENIZER, SIZE = "byte_bpe_50k.json", 512
WINDOWS = "doc long, place int, first long, last long, n_tokens int, text string"


@functools.cache
def tokenizer_of(name: str):
    """One for each worker."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


#: What texts are split by pieces: code points up to here and some punctuation; white space of other lines than ASCII's
#: and characters beyond go to the tokenizer whole. Pieces of which a worker keeps the numbers of tokens, and their length.
LATIN, PIECES_KEPT, PIECE = 0x24F, 500_000, 64
_kept: dict[str, dict[str, int]] = {}


@functools.cache
def splitter(name: str) -> tuple[re.Pattern, re.Pattern, list[str]] | None:
    """Of a tokenizer that splits as byte-level BPE does: what its pieces look like in the texts that are split here, what
    such texts are, and strings that are tokens of their own. None for other tokenizers."""
    about = json.loads(tokenizer_of(name).to_str())
    before = about["pre_tokenizer"] or {}
    if about["normalizer"] or about["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
        return None
    of = lambda kind: "".join(chr(c) for c in range(0x80, LATIN + 1) if unicodedata.category(chr(c))[0] == kind)
    letter, number, white = "A-Za-z" + of("L"), "0-9" + of("N"), "\t-\r "
    pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{white}{letter}{number}]+|[{white}]+(?![^{white}])|[{white}]+")
    return pieces, re.compile(f"[\0-\x84\x86-\x9f\xa1-{chr(LATIN)}\u2010-\u2027\u2030-\u205e]*"), [t["content"] for t in about["added_tokens"]]


def windows_of(text: str, name: str, size: int) -> list[tuple[int, int, int]]:
    """(first character, character after the last, tokens) of each window; together they are the text. A character of
    several tokens that a window's end would part belongs to the later window.

    Texts of ASCII and Latin characters are split here, and the tokenizer sees each distinct piece once."""
    ways, own = splitter(name), tokenizer_of(name)
    if not ways or not ways[1].fullmatch(text) or any(t in text for t in ways[2]):
        offsets = own.encode(text, add_special_tokens=False).offsets
        n, starts = len(offsets), [0, *(offsets[k][0] for k in range(size, len(offsets), size))]
    else:
        kept = _kept.setdefault(name, {})
        if len(kept) > PIECES_KEPT:
            kept.clear()
        pieces = ways[0].findall(text)
        tokens = lambda p: len(own.encode(p, add_special_tokens=False).ids)
        more = {p: tokens(p) for p in set(pieces).difference(kept)}
        kept.update((p, k) for p, k in more.items() if len(p) <= PIECE)
        counts = [kept[p] if p in kept else more[p] for p in pieces]
        ends, at = np.cumsum(counts, dtype=np.int64), np.cumsum([0, *map(len, pieces)])
        n, starts = int(ends[-1]) if len(ends) else 0, [0]
        for k in range(size, n, size):
            i = int(np.searchsorted(ends, k, "right"))
            within = k - int(ends[i]) + counts[i]
            starts.append(int(at[i]) + (own.encode(pieces[i], add_special_tokens=False).offsets[within][0] if within else 0))
    stops = [*starts[1:], len(text)]
    return [(a, b, min(size, n - k * size)) for k, (a, b) in enumerate(zip(starts, stops, strict=True))]


def token_windows(docs: DataFrame, doc: str, text: str, size: int = SIZE, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc, place, first, last, n_tokens, text): each text in windows of size tokens, the last one maybe shorter. Null and
    empty texts have one empty window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, whole in zip(batch.column(0).to_pylist(), pc.fill_null(batch.column(1).cast(pa.large_string()), "").to_pylist(), strict=True):
                found = windows_of(whole, tokenizer, size)
                first, last, n = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(n, pa.int32()), pa.array([whole[a:b] for a, b, _ in found])], [x.split()[0] for x in WINDOWS.split(", ")])

    return docs.select(F.col(doc).cast("long"), text).mapInArrow(run, WINDOWS)


def pooled_by_weight(df: DataFrame, key: str, vector: str, weight: str) -> DataFrame:
    """(key, mean, max): the mean by weight (tokens of a window, say) and the largest value of each dimension over a key's
    vectors. Sums are folded by dimension before they are shuffled; rows without a weight over 0 do not count."""
    each = df.where(F.col(weight) > 0).select(key, F.col(weight).cast("double").alias("w"), F.posexplode(vector).alias("i", "x"))
    sums = each.groupBy(key, "i").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("mean"), F.max("x").alias("max"))
    of = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("i", c))), lambda s: s[c]).alias(c)
    return sums.groupBy(key).agg(of("mean"), of("max"))
