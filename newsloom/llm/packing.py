"""Best-fit packing of token sequences by a configuration linear program.

Documents are tokenized where they are; the driver only sees the histogram of piece lengths, which has at most
max_len rows. Over it the configuration program (as few sequences as cover every length's demand) is solved by
multiplicative weights: a length that is behind gains weight, a knapsack by dynamic programming prices the best
configuration at these weights, and that configuration is used for a share of the scarcest demand. The fractional
solution is rounded, what is left is solved again, and what rounding leaves goes into the open room of sequences by
best fit, length by length: pieces of one length and sequences with equal room are handled as runs, so the driver's
work depends on max_len, not on the number of pieces. This is tried after each solution, until the plan needs as few
sequences as the tokens do or solutions place nothing more. The plan with the fewest sequences is taken; best fit alone
only where it needs fewer than every solution, so no plan is worse than it.
A plan is a table of runs (length, first rank, ...). Pieces get a rank within their length from counts per partition,
and the plan turns it into a sequence and a place.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import cut

MAX_LEN, END_ID, TOKENIZER = 4096, 1, "word_bpe_49k.json"
#: Share of the scarcest demand used at once; weight of being behind.
SHARE, URGE = 0.2, 3.0
#: Programs: tokens of a unit of length, priced configurations for each solution, solutions at most. A unit of one token
#: fills sequences to the last one; a coarse one tells fewer lengths apart, so more of them are covered.
PROGRAMS = [(1, 100, 4), (4, 300, 12)]
#: The share of what is left that a solution has to place for another one.
PROGRESS = 0.02
#: Words whose ids a worker remembers.
REMEMBERED = 600_000
#: Texts that are encoded together: rows and bytes at most, but for a single longer one.
STEP_ROWS, STEP_BYTES = 6000, 8_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# Letters that lower-case and normalise one by one, and the vocabulary's splitting into words over them.
LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f"
PLAIN = re.compile(f"[ \\t\\n\\r!-~{LETTERS}]*")
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^ \\t\\n\\r{LETTERS}0-9]+")


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte: printable ones for themselves, the
    others from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder(dict):
    """Ids of whole texts, as little-endian unsigned 32-bit bytes: word -> its ids, remembered up to REMEMBERED words.

    Words of this vocabulary are apart. Texts of ASCII and Latin letters are split here and only their new words go to
    the vocabulary's model; any other text goes to the tokenizer whole. Both give the tokenizer's ids.
    """

    def __init__(self, tokenizer: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        self.plain = tokenizer == TOKENIZER
        self.model, self.letters = self.own.model, byte_letters()

    def __missing__(self, word: str) -> bytes:
        text = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        ids = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        if len(self) < REMEMBERED:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.plain and "<|" not in text and PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, WORDS.findall(text.lower())))
        return array("I", self.own.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's ids end. Each distinct word of the batch, as it
        stands between white space, is looked up once."""
        each = texts.to_pylist()
        apart = [not (self.plain and "<|" not in t and PLAIN.fullmatch(t)) for t in each]
        lists = pc.ascii_split_whitespace(pc.if_else(pa.array(apart), "", texts))
        words = lists.values.dictionary_encode() if len(lists.values) else pa.array([""]).dictionary_encode().slice(0, 0)
        got = [b"".join(map(self.__getitem__, WORDS.findall(w.lower()))) for w in words.dictionary.to_pylist()]
        more = {k: self.encode(t) for k, t in enumerate(each) if apart[k]}
        ids = np.frombuffer(b"".join([*got, *more.values()]), dtype="<u4")
        sizes = np.array([len(x) // 4 for x in got], dtype=np.int32)
        where = words.indices.to_numpy(zero_copy_only=False)
        size, start = (sizes[where], (np.cumsum(sizes, dtype=np.int32) - sizes)[where]) if len(where) else (np.zeros(0, dtype=np.int32),) * 2
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = ids[np.repeat((start - ends[:-1]).astype(np.int32), size) + np.arange(ends[-1], dtype=np.int32)]
        ends = ends[lists.offsets.to_numpy()[1:]] if len(lists) else np.zeros(0, dtype=np.int64)
        if more:  # put in what the tokenizer itself has made
            starts, at, parts, last = np.concatenate([[0], ends[:-1]]), int(sizes.sum()), [], 0
            grown = np.zeros(len(each), dtype=np.int64)
            for k, own in more.items():
                parts += [flat[last : starts[k]], ids[at : at + len(own) // 4]]
                last, at, grown[k] = starts[k], at + len(own) // 4, len(own) // 4
            flat, ends = np.concatenate([*parts, flat[last:]]), ends + np.cumsum(grown)
        return flat, ends


def pieces_of(docs: DataFrame, tokenizer: str = TOKENIZER, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32. A null text has the end id only."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()).cast(pa.string()), "")
            at = 0
            while at < len(texts):  # as many texts as make some MB
                n = max(1, int(np.searchsorted(np.cumsum(pc.binary_length(texts.slice(at, STEP_ROWS)).to_numpy()), STEP_BYTES)))
                ids, ends = encoder.encode_all(pa.array(texts.slice(at, n).to_pylist(), pa.string()))
                docs_of, rows, lo = batch.column(0).slice(at, n), [], 0
                for k, hi in enumerate(ends.tolist()):
                    own = ids[lo:hi].tobytes() + end
                    rows += [(k, j, c // 4, min(len(own) - c, 4 * max_len) // 4, zlib.crc32(own[c : c + 4 * max_len])) for j, c in enumerate(range(0, len(own), 4 * max_len))]
                    lo = hi
                k, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([docs_of.take(pa.array(k)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])
                at += n

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def price(values: np.ndarray, room: int) -> np.ndarray:
    """Knapsack by dynamic programming: copies of each size 1..room (values[size], 0 where there is none) that fit in
    room with the largest total value."""
    best, pick = np.zeros(room + 1), np.zeros(room + 1, dtype=np.int64)
    for c in range(1, room + 1):
        total = best[:c][::-1] + values[1 : c + 1]  # by size 1..c
        k = int(total.argmax())
        best[c] = best[c - 1]
        if total[k] > best[c] + 1e-12:
            best[c], pick[c] = total[k], k + 1
    copies, c = np.zeros(room + 1, dtype=np.int64), room
    while c > 0:
        if pick[c]:
            copies[pick[c]] += 1
            c -= pick[c]
        else:
            c -= 1
    return copies


def solve(demand: np.ndarray, prices: int) -> list[tuple[float, np.ndarray]]:
    """demand[size] -> (amount, copies of each size) by multiplicative weights, the amounts scaled so that together
    they cover the demand once."""
    room = len(demand) - 1
    kinds = demand > 0
    size = np.arange(room + 1) / room
    covered = np.zeros(room + 1)
    used: dict[bytes, list] = {}
    for _ in range(prices):
        behind = covered[kinds].mean() - covered
        copies = price(np.where(kinds, size * np.exp(np.clip(URGE * behind, -20, 20)), 0), room)
        own = copies > 0
        amount = SHARE * (demand[own] / copies[own]).min()
        covered[own] += amount * copies[own] / demand[own]
        entry = used.setdefault(copies.tobytes(), [0.0, copies])
        entry[0] += amount
        if covered[kinds].min() >= 1:
            break
    scale = max(1e-9, float(np.average(covered[kinds], weights=(demand * size)[kinds])))
    return sorted(((a / scale, c) for a, c in used.values()), key=lambda x: -x[0])


class Packer:
    """A plan in the making. Sequences with equal room are kept as runs of consecutive numbers."""

    def __init__(self, histogram: dict[int, int], max_len: int):
        self.max_len = max_len
        self.left = {n: k for n, k in histogram.items() if k > 0}
        self.given = dict.fromkeys(self.left, 0)
        self.runs: list[tuple] = []
        self.sequences = 0
        #: Rooms of open sequences, sorted; room -> runs of sequences (first, count) that have it.
        self.rooms: list[int] = []
        self.at: dict[int, list[tuple[int, int]]] = {}

    def open(self, room: int, first: int, count: int) -> None:
        if room and count:
            if room not in self.at:
                bisect.insort(self.rooms, room)
                self.at[room] = []
            self.at[room].append((first, count))

    def place(self, n: int, each: int, times: int, first: int, offset: int) -> None:
        """each pieces of length n into each of times sequences from first on, at offset."""
        self.runs.append((n, self.given[n], times * each, each, first, offset))
        self.given[n] += times * each
        self.left[n] -= times * each

    def put(self, items: list[tuple[int, int]], times: int) -> None:
        """times new sequences of items (length, copies)."""
        offset = 0
        for n, copies in items:
            self.place(n, copies, times, self.sequences, offset)
            offset += n * copies
        self.open(self.max_len - offset, self.sequences, times)
        self.sequences += times

    def best_fit(self) -> None:
        """Longest first, each piece into the sequence with the least room that holds it, else into a new one. Once a
        piece of length n is in, its sequence has the least room for the next one: it is filled before another."""
        for n in sorted(self.left, reverse=True):
            while k := self.left[n]:
                spot = bisect.bisect_left(self.rooms, n)
                if spot == len(self.rooms):
                    each = min(k, self.max_len // n)
                    self.put([(n, each)], k // each)
                    continue
                room = self.rooms[spot]
                first, count = self.at[room].pop()
                if not self.at[room]:
                    del self.at[room]
                    self.rooms.pop(spot)
                each = min(k, room // n)
                times = min(count, k // each)
                self.place(n, each, times, first, self.max_len - room)
                self.open(room - each * n, first, times)
                self.open(room, first + times, count - times)

    def copy(self) -> Packer:
        out = Packer({}, self.max_len)
        out.left, out.given, out.runs, out.sequences = dict(self.left), dict(self.given), list(self.runs), self.sequences
        out.rooms, out.at = list(self.rooms), {k: list(v) for k, v in self.at.items()}
        return out

    def program(self, unit: int, prices: int, solutions: int) -> Iterator[None]:
        """Solutions of the configuration program over lengths in units, rounded, until they place nothing to speak of.
        Yields after each."""
        for n in [n for n in self.left if n == self.max_len]:
            self.put([(n, 1)], self.left[n])
        room = self.max_len // unit
        for _ in range(solutions):
            by_size: dict[int, list[int]] = {}
            demand = np.zeros(room + 1)
            for n in sorted(self.left, reverse=True):
                if self.left[n] and -(-n // unit) <= room:
                    by_size.setdefault(-(-n // unit), []).append(n)
                    demand[-(-n // unit)] += self.left[n]
            before = sum(self.left.values())
            if not by_size:
                return
            for amount, copies in solve(demand, prices):
                sizes = np.nonzero(copies)[0]
                times = int(min(round(amount), min(sum(self.left[n] for n in by_size[s]) // copies[s] for s in sizes)))
                while times > 0:  # the lengths of a size are used up one after another
                    items, most = [], times
                    for s in sizes:
                        need = int(copies[s])
                        for n in by_size[s]:
                            take = min(need, self.left[n])
                            if take:
                                items.append((n, take))
                                most = min(most, self.left[n] // take)
                                need -= take
                    self.put(items, most)
                    times -= most
            yield
            if before - sum(self.left.values()) < PROGRESS * before:
                return


def plan(histogram: dict[int, int], max_len: int = MAX_LEN) -> pd.DataFrame:
    """Lengths and how many pieces have them -> runs: length, rank (the first), n (pieces), each (in one sequence),
    sequence (the first), offset (of the first in its sequence). Never more sequences than best fit needs."""
    fewest = -(-sum(n * k for n, k in histogram.items()) // max_len)
    best = Packer(histogram, max_len)
    best.best_fit()
    for unit, prices, solutions in PROGRAMS:
        own = Packer(histogram, max_len)
        for _ in own.program(unit, prices, solutions):
            filled = own.copy()
            filled.best_fit()
            if filled.sequences <= best.sequences:
                best = filled
            if best is filled and filled.sequences == fewest:
                break
        if best.sequences == fewest:
            break
    runs = best.runs
    return pd.DataFrame(runs, columns=["length", "rank", "n", "each", "sequence", "offset"]).astype("int64").sort_values(["length", "rank"], ignore_index=True)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row.

    A null or empty text is one piece, the end id; a text of any length is tokenized whole. A null doc_id stays null.
    Repeated rows are packed each. An empty table gives an empty one. Other columns are not looked at, whatever their
    names.
    """
    spark = docs.sparkSession
    found = cut(pieces_of(docs, tokenizer, max_len, end_id).withColumn("part", F.spark_partition_id()))
    counts = cut(found.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_len rows at most
    shared = spark.sparkContext.broadcast(plan(histogram, max_len))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(max_len + 1, dtype=np.int64)
        for batch in batches:
            rank = batch.groupby("length").cumcount().to_numpy() + seen[batch.length.to_numpy()]
            seen += np.bincount(batch.length.to_numpy(), minlength=max_len + 1)
            yield batch.assign(rank=rank, doc_id=batch.doc_id.astype("Int64"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = shared.value
        # (length, rank) as one number: a run holds the ranks from its first on
        wide = int(runs["rank"].max()) + int(runs["n"].max()) + 1 if len(runs) else 1
        firsts = runs["length"].to_numpy() * wide + runs["rank"].to_numpy()
        for batch in batches:
            k = np.searchsorted(firsts, batch.length.to_numpy() * wide + batch["rank"].to_numpy(), side="right") - 1
            run = runs.iloc[k]
            step = batch["rank"].to_numpy() - run["rank"].to_numpy()
            each = run["each"].to_numpy()
            batch = batch.assign(sequence_id=run["sequence"].to_numpy() + step // each, offset=run["offset"].to_numpy() + step % each * batch.length.to_numpy(), doc_id=batch.doc_id.astype("Int64"))
            yield batch[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    placed = found.mapInPandas(place, f"{PIECES}, part int, rank long").join(before, ["part", "length"])
    ranked = placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInPandas(look, f"{PIECES}, sequence_id long, offset long")
