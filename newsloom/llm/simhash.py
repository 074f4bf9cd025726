"""SimHash fingerprints and near duplicates by a binary trie self-join.

Copies of a text are folded into one fingerprint before any comparing. Distinct fingerprints within max_bits of each
other agree on two of max_bits + 2 blocks of bits, so a cell (two blocks, their values) holds both. For 3 bits a cell's
key has some 25 bits: 10^10 fingerprints put a few hundred in each of the ten kinds of cells. In each cell a trie over
the fingerprints is joined with itself: node pairs go down together, differing bits add up, and a pair that exceeds
the budget is dropped with all below it. A cell with more than cell_rows fingerprints is dealt into classes and
joined class by class, so no task grows with a hot cell and no link is lost. A task returns a spanning forest of its
links, not all pairs, and components follow from these.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import LAST, carried, cut, doc_order, restored, row_key
from newsloom.llm.graph import connected_components, least_of_component

MAX_BITS, SHINGLE, CELL_ROWS, TASK_ROWS = 3, 3, 4096, 60_000
#: Shingles whose bits are summed at a time.
STEP = 1 << 15
#: Node pairs that are looked at together, and the product of two nodes' sizes under which their texts are compared.
FRONT, LEAF = 1 << 18, 16


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint, as a signed number; 0 for null and for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter((digest(p, 42) for p in parts), dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), STEP):
        counts += np.unpackbits(hashes[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def simhash_column(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([simhash(x, shingle) for x in part], dtype="int64")

    return of(text)


class Forest:
    """Union-find over numbers 0..n-1, whole arrays of links at a time."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.up[a], self.up[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while (self.up != (up := self.up[self.up])).any():
                self.up = up


def trie_join(prints: np.ndarray, left: np.ndarray, right: np.ndarray, max_bits: int, found) -> None:
    """prints: unsigned, sorted within every range. left, right: ranges (lo, hi); the same range twice joins it with
    itself. Calls found(i, j) with the places of prints that differ in max_bits or fewer bits.

    A node of the trie is a range that agrees on its first bits; its children are split by the next one.
    """
    ones: dict[int, np.ndarray] = {}

    def split(depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((prints >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        return hi - (ones[depth][hi] - ones[depth][lo])

    stack = [(0, *left.T, *right.T, np.zeros(len(left), dtype=np.int64))]
    while stack:
        depth, al, ah, bl, bh, err = stack.pop()
        if len(al) > FRONT:
            half = len(al) // 2
            stack += [(depth, *(x[half:] for x in (al, ah, bl, bh, err))), (depth, *(x[:half] for x in (al, ah, bl, bh, err)))]
            continue
        small = ((ah - al) * (bh - bl) <= LEAF) | (depth == 64)
        if small.any():
            sal, sbl, na, nb = al[small], bl[small], (ah - al)[small], (bh - bl)[small]
            cuts = np.cumsum(na * nb)
            for lo in range(0, len(sal), max(1, FRONT // LEAF)):
                part = slice(lo, lo + max(1, FRONT // LEAF))
                size = (na * nb)[part]
                within = np.arange(size.sum()) - np.repeat(cuts[part] - size - (cuts[lo] - size[0]), size)
                i, j = np.repeat(sal[part], size) + within // np.repeat(nb[part], size), np.repeat(sbl[part], size) + within % np.repeat(nb[part], size)
                near = (i != j) & (np.bitwise_count(prints[i] ^ prints[j]) <= max_bits)
                found(i[near], j[near])
            al, ah, bl, bh, err = (x[~small] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        am, bm, own = split(depth, al, ah), split(depth, bl, bh), (al == bl) & (ah == bh)
        kids = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1), *([tuple(x[~own] for x in (am, ah, bl, bm, err + 1))])]
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*kids, strict=True))
        keep = (ah > al) & (bh > bl) & (err <= max_bits)
        stack.append((depth + 1, *(x[keep] for x in (al, ah, bl, bh, err))))


def _links_of(part: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """Rows (cell, s, t, side, fp) of some cells -> a spanning forest of each cell's links, as (a, b)."""
    part = part.assign(fp=part.fp.to_numpy().astype("int64").view("uint64")).sort_values(["cell", "s", "t", "side", "fp"], ignore_index=True)
    prints = part.fp.to_numpy()
    keys = part[["cell", "s", "t", "side"]].to_numpy()
    starts = np.concatenate([[0], np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1])
    ranges = np.stack([starts, np.append(starts[1:], len(keys))], axis=1)
    first = keys[starts]
    own = first[:, 1] == first[:, 2]
    two = np.nonzero((first[:-1, :3] == first[1:, :3]).all(axis=1) & (first[:-1, 3] != first[1:, 3]))[0]
    left, right = np.concatenate([ranges[own], ranges[two]]), np.concatenate([ranges[own], ranges[two + 1]])
    several = (left[:, 1] - left[:, 0] > 1) | (left[:, 0] != right[:, 0])
    forest = Forest(len(prints))
    trie_join(prints, left[several], right[several], max_bits, forest.link)
    below = np.nonzero(forest.up != np.arange(len(prints)))[0]
    return pd.DataFrame({"a": prints[below].view("int64"), "b": prints[forest.up[below]].view("int64")})


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Distinct fingerprints (fp long) -> links (a, b) that connect all that are within max_bits, repeats possible."""
    blocks = max_bits + 2
    edge = [64 * k // blocks for k in range(blocks + 1)]
    value = [f"shiftrightunsigned(fp, {edge[k]}) & {(1 << (edge[k + 1] - edge[k])) - 1}L" for k in range(blocks)]
    kinds = list(combinations(range(blocks), 2))
    values = [F.expr(f"((({value[i]}) << {edge[j + 1] - edge[j]}) | ({value[j]})) * {len(kinds)} + {k}") for k, (i, j) in enumerate(kinds)]
    cells = prints.select("fp", F.explode(F.array(*values)).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
    many = cut(sizes.where(F.col("n") > 1).select("cell", "n", F.ceil(F.col("n") / cell_rows).cast("int").alias("classes")))
    dealt = cells.join(many, "cell").withColumn("own", F.expr("cast(pmod(xxhash64(fp, 7), classes) as int)"))
    pairs = dealt.select("fp", "cell", "own", F.explode(F.sequence(F.lit(0), F.col("classes") - 1)).alias("other"))
    pairs = pairs.select("cell", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), F.expr("cast(own > other as int)").alias("side"), "fp")
    tasks = max(1, -(-(many.agg(F.sum(F.col("n") * F.col("classes"))).first()[0] or 0) // TASK_ROWS))
    pairs = pairs.withColumn("task", F.expr(f"pmod(xxhash64(cell, s, t), {tasks * 4})"))
    return pairs.groupBy("task").applyInPandas(lambda part: _links_of(part, max_bits), "a long, b long")


def components(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, ...) -> its rows (doc_id, fp) and for each fp (key): root and first, the smallest (doc, rk) of
    its component; doc orders rows without an id last, rk tells texts of one id apart."""
    prints = cut(docs.select("doc_id", row_key(F.col("text")).alias("rk"), simhash_column(F.col("text"), shingle).alias("fp")))
    nodes = cut(prints.groupBy("fp").agg(F.min(F.struct(doc_order(F.col("doc_id")).alias("doc"), "rk")).alias("least")))
    roots = connected_components(near_links(nodes.select("fp"), max_bits))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(F.col("fp").alias("key"), "least", F.coalesce("root", "fp").alias("root"))
    return prints.select("doc_id", "fp"), least_of_component(rooted)


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text, ...) -> one row per row: doc_id, fp long, component_id long.

    component_id is the smallest doc_id that can be reached over links; texts without words have fingerprint 0 and
    link like any other; a text of any length is hashed whole. Rows with a null doc_id take part; a component of such
    rows only has a null id. Repeated rows stay as they are. An empty table gives an empty one; other columns are not
    looked at, whatever their names.
    """
    prints, named = components(docs, max_bits, shingle)
    return prints.join(named.select(F.col("key").alias("fp"), "first"), "fp").select("doc_id", "fp", F.nullif("first.doc", F.lit(LAST)).alias("component_id"))


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """docs without near duplicates: of each component one row stays, see one_of_each().

    Null and empty texts, and those without words, have fingerprint 0 and are alike. Texts of any length are hashed
    whole. An empty table stays empty."""
    return one_of_each(docs, components(docs, max_bits, shingle)[1])


def one_of_each(docs: DataFrame, named: DataFrame) -> DataFrame:
    """Of each component the row with the smallest doc_id stays, of several texts under that id the one with the
    smallest key, once where the row is repeated. Other texts under the same doc_id are judged by their own components.
    Rows without an id cannot be named and stay. All columns stay, whatever their names."""
    first = named.select("first.doc", "first.rk").distinct()
    rows = carried(docs, doc_order(F.col("doc_id")).alias("doc"), row_key(F.col("text")).alias("rk"))
    kept = rows.where("row.doc_id is not null").join(first, ["doc", "rk"], "left_semi").dropDuplicates(["doc", "rk"])
    return restored(kept.unionByName(rows.where("row.doc_id is null")), docs.columns)
