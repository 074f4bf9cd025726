"""Conversation prefix trie: which beginnings conversations share, by succinct level-order tries in shards.

A prefix is known by running sums of hashes over a conversation's turns: each turn's SHA-256, taken with its place,
gives four numbers of 32 bits; their sums up to a turn name the prefix. So no sequence is ever brought together: turns
travel as digests, and a prefix is a row. Equal rows are folded by partial aggregation into the trie's nodes.

The rows below a node are counted with the node. Nodes with more rows below than a shard holds are heavy; below them
hang light subtrees. The heavy ones are at most heavy_nodes: a shard holds shard_rows rows, and more where that bound
asks for it. Light subtrees are the prefix shards: tasks take them in turn and build, for as many as make a batch, a
level-order trie with numpy: nodes by level, a LOUDS bitvector (a one for each child and a zero for each node), arrays of
the nodes' labels. Parents come from the bitvector, and a reverse pass over the levels adds leaves and saved tokens to
them. The heavy levels are merged apart: what shards say of their tops is added up by heavy parent, and one more trie,
of heavy nodes only, hands it up to the root.

Members that end at a node are hashed in ascending order: they are dealt out by ranges of (node, conv_id), each task
joins its own into runs of text, and the runs of a node are hashed one after the other. So a sequence that a third of
all conversations have is sorted by many tasks, and one task reads long runs of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import cut

#: The longest shared head, and how many conversations share one.
HEADS, GROUP = 6, 100
#: Rows of a shard, heavy nodes at most, nodes of a batch of shards, ids of a run.
SHARD_ROWS, HEAVY_NODES, BATCH, RUN = 200, 200_000, 100_000, 50_000
LANES = ["a", "b", "c", "d"]
EMPTY = hashlib.sha256(b"").hexdigest()

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, node binary, parent binary"


def lanes(digest: Column, place: Column) -> list[Column]:
    """Four numbers of 32 bits of a turn at a place."""
    h = F.sha2(F.concat(digest, F.encode(F.concat(F.lit("/"), place.cast("string")), "UTF-8")), 256)
    return [F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long").alias(x) for k, x in enumerate(LANES)]


def prefix(sums: list[Column], depth: Column) -> Column:
    """The name of the prefix with these sums: 16 bytes."""
    return F.substring(F.unhex(F.sha2(F.concat_ws(",", depth.cast("string"), *(s.cast("string") for s in sums)).cast("binary"), 256)), 1, 16)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns (conv_id, turn, role, text) -> all conversations (conv_id, size), and a row for each turn of the rebuilt
    ones: conv_id, depth (from 1), node and parent (names of prefixes), chars (of the turn's text), below (turns of this
    conversation from this one on).

    Turns of one number are in the order of their digests. Rows without a conv_id are of no conversation."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(F.encode(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    in_order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    rows = cut(rows.withColumn("rank", F.row_number().over(in_order).cast("long")))

    # A conversation's own head of h turns goes; it takes that of the first one of its hundred, or what there is of it.
    h, base = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("long"), F.col("conv_id") - F.col("conv_id") % GROUP
    convs = rows.groupBy("conv_id").agg(F.max("rank").alias("own")).select("conv_id", "own", h.alias("h"), base.alias("base"))
    heads = rows.where((F.col("conv_id") % GROUP == 0) & (F.col("rank") < HEADS)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("rank", "digest", "chars"))).alias("head"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.filter("head", lambda t: t["rank"] <= F.col("h")))
    k = F.coalesce(F.size("head"), F.lit(0)).cast("long")
    convs = cut(convs.select("conv_id", "h", k.alias("k"), (k + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size"), F.coalesce("head", F.array().cast("array<struct<rank:bigint,digest:binary,chars:bigint>>")).alias("head")))

    # Own turns and taken ones together, each at its place.
    own = rows.join(convs.select("conv_id", "h", "k", "size"), "conv_id").where("rank > h").select("conv_id", (F.col("rank") - F.col("h") + F.col("k")).alias("depth"), "digest", "chars", "size")
    taken = convs.select("conv_id", "size", F.explode("head").alias("t")).select("conv_id", F.col("t.rank").alias("depth"), "t.digest", "t.chars", "size")
    placed = own.unionByName(taken).select("conv_id", "depth", "chars", "size", *lanes(F.col("digest"), F.col("depth")))
    upto = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("conv_id", "depth", "chars", "size", *LANES, *(F.sum(x).over(upto).alias(f"s{x}") for x in LANES))
    node = prefix([F.col(f"s{x}") for x in LANES], F.col("depth"))
    parent = prefix([F.col(f"s{x}") - F.col(x) for x in LANES], F.col("depth") - 1)
    found = summed.select("conv_id", "depth", node.alias("node"), parent.alias("parent"), "chars", (F.col("size") - F.col("depth") + 1).alias("below"))
    return convs.select("conv_id", "size"), cut(found)


def louds(depth: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest's nodes, given by depth and row of the parent (-1: none), in level order: the order, and the LOUDS
    bitvector, in which an imaginary root stands first: for each node a one for each child, then a zero.

    Level by level, nodes stand in the order of their parents."""
    n, order, place = len(depth), [], np.full(len(depth) + 1, -1, dtype=np.int64)
    by_depth = np.argsort(depth, kind="stable")
    top = parent < 0
    level, done = by_depth[top[by_depth]], 0
    children = by_depth[~top[by_depth]]
    # Roots may stand at different depths: each level is the children of the one before, not those of one depth.
    child_of = np.argsort(parent[children], kind="stable")
    children = children[child_of]
    first = np.searchsorted(parent[children], np.arange(n))
    count = np.searchsorted(parent[children], np.arange(n), side="right") - first
    degrees = [np.array([len(level)], dtype=np.int64)]
    while len(level):
        order.append(level)
        place[level] = done + np.arange(len(level))
        done += len(level)
        degree = count[level]
        degrees.append(degree)
        ends = np.cumsum(degree)
        level = children[np.repeat(first[level] - (ends - degree), degree) + np.arange(ends[-1] if len(ends) else 0)]
    degree = np.concatenate(degrees)
    bits = np.ones(len(degree) + int(degree.sum()), dtype=bool)
    bits[np.cumsum(degree + 1) - 1] = False
    return (np.concatenate(order) if order else np.zeros(0, dtype=np.int64)), bits


def rolled_up(bits: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The bitvector's parents (by place, -1 for roots) and degrees, and the values, given in level order, with those of
    all nodes below added: levels are gone through in reverse, each added to the one above."""
    zeros = np.cumsum(~bits)
    ones = np.flatnonzero(bits)
    parent = zeros[ones] - 1  # the i-th one stands in its parent's block; block 0 is the imaginary root's
    degree = np.diff(np.flatnonzero(~bits), prepend=-1)[1:] - 1
    out = [v.copy() for v in values]
    # A level starts at the first child of the level before.
    starts, at = [0], int(np.count_nonzero(parent < 0))
    while at < len(parent):
        starts.append(at)
        at = int(np.searchsorted(parent, at))
        if at == starts[-1]:
            break
    ends = [*starts[1:], len(parent)]
    for lo, hi in zip(starts[:0:-1], ends[:0:-1], strict=True):
        for v in out:
            np.add.at(v, parent[lo:hi], v[lo:hi])
    return [parent, degree, *out]


def trie(batch: pa.RecordBatch, leaves: np.ndarray | None = None, below: np.ndarray | None = None, more: np.ndarray | None = None) -> pa.RecordBatch:
    """Nodes of whole subtrees (node, parent, depth, conv_id, n_convs, chars) with what the trie says of them. leaves,
    below, more: leaves, saved tokens and children that hang below each node outside of the batch."""
    node, parent = batch.column("node"), batch.column("parent")
    up = pc.fill_null(pc.index_in(parent, value_set=node), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    depth, conv, convs, chars = (batch.column(c).to_numpy() for c in ("depth", "conv_id", "n_convs", "chars"))
    order, bits = louds(depth, up)
    own = (convs - 1) * chars
    degree = np.zeros(len(order), dtype=np.int64) if more is None else more[order]
    ends = np.diff(np.flatnonzero(~bits), prepend=-1)[1:] - 1 + degree == 0
    parents, found, n_leaves, saved = rolled_up(bits, ends.astype(np.int64) + (0 if leaves is None else leaves[order]), own[order] + (0 if below is None else below[order]))
    labels = conv[order]
    above = pa.array(np.where(parents < 0, 0, labels[np.maximum(parents, 0)] if len(labels) else parents), mask=parents < 0)
    columns = [pa.array(labels), pa.array(depth[order]), above, pa.array(convs[order]), pa.array(found + degree), pa.array(n_leaves), pa.array(saved), node.take(pa.array(order)), parent.take(pa.array(order))]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in NODES.split(", ")])


def light(nodes: DataFrame, rows: int) -> DataFrame:
    """nodes of light subtrees (with shard) -> NODES; tops have no parent_conv_id. Each task builds a trie for as many
    shards as make some rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def joined() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < rows:
                continue
            whole = joined()
            shard = whole.column("shard")
            last = pc.equal(shard, shard[len(shard) - 1])
            at = len(whole) - pc.sum(last).as_py()  # rows of a shard stand together: the last one may go on
            if at:
                yield trie(whole.slice(0, at))
            held = [whole.slice(at)]
        if sum(map(len, held)):
            yield trie(joined())

    return nodes.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, NODES)


def heavy(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """The heavy nodes, at most HEAVY_NODES, with what hangs below them -> NODES, by one trie in one task."""
    below = tops.groupBy(F.col("parent").alias("node")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count("*").alias("children"))
    ready = nodes.join(below, "node", "left").fillna(0, ["leaves", "saved", "children"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if len(b)]
        if whole:
            one = pa.Table.from_batches(whole).combine_chunks().to_batches()[0]
            yield trie(one, *(one.column(c).to_numpy() for c in ("leaves", "saved", "children")))

    return ready.coalesce(1).mapInArrow(run, NODES)


def ends_of(ends: DataFrame) -> DataFrame:
    """(node, conv_id) -> node and the SHA-256 of its conv_ids, ascending and comma-joined."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids = None, None, []
        for batch in batches:
            out: list[tuple] = []
            for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if n != node or len(ids) == RUN:
                    if ids:
                        out.append((node, first, ",".join(ids)))
                    node, first, ids = n, c, []
                ids.append(str(c))
            if out:
                yield made(out)
        if ids:
            yield made([(node, first, ",".join(ids))])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        node, first, text = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(first, pa.int64()), pa.array(text)], ["node", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for n, text in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if n == node:
                    state.update(b"," + text.encode())
                    continue
                if state:
                    out.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(text.encode())
            if len(out) > RUN:
                yield told(out)
                out = []
        if state:
            out.append((node, state.hexdigest()))
        if out:
            yield told(out)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        node, digest = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(digest)], ["node", "ends_sha256"])

    dealt = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(runs, "node binary, first long, ids string")
    return dealt.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node binary, ends_sha256 string")


def report(turns: DataFrame, shard_rows: int = SHARD_ROWS, heavy_nodes: int = HEAVY_NODES, batch: int = BATCH) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    A null role or text is empty. Turns of one number, repeated rows among them, all count, in the order of their
    digests; null numbers come first. Rows without a conv_id are left out. An empty table gives no rows.
    Texts of any length count whole; other columns are not looked at, whatever their names."""
    convs, rows = rebuilt(turns)
    root = prefix([F.lit(0)] * len(LANES), F.lit(0))
    nodes = cut(rows.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"), F.sum("below").alias("below")))
    # Each row is below as many nodes as it is deep: no more nodes than total / limit have limit rows or more below.
    total = nodes.agg(F.coalesce(F.sum("below"), F.lit(0))).first()[0]
    limit = max(shard_rows, -(-total // heavy_nodes))
    upper = nodes.where(F.col("below") > limit)
    known = F.broadcast(upper.select("node", F.lit(True).alias("heavy")))
    # The shard of a conversation's light nodes is the first one of them.
    shards = rows.select("conv_id", "depth", "node").join(known, "node", "left").where("heavy is null").groupBy("conv_id").agg(F.min_by("node", "depth").alias("shard"))
    below = cut(light(nodes.where(F.col("below") <= limit).join(shards, "conv_id"), batch))
    every = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"))
    upper = cut(every.unionByName(upper.drop("below")))
    tops = below.where("parent_conv_id is null")
    above = heavy(upper, tops)
    parents = F.broadcast(upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")))
    named = below.join(parents, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).drop("above")
    ends = ends_of(rows.where("below = 1").select("node", "conv_id").unionByName(convs.where("size = 0").select(root.alias("node"), "conv_id")))
    found = above.unionByName(named).join(cut(ends), "node", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
