import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import prefix_trie

SF = "/root/testdata/sf0.01"


def brute(rows):
    """The nodes by plain tuples."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, prefix_digest(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(l)] for c, l in own.items()}
    full = {}
    for c, l in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - c % 100 if c >= 0 else c + (-c) % 100
        full[c] = own.get(base, [])[:h] + l[h:]
    members = defaultdict(list)
    for c, l in full.items():
        for d in range(len(l) + 1):
            members[tuple(l[:d])].append(c)
    members.setdefault((), [])
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(full[c]) == len(p))))
        out.append((min(members[p], default=None), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def prefix_digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def found(df, **sizes):
    return sorted(map(tuple, prefix_trie.report(df, **sizes).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, b"x") for r in rows], "conv_id long, turn long, role string, text string, depth int, node binary")


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 3, "heavy_nodes": 10**6, "batch": 1}, {"shard_rows": 40, "heavy_nodes": 10**6, "batch": 50}])
def test_nodes_equal_brute_force(spark, sizes):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert found(df.repartition(5), **sizes) == brute(map(tuple, df.select("conv_id", "turn", "role", "text").collect()))


def test_a_hot_first_turn_and_copies(spark):
    """Half of the conversations begin alike, a third are copies, and one is very long; shards hold a few rows only."""
    random.seed(3)
    rows = []
    for c in range(400):
        n = 120 if c == 77 else random.randrange(1, 8)
        for t in range(n):
            text = "hello" if t == 0 and c % 2 else f"w{random.randrange(3)}" if t < 3 else f"{c} {t}"
            rows.append((c, t, "user" if t % 2 else "assistant", text))
    rows += [(c, t, "user", f"copy {t} é語") for c in range(1000, 1200) for t in range(6)]
    for sizes in ({}, {"shard_rows": 10, "heavy_nodes": 10**6}, {"shard_rows": 1, "heavy_nodes": 50, "batch": 300}):
        assert found(frame(spark, rows), **sizes) == brute(rows)


def test_odd_rows(spark):
    """Nulls in any column, ties of turns, repeated rows, negative ids, conversations that are left without turns."""
    rows = [(None, 1, "user", "x"), (7, None, None, None), (7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, "user", "a"), (8, 0, "", ""), (9, 3, "u", "same"), (109, 3, "u", "same"), (-5, 1, "u", "n"), (-100, 1, "u", "m"), (0, 5, "u", "x" * 100_000), (0, 4, "u", "")]
    rows += [(c, t, "u", f"{t}") for c in range(300, 330) for t in range(c % 7)]
    assert found(frame(spark, rows)) == brute(rows)
    assert any(r[1] == 0 and r[3] > 0 for r in brute(rows))
    assert found(frame(spark, rows).where("conv_id is null")) == []


def test_ends_of_a_hot_node_in_runs(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 7)
    ids = [*range(0, 3000, 3), -4]
    df = spark.createDataFrame([(b"n" if i % 10 else b"m", i) for i in ids], "node binary, conv_id long").repartition(4)
    got = {bytes(r.node): r.ends_sha256 for r in prefix_trie.ends_of(df).collect()}
    for name, those in ((b"n", [i for i in sorted(ids) if i % 10]), (b"m", [i for i in sorted(ids) if i % 10 == 0])):
        assert got[name] == hashlib.sha256(",".join(map(str, those)).encode()).hexdigest()


def test_louds_of_a_forest():
    """Two roots at different depths: 0 with children 1 and 2, and 2 with 3; 4 alone."""
    depth, parent = np.array([1, 2, 2, 3, 5]), np.array([-1, 0, 0, 2, -1])
    order, bits = prefix_trie.louds(depth, parent)
    assert order.tolist() == [0, 4, 1, 2, 3]
    assert "".join("01"[int(b)] for b in bits) == "110" + "110" + "0" + "0" + "10" + "0"
    up, degree, total = prefix_trie.rolled_up(bits, np.array([1, 10, 100, 1000, 10000]))
    assert up.tolist() == [-1, -1, 0, 0, 3]
    assert degree.tolist() == [2, 0, 0, 1, 0]
    assert total.tolist() == [11101, 10, 100, 11000, 10000]
    order, bits = prefix_trie.louds(np.zeros(0, dtype=int), np.zeros(0, dtype=int))
    assert len(order) == 0 and bits.tolist() == [False]


def test_one_conversation_of_many_turns(spark):
    df = spark.range(3000).select(F.lit(100).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.lit("a").alias("text"))
    rows = prefix_trie.report(df, shard_rows=500).orderBy("depth").collect()
    assert [r.depth for r in rows] == list(range(3001))
    assert {r.n_leaves for r in rows} == {1}
