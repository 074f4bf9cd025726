import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from newsloom.llm import minhash

SF = "/root/testdata/sf0.01"


def shingles(text: str) -> set:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def expected(rows: list[tuple]) -> dict:
    """doc_id -> (text, edited, next) for distinct ids."""
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = {}
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        out[i] = text, text[: len(text) - half] + after[:half], after
    return out


def test_edited_texts_and_likeness(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = expected(docs.select("doc_id", "text").collect())
    rows = minhash.report(docs).collect()
    assert len(rows) == len(want)
    errors, by_text = [], {}
    for r in rows:
        text, edited, after = want[r.doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        errors += [abs(r.near_edited - jaccard(text, edited)), abs(r.near_next - jaccard(text, after))]
    assert sum(errors) / len(errors) < 0.02 and max(errors) < 0.25


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8, 0.95])
def test_likeness_is_unbiased_for_short_and_long_texts(spark, share):
    pairs = []
    for k in range(60):
        n = [30, 80, 400][k % 3]
        same = int(n * share)
        pairs.append((" ".join(f"w{k}x{i}" for i in range(n)), " ".join(f"w{k}x{i}" for i in range(same)) + " " + " ".join(f"v{k}x{i}" for i in range(n - same))))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.s for r in df.select(minhash.fingerprint(F.col("a")).alias("a"), minhash.fingerprint(F.col("b")).alias("b")).select(minhash.likeness(F.col("a"), F.col("b")).alias("s")).collect()]
    off = [g - jaccard(*p) for g, p in zip(got, pairs, strict=True)]
    assert abs(sum(off) / len(off)) < 0.03


def test_nulls_repeats_white_space_and_empty_tables(spark):
    rows = [(5, "a b c", 1), (5, "a b c", 2), (5, "z", 3), (None, "x y", 4), (2, None, 5), (1, " \n\t", 6), (9, "A  b\x0bc", 7), (8, "é" * 3, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank long")
    got = minhash.report(docs).collect()
    assert len(got) == len(rows) and sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    prints = {(r.doc_id, r.n_chars): r for r in got}
    assert prints[5, 5].fingerprint == prints[9, 6].fingerprint != ""
    assert prints[2, 0].fingerprint == prints[1, 3].fingerprint == "" and prints[2, 0].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert minhash.report(docs.limit(0)).count() == 0
    one = minhash.report(docs.where("doc_id = 8")).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(3, 1.0)]


def test_ranks_are_the_order(spark):
    df = spark.range(1000).select(F.expr("id * 7919 % 1000").alias("k")).repartition(7)
    got = sorted((r["rank"], r.k) for r in minhash.ranked(df, F.col("k").desc()).collect())
    assert got == [(i, 999 - i) for i in range(1000)]


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def plain_fingerprint(text: str) -> str:
    """One-permutation MinHash and its densification, bin by bin, from the description."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return ""

    def chained(*parts: bytes) -> int:
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p, h)
        return h

    runs = [words[i : i + 5] for i in range(len(words) - 4)] if len(words) >= 5 else [[" ".join(words)]]
    least: dict[int, int] = {}
    for run in runs:
        h = signed(chained(*(w.encode() for w in run)))
        if h & ((1 << 57) - 1) != (1 << 57) - 1:
            least[h >> 57] = min(h, least.get(h >> 57, h))
    own = [least.get(b) for b in range(-64, 64)]
    out = []
    for i, h in enumerate(own):
        if h is None:
            tries = (own[signed(chained(struct.pack("<i", i), struct.pack("<i", t))) % 128] for t in range(minhash.PROBES))
            h = next((x for x in tries if x is not None), None)
        if h is None:
            h = min((signed(chained(struct.pack("<i", i), struct.pack("<q", x >> 57), struct.pack("<i", -1))), x) for x in least.values())[1]
        out.append(h & 255)
    return bytes(out).hex()


def test_fingerprints_by_brute_force(spark):
    """Of one shingle up to many, so that bins are nearly all empty, and full; and of a very long text."""
    rng = random.Random(1)
    texts = ["", " ", "one", "A b\tC d", "a b c d e", "é ü", *(" ".join(f"w{rng.randrange(3000)}" for _ in range(n)) for n in (6, 7, 9, 20, 60, 200, 1500, 60_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.f for r in docs.select("doc_id", F.lower(F.hex(minhash.fingerprint(F.col("text")))).alias("f")).collect()}
    assert got == {k: plain_fingerprint(t) for k, t in enumerate(texts)}
    rows = {r.doc_id: r for r in minhash.report(docs).collect()}
    assert rows[13].n_chars == len(texts[13]) and rows[13].edited_fingerprint == plain_fingerprint(expected(list(enumerate(texts)))[13][1])
