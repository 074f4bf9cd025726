import numpy as np
import xxhash

from newsloom.llm import near_texts, simhash

SF = "/root/testdata/sf0.01"


def brute_components(prints: list[int], bits: int = 3) -> list[int]:
    """The first place that each place reaches, over all pairs."""
    p = np.array(prints, dtype="int64").view("uint64")
    up = list(range(len(p)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(p)):
        for j in np.nonzero(np.bitwise_count(p[i + 1 :] ^ p[i]) <= bits)[0] + i + 1:
            a, b = find(i), find(int(j))
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(p))]


def plain_simhash(text: str) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints_by_hand():
    for text in ["", "one", "Two Words", "a b c", "A B\u00a0C d\x0be\x1cf g", "É é É é ß x y z", "x " * 70000]:
        assert simhash.simhash(text) == plain_simhash(text)
    assert simhash.simhash(None) == 0


def test_spark_hashes_alike(spark):
    got = spark.sql("select xxhash64('the quick é') h").first()["h"]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("the quick é".encode(), 42)


def test_components_are_those_of_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(simhash.near_duplicates(docs).collect())
    roots = brute_components([r.fp for r in rows])
    assert [r.component_id for r in rows] == [rows[k].doc_id for k in roots]
    assert len(set(roots)) < len(rows)


def test_hot_cells_are_split_without_loss(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    near = {base ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 7), replace=False)) for _ in range(400)}
    far = {int(x) for x in rng.integers(1 << 62, size=300)}
    prints = sorted(near | far)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = simhash.near_links(df, cell_rows=16).distinct().collect()
    up = {p: p for p in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        assert bin(a ^ b).count("1") or a == b
        up[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(p) for p in prints] == [prints[k] for k in brute_components(prints)]


def test_nulls_ties_repeats_and_empty_tables(spark):
    rows = [(3, "a b c d", 1), (1, "a b c d", 2), (1, "a b c d", 2), (None, "a b c d", 3), (None, "unlike all the others here", 4), (7, None, 5), (6, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([("3", "1"), ("1", "1"), ("1", "1"), ("None", "1"), ("None", "None"), ("7", "6"), ("6", "6")])
    assert sorted(r.doc_id or -1 for r in simhash.keep_one(docs).collect()) == [-1, -1, 1, 6]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_texts_that_share_an_id_are_judged_apart(spark):
    """A copy goes though another text under its id stays; values of columns with clashing names stay what they were."""
    rows = [(1, "one text that is here once only", "a"), (1, "a second text under the same id", "b"), (2, "a third text with a copy further on", "c"), (3, "a third text with a copy further on", "d"), (3, "the last text has id three too", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").selectExpr("*", "row rk", "row first", "'x' doc", "7 `a.b`")
    for kept in (simhash.keep_one(docs), near_texts.keep_one(docs)):
        assert sorted(tuple(r) for r in kept.collect()) == sorted((*r, r[2], r[2], "x", 7) for r in rows if r[2] != "d") and kept.columns == docs.columns


def test_a_hot_component_has_one_name(spark):
    """A third of all rows in one component: its rows meet their name by a broadcast."""
    rng = np.random.default_rng(9)
    base = " ".join(f"w{k}" for k in range(400))
    rows = [(k + 5, f"{base} {'x' * int(rng.integers(1, 50))}") for k in range(300)] + [(1000 + k, " ".join(map(str, rng.integers(10**6, size=30)))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    roots = brute_components([plain_simhash(t) for _, t in rows])
    assert got == {rows[k][0]: rows[r][0] for k, r in enumerate(roots)} and sum(v == 5 for v in got.values()) > 200
