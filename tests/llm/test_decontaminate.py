import hashlib
import re

from newsloom.llm import decontaminate as d

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    lengths = {len(w) for w in wins}
    out = []
    for i, t in docs:
        w, hit, own = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    own |= wins[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


def test_against_every_window_tried(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute(docs.select("doc_id", "text").collect(), items.collect())
    assert order(d.report(docs, items).collect()) == order(want) and any(r[5] for r in want)


def test_short_items_repeats_nulls_and_blocks(spark):
    items = [(1, "one two"), (10, "One, TWO!"), (2, " ".join("abcdefghijkl")), (3, None), (4, "..."), (5, "É x"), (None, "q r")]
    rows = [(1, "one two one two-one", 0), (1, "one two one two-one", 1), (2, "z " + " ".join("abcdefghijklm") + " z", 2), (3, None, 3), (4, "", 4), (None, "É x é x", 5), (6, "q r", 6), (7, "one " * 5000 + "two", 7), (8, "AB Cd ONE two eF, G One Two.", 8)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string, found long")
    want = brute([r[:2] for r in rows], [i for i in items if i[0]])
    want = [(6, 2, 2, 0, hashlib.sha256(b"").hexdigest(), True) if r[0] == 6 else r for r in want]
    assert order(d.report(docs, bench).collect()) == order(want)
    blocks = d.hits(docs, d.windows_of(bench), block_windows=2).collect()
    assert sum(r.copies for r in blocks) == len(rows) and {r.doc_id: len(r.items) for r in blocks}[1] == 2
    assert order(d.report(docs, bench.limit(0)).collect()) == order(brute([r[:2] for r in rows], []))
    assert d.report(docs.limit(0), bench).count() == 0
    kept = {(r.doc_id, r.found): r.text for r in d.remove(docs, bench).collect()}
    assert kept[2, 2] == "z m z" and kept[1, 0] == kept[1, 1] == "-one" and kept[3, 3] is None and kept[None, 5] == " é x" and kept[6, 6] == ""
    assert kept[8, 8] == "AB Cd eF, G."
    assert sorted(r.found for r in d.remove(docs, bench, whole_documents=True).collect()) == [3, 4]


def test_cut_texts_are_clean_and_others_untouched(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r.doc_id for r in d.report(docs, items).where("contaminated").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    after = d.remove(docs, items)
    assert after.columns == docs.columns
    rows = {r.doc_id: r for r in after.collect()}
    assert len(rows) == len(before) and all(rows[i] == before[i] for i in before if i not in hit)
    assert all(rows[i].n_chars == len(rows[i].text) < len(before[i].text) for i in hit)


def test_no_python_in_the_plan(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    plan = d.report(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_spans_by_hand_and_in_long_texts(spark):
    """Spans of random hits as a set of words has them; 60,000 contaminated words are cut in a moment; clashing names."""
    import random

    rng = random.Random(6)
    rows = []
    for k in range(60):
        own = sorted({(rng.randrange(150), rng.choice([2, 10, 10, 3])) for _ in range(rng.choice([0, 1, 5, 40, 200]))})
        rows.append((k, own))
    got = spark.createDataFrame(rows, "k int, f array<struct<place:int,length:int>>").select("k", d.merged(d.F.col("f")).alias("s")).collect()
    for k, spans in got:
        words_hit = {w for p, n in rows[k][1] for w in range(p, p + n)}
        touch = {p for p, _ in rows[k][1]}
        want = sorted(w for w in words_hit if w - 1 not in words_hit)
        assert sorted(w for a, b in spans for w in range(a, b)) == sorted(words_hit) and {a for a, _ in spans} >= set(want) and {a for a, _ in spans} <= touch
    items = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(12))) for k in range(300)], "item_id long, text string")
    long = " ".join(["keep", *(f"w{j}" for j in range(12))] * 5000)
    docs = spark.createDataFrame([(1, long, 7), (2, "clean", None)], "doc_id long, text string, n_chars long").selectExpr("*", "'a' `row`", "'b' spans", "'c' doc", "'d' own", "'e' new")
    rows = {r.doc_id: tuple(r) for r in d.remove(docs, items).collect()}
    assert rows == {1: (1, "keep" + " keep" * 4999, 24_999, *"abcde"), 2: (2, "clean", None, *"abcde")}
    seen = {r.doc_id: r for r in d.report(docs, items).collect()}
    assert seen[1].n_hit == 60_000 and seen[1].n_items == 300 and seen[2].n_items == 0
