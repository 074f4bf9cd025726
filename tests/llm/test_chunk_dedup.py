import random
import re

from newsloom.llm import chunk_dedup as c

SF = "/root/testdata/sf0.001"
N = c.MIN_WORDS


def split(text):
    """Words by a regular expression: nothing of the operator is used."""
    return re.findall(r"[^ \t\n\x0b\x0c\r]+", text or "")


def bounds(rows, n):
    """(doc, text), in order -> doc -> which words stand in a run of n words that an earlier document has, or that
    stands wholly before in this one."""
    first: dict[tuple, tuple[int, int]] = {}
    out = {}
    for doc, text in rows:
        own, hit = split(text), set()
        for k in range(len(own) - n + 1):
            at, where = first.setdefault(tuple(own[k : k + n]), (doc, k))
            if at != doc or k - where >= n:
                hit |= set(range(k, k + n))
        out[doc] = hit
    return out


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def test_cuts_lie_between_two_brute_force_bounds(spark):
    """Every word that goes stands in a repeated run of some 20 words, and of runs of FOUND words all but MARGIN words
    at the ends go. Both are sets of words over all tuples of words of a table."""
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    long = [r for r in rows if len(split(r[1])) > 120][:40]
    # Whole copies, copies with a word changed, and with a part taken out, after all others.
    rows += [(10_000 + k, t) for k, (_, t) in enumerate(long)]
    rows += [(20_000 + k, re.sub(r"\S+", "changed", t, count=1)) for k, (_, t) in enumerate(long)]
    rows += [(30_000 + k, t[: len(t) // 3] + "\n" + t[len(t) // 2 :]) for k, (_, t) in enumerate(long)]
    most, least = bounds(rows, 2 * c.MARGIN + 1), bounds(rows, c.FOUND)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in c.report(docs).collect()}
    assert len(got) == len(rows)
    changed = 0
    for doc, text in rows:
        spans = [tuple(map(int, x.split("-"))) for x in got[doc].spans.split(",") if x]
        gone = {k for a, b in spans for k in range(a, b)}
        assert got[doc].n_removed == len(gone) and got[doc].n_spans == len(spans) and all(b - a >= N for a, b in spans)
        assert split(got[doc].text) == [w for k, w in enumerate(split(text)) if k not in gone]
        assert spans or got[doc].text == text
        edge = {k for a in least[doc] if a - 1 not in least[doc] for k in range(a, a + c.MARGIN)} | {k for b in least[doc] if b + 1 not in least[doc] for k in range(b - c.MARGIN + 1, b + 1)}
        assert least[doc] - edge <= gone
        whole = {k for k in gone if k in most[doc] or 0 < len(split(text)) < c.FOUND}
        assert whole == gone
        changed += bool(spans)
    assert changed > 100


def test_every_passage_of_51_words_is_found(spark):
    """Whatever the words' lengths: 1,200 passages of 51 to 90 words, each in two texts; of the ends MARGIN words may
    stay. Passages below min_words stay whole."""
    rng = random.Random(51)
    rows, plain, size = [], {}, {}
    for k in range(1200):
        n = (51, 51, 52, 60, 90, N - 1)[k % 6]
        passage, a, b, d, e = words(rng, n), *(words(rng, 30) for _ in range(4))
        if k % 5 == 0:
            passage = [w[0] for w in passage]
        rows += [(k, " ".join(["x1", *a, f"p{k}", *passage, f"q{k}", *b])), (10_000 + k, "\n".join([*d, f"r{k}", *passage, f"s{k}", *e]))]
        plain[k], size[k] = rows[-2][1], n
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in c.report(docs).collect()}
    assert all(got[k].text == t for k, t in plain.items())
    left = []
    for k, n in size.items():
        r = got[10_000 + k]
        if n < N:
            assert r.text == dict(rows)[10_000 + k]
            continue
        (start, stop), = [tuple(map(int, x.split("-"))) for x in r.spans.split(",")]
        assert 31 <= start <= 31 + c.MARGIN and 31 + n - c.MARGIN <= stop <= 31 + n
        left.append(n - (stop - start))
    print("words left at both ends together, on average", sum(left) / len(left))
    assert sum(left) / len(left) < 12


def test_passages_within_a_document_and_texts_without_blanks(spark):
    rng = random.Random(5)
    par = " ".join(words(rng, 60))
    chinese = "".join(chr(0x4E00 + rng.randrange(6000)) for _ in range(400))
    data = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(4000))
    thai = "".join(chr(0x0E01 + rng.randrange(46)) for _ in range(1500))
    rows = [
        (1, "\n".join([par] * 5)), (2, f"其他文字{chinese}而且"), (3, f"开头不同{chinese}，结尾"), (4, data), (5, f"x=1;{data}"), (6, thai), (7, f"ก{thai}ข"),
    ]
    got = {r.doc_id: r.text for r in c.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == par + "\n" and got[2] == rows[1][1] and got[3].startswith("开头不同") and got[3].endswith("，结尾") and len(got[3]) < 30
    assert got[4] == data and len(got[5]) < 600 and got[6] == thai and len(got[7]) < 400


def test_insertions_move_only_the_boundaries_beside_them():
    rng = random.Random(2)
    body = words(rng, 2000)
    plain, edited = (c.Words(" ".join(w)) for w in (body, body[:1000] + ["new"] + body[1000:]))
    a, b = c.boundaries(plain), c.boundaries(edited)
    reach = c.SPREAD + c.GEAR_BYTES // 2
    assert [x for x in a if x < 1000 - reach] == [x for x in b if x < 1000 - reach]
    assert [x + 1 for x in a if x > 1000 + reach] == [x for x in b if x > 1001 + reach]
    assert max(y - x for x, y in zip(a, a[1:], strict=False)) <= c.SPREAD and 4 < 2000 / len(a) < 6
    assert len(set(c.chunks(plain)[2].tolist()) & set(c.chunks(edited)[2].tolist())) > 0.97 * len(a)
    assert c.SPREAD + 2 * c.MARGIN < c.MIN_WORDS


def test_gear_hash_rolls():
    data = bytes(random.Random(1).randrange(256) for _ in range(300))
    import numpy as np

    got, h = c.gear(np.frombuffer(data, dtype=np.uint8)).tolist(), 0
    for k in range(len(data)):
        h = sum(int(c.GEAR[data[k - j]]) << j for j in range(c.GEAR_BYTES) if k >= j) % (1 << 64)
        assert got[k] == h


def test_edges(spark):
    long = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(50))
    the = "the " * 20_000
    rows = [
        (1, long), (1, long), (2, f"x\n{long}\n\ny"), (None, long), (None, long), (3, None), (4, ""), (5, " \n"), (6, "one"), (7, the), (8, the), (9, "one"), (10, other), (10, f"z {other}"), (None, f"n1 {other}"), (None, f"n2 {other}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.text) for r in c.report(docs).collect()), key=str)
    assert len(got) == len(rows) and got.count((1, long)) == 2 and got.count((-1, "")) == 2
    kept = dict(got)
    assert kept[2].startswith("x\n") and kept[2].endswith("y") and len(kept[2].split()) <= 2 + 2 * c.MARGIN
    assert kept[7] == "the " * N and kept[8] == "" and kept[3] is None and kept[4] == "" and kept[5] == " \n" and kept[6] == kept[9] == "one"
    assert {t for d, t in got if d == 10} == {other, f"z {other}"} and sum(d == -1 and t[:2] in ("n1", "n2") and len(t.split()) <= 1 + 2 * c.MARGIN for d, t in got) == 2
    assert c.report(docs.limit(0)).count() == 0


def test_columns_with_clashing_names_keep_their_values(spark):
    long = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, long, 9), (2, f"a {long} b", 9)], "doc_id long, text string, n_chars long")
    docs = docs.selectExpr("*", "'r' repeated", "'k' known", "'d' doc", "'s' `row`", "'f' found", "'c' copy")
    got = {r.doc_id: tuple(r) for r in c.apply(docs).collect()}
    assert got[1] == (1, long, 9, *"rkdsfc") and got[2][2] == len(got[2][1]) < len(long) - 100 and got[2][3:] == tuple("rkdsfc") and c.apply(docs).columns == docs.columns


def test_how_many_stretches_are_found_by_their_length():
    """What README says of stretches of fewer words than FOUND, from which on all are found."""
    rng = random.Random(4)
    prose = lambda n: [f"w{rng.randrange(20_000)}" for _ in range(n)]
    share = {}
    for n in (30, 35, 40, 45, 51):
        hits = 0
        for _ in range(400):
            own = prose(n)
            one, other = (c.Words(" ".join([*prose(rng.randrange(60)), *own, *prose(rng.randrange(60))])) for _ in range(2))
            hits += bool(c.spans_of(other, c.chunks(one)[2], False, c.MIN_WORDS))
        share[n] = hits / 400
    print(share)
    assert share[30] < 0.1 and 0.4 < share[35] < 0.7 and share[40] > 0.88 and share[45] > 0.98 and share[51] == 1
