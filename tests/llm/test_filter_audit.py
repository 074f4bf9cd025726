import re
from itertools import permutations

from newsloom.llm import filter_audit


def brute(docs, labels):
    """Each order is walked row by row."""
    texts = [(i, s or "", t or "") for i, s, t in docs]

    def fails(f, i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        earlier = any(t == u and (j is not None and (i is None or j < i)) for j, _, u in texts)
        return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": earlier}[f]

    marks = [{f: fails(f, i, t) for f in "ABCDE"} for i, _, t in texts]
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    out = []
    for part in {s for _, s, _ in texts}:
        own = [k for k, x in enumerate(texts) if x[1] == part]
        shapley, lines = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if marks[k][f]]
                left = [k for k in left if not marks[k][f]]
                shapley[f] += len(gone)
                all_ = [k for k in own if marks[k][f]]
                lines.append((part, "".join(order), step, len(left), len(gone), len(all_) - len(gone), sum(sum(marks[k].values()) == 1 for k in all_), sum(texts[k][0] in good for k in gone), sum(texts[k][0] in toxic for k in gone)))
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


LONG = " ".join(f"w{k}" for k in range(250))
DOCS = [
    (1, "a", LONG), (2, "a", LONG), (2, "a", LONG), (3, "b", LONG + " $"), (4, None, LONG.upper()), (5, "", "x " * 300), (6, "a", None), (7, "b", ""), (None, "b", LONG), (None, None, None), (8, "a", " \t\n"),
    (9, "a", "É " * 500), (10, "b", "A" * 20_000 + " %"), (11, "b", ("ab cd " * 40_000) + "*"), (12, "a", LONG + "\u0085x|"), (-1, "c", LONG + " $"), (13, "a", "w " * 100 + LONG),
]
LABELS = [(1, 1, 0), (2, 1, 0), (2, 0, 1), (3, None, 1), (None, 1, 1), (7, 0, 1), (11, 1, None), (99, 1, 1)]


def test_counts_equal_a_walk_row_by_row(spark):
    docs = spark.createDataFrame([(*r, "x", True) for r in DOCS], "doc_id long, source string, text string, part string, A boolean").repartition(3)
    labels = spark.createDataFrame([(*r, 1) for r in LABELS], "doc_id long, quality int, toxic int, text int")
    assert sorted(map(tuple, filter_audit.report(docs, labels).collect())) == brute(DOCS, LABELS)
    none = filter_audit.report(docs.limit(0), labels)
    assert none.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert none.count() == 0
    assert filter_audit.report(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_states_are_shared():
    walked = filter_audit.states("ABCDE")
    assert len(walked) == 32
    assert len(set(map(frozenset, walked))) == 32
    # Depth first: each state but the root comes after the one that it is filtered from, which is then persisted.
    open_ = []
    for s in walked:
        while open_ and not s.startswith(open_[-1]):
            open_.pop()
        assert not s or open_[-1] == s[:-1]
        open_.append(s)


def test_nothing_stays_persisted(spark):
    docs = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    filter_audit.report(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert not spark.sparkContext._jsc.getPersistentRDDs()
