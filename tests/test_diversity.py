"""Marginal relevance against choosing over all rows."""

import numpy as np

from newsloom.operators import diversity as d


def brute(rows, k, diversity=0.7):
    out = []
    for g in sorted({r[1] for r in rows}):
        own = sorted((r[0], np.array(r[2], dtype=float)) for r in rows if r[1] == g)
        unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
        centre = unit(np.mean([v for _, v in own], axis=0))
        left, chosen = [(i, unit(v)) for i, v in own], []
        while left and len(chosen) < k:
            score = lambda r: (1 - diversity) * (r[1] @ centre) - diversity * max(r[1] @ c for _, c in chosen) if chosen else r[1] @ centre  # noqa: E731, B023
            best = max(left, key=lambda r: (round(score(r), 12), -r[0]))
            out.append((g, best[0], len(chosen) + 1, round(float(best[1] @ centre), 6), round(float(score(best)), 6)))
            chosen.append(best)
            left = [r for r in left if r[0] != best[0]]
    return out


def test_choice_is_that_over_all_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "hot" if k % 3 else f"g{k % 5}", rng.normal(size=6).round(3).tolist()) for k in range(900)] + [(2000, "one", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (2001, "nought", [0.0] * 6)]
    df = spark.createDataFrame([(*r, 1, "v") for r in rows] + [(5000, None, [1.0] * 6, 1, "v"), (5001, "hot", None, 1, "v")], "id long, g string, vec array<double>, rel int, worst string").repartition(5)
    want = brute(rows, 12)
    for candidates in (3, 20, 256):
        got = sorted((r.g, r.id, r.place, round(r.relevance, 6), round(r.score, 6)) for r in d.mmr(df, "g", "id", "vec", 12, candidates=candidates).collect())
        assert sorted(got) == sorted(want)
    assert d.mmr(df.limit(0), "g", "id", "vec", 3).count() == 0
