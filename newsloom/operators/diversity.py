"""Maximal marginal relevance: rows near their group's centre that are unlike each other, chosen one by one.

A row's score only falls as more rows are chosen, from the first one on. So each pass takes the best candidates of each group, chooses among
them in a task while the best of them is no worse than the last candidate was (no other row can be better then), and only
then scores all rows against what was chosen. This is the same as choosing over all rows, in few passes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.sources.shared import cut

#: Candidates of a group in a pass; chosen rows that are broadcast at most.
CANDIDATES, FEW = 256, 20_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v with length 1; a vector of zeros stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))


def centres(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centre): the mean of each group's vectors. Sums are folded by dimension before they are shuffled."""
    each = df.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))


def _choose(part: pd.DataFrame, group: str, row: str, k: int, diversity: float, candidates: int) -> pd.DataFrame:
    """The candidates of one group, of as many as a pass takes: those chosen now, in order."""
    part = part.sort_values(["score", row], ascending=[False, True], ignore_index=True)
    vectors, rel = np.stack(part["v"].to_numpy()), part["rel"].to_numpy()
    worst = part["worst"].to_numpy(dtype=float)
    score, had = part["score"].to_numpy(dtype=float).copy(), int(part["had"].iloc[0])
    # Rows that are no candidates are no better than the last one; with fewer there are none.
    floor = score[-1] if len(part) >= candidates else -np.inf
    open_, out = np.ones(len(part), dtype=bool), []
    while had + len(out) < k and open_.any():
        at = int(np.flatnonzero(open_)[np.argmax(score[open_])])
        # The first choice is by relevance alone, which says nothing of the scores that follow.
        if out and (not had or score[at] < floor or score[at] == floor > -np.inf):
            break
        out.append((part[group].iloc[at], part[row].iloc[at], had + len(out) + 1, float(rel[at]), float(score[at]), vectors[at].tolist()))
        open_[at] = False
        worst = np.fmax(worst, vectors @ vectors[at])
        score = (1 - diversity) * rel - diversity * worst
    return pd.DataFrame(out, columns=[group, row, "place", "rel", "score", "v"])


def mmr(df: DataFrame, group: str, row: str, vector: str, k: int, diversity: float = 0.7, candidates: int = CANDIDATES) -> DataFrame:
    """(group, row, place, relevance, score): of each group k rows, or all it has. place 1 is the row nearest to the
    centre; each further one has the largest (1 - diversity) * relevance - diversity * its likeness to the nearest chosen
    one. Likeness is the cosine. Rows with a null group, row or vector are left out; ties go to the smaller row."""
    rows = df.where(F.col(group).isNotNull() & F.col(row).isNotNull() & F.col(vector).isNotNull()).select(group, row, F.col(vector).cast("array<double>").alias("v"))
    near = cut(centres(rows, group, "v"))
    held = rows.join(F.broadcast(near) if near.count() <= FEW else near, group)
    state = cut(held.select(group, row, unit(F.col("v")).alias("v"), unit(F.col("centre")).alias("c")).select(group, row, "v", dot(F.col("v"), F.col("c")).alias("rel"), F.lit(None).cast("double").alias("worst"), F.lit(0).alias("had")))
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    schema = f"`{group}` {kinds[group]}, `{row}` {kinds[row]}, place int, rel double, score double, v array<double>"
    out = None
    while True:
        score = F.when(F.col("worst").isNull(), F.col("rel")).otherwise((1 - diversity) * F.col("rel") - diversity * F.col("worst"))
        # A limit within groups is taken in each partition before the shuffle, so a group of all rows is no hot key.
        best = Window.partitionBy(group).orderBy(F.desc("score"), row)
        ranked = state.where(F.col("had") < k).withColumn("score", score).withColumn("n", F.row_number().over(best)).where(F.col("n") <= candidates).drop("n")
        chosen = cut(ranked.groupBy(group).applyInPandas(lambda part: _choose(part, group, row, k, diversity, candidates), schema))
        n = chosen.count()
        if not n:
            break
        out = chosen if out is None else out.unionByName(chosen)
        told = cut(chosen.groupBy(group).agg(F.collect_list("v").alias("vs"), F.collect_list(row).alias("rs"), F.max("place").alias("place")))
        met = state.join(F.broadcast(told) if n <= FEW else told, group)
        like = F.array_max(F.transform("vs", lambda x: dot(F.col("v"), x)))
        # Groups that are done, or have no row left, go.
        state = cut(met.where((F.col("place") < k) & ~F.array_contains("rs", F.col(row))).select(group, row, "v", "rel", F.greatest("worst", like).alias("worst"), F.col("place").alias("had")))
    if out is None:
        return df.sparkSession.createDataFrame([], schema).select(group, row, "place", F.col("rel").alias("relevance"), "score")
    return out.select(group, row, "place", F.col("rel").alias("relevance"), "score")
