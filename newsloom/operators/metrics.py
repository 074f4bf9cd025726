"""Classifier metrics, thresholds, folds and ensembles as relational plans."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, label: Column, guess: Column, by: list[str] = ()) -> DataFrame:
    """tp, fp, fn, tn and accuracy, precision, recall, f1; a quotient by 0 is 0."""
    n = df.groupBy(*by).agg(F.count_if((label == 1) & (guess == 1)).alias("tp"), F.count_if((label == 0) & (guess == 1)).alias("fp"), F.count_if((label == 1) & (guess == 0)).alias("fn"), F.count_if((label == 0) & (guess == 0)).alias("tn"))
    p, r = safe(F.col("tp"), F.col("tp") + F.col("fp")), safe(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.select("*", F.round(safe(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 4).alias("accuracy"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(safe(2 * p * r, p + r), 4).alias("f1"))


def threshold_sweep(df: DataFrame, label: str, score: str) -> DataFrame:
    """f1 for thresholds .05, .06, ... .95. Scores are folded to the highest threshold that they reach first, so the
    sweep is one aggregation and running sums over 92 steps."""
    step = F.greatest(F.lit(4), F.least(F.lit(95), F.floor(F.col(score) * 100 + 1e-9))).cast("int")
    held = df.groupBy(step.alias("t")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    steps = df.sparkSession.range(4, 96).select(F.col("id").cast("int").alias("t")).join(held, "t", "left").fillna(0)
    above = Window.orderBy(F.desc("t"))  # 92 rows
    sums = steps.select("t", F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("fp"), F.sum("p").over(Window.partitionBy()).alias("all"))
    p, r = safe(F.col("tp"), F.col("tp") + F.col("fp")), safe(F.col("tp"), F.col("all"))
    return sums.where("t >= 5").select((F.col("t") / 100).alias("threshold"), "tp", "fp", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(safe(2 * p * r, p + r), 9).alias("f1"))


# Precision that high recall asks for, recall that high precision asks for, thresholds where none has them.
LEAST_PRECISION, LEAST_RECALL, DEFAULTS = 0.25, 0.40, {"high_recall": 0.3, "balanced": 0.5, "high_precision": 0.7}


def operating_points(sweep: DataFrame) -> DataFrame:
    """(point, threshold, precision, recall, f1): the best f1, the best recall with enough precision and the best
    precision with enough recall; of equals the lowest threshold, a default where no threshold is fit."""
    points = {"high_recall": ("recall", F.col("precision") >= LEAST_PRECISION), "balanced": ("f1", F.lit(True)), "high_precision": ("precision", F.col("recall") >= LEAST_RECALL)}
    best = [F.max_by(F.when(fit, F.struct("threshold", "precision", "recall", "f1")), F.when(fit, F.struct(F.col(c), -F.col("threshold")))).alias(name) for name, (c, fit) in points.items()]
    none = {k: F.struct(F.lit(v).alias("threshold"), *(F.lit(0.0).alias(c) for c in ("precision", "recall", "f1"))) for k, v in DEFAULTS.items()}
    one = sweep.agg(*best).select(F.array(*(F.struct(F.lit(k).alias("point"), F.coalesce(k, none[k]).alias("at")) for k in points)).alias("p"))
    return one.select(F.explode("p").alias("p")).select("p.point", "p.at.*")


#: Slices of the score axis; sums over all slices before one are a table of this size.
SLICES = 4096


def running(held: DataFrame, columns: list[str], descending: bool, by: list[str] = ()) -> DataFrame:
    """held (by, s, columns) with before_<column>: its sum over all rows of the same by with a smaller s (a larger one,
    if descending).

    Sums over whole slices of the axis come from a small table, so no task holds more than a slice. by names models."""
    slice_ = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s"))) * SLICES)
    sliced = held.withColumn("_b", slice_)
    key = F.desc if descending else F.asc
    totals = sliced.groupBy(*by, "_b").agg(*(F.sum(c).alias(c) for c in columns))
    whole = Window.partitionBy(*by).orderBy(key("_b")).rowsBetween(Window.unboundedPreceding, -1)  # SLICES + 1 rows
    before = totals.select(*by, "_b", *(F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(f"_{c}") for c in columns))
    own = Window.partitionBy(*by, "_b").orderBy(key("s")).rowsBetween(Window.unboundedPreceding, -1)
    out = sliced.join(F.broadcast(before), [*by, "_b"])
    return out.select(*held.columns, *((F.col(f"_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(f"before_{c}") for c in columns))


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    """The rank-sum formula with average ranks for ties."""
    held = df.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    total = running(held, ["n"], False, by).groupBy(*by).agg(F.sum(F.col("p") * (F.col("before_n") + F.col("n") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(*by, F.round(F.try_divide(F.col("u"), F.col("p") * F.col("n")), 6).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    """Sum over distinct scores, from the top, of the gain in recall times the precision."""
    held = df.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count("*").alias("n"))
    run = running(held, ["p", "n"], True, by).select(*by, "p", (F.col("before_p") + F.col("p")).alias("tp"), (F.col("before_n") + F.col("n")).alias("k"))
    return run.groupBy(*by).agg(F.round(F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("k")), F.sum("p")), 6).alias("average_precision"))


def comparison(predictions: DataFrame, by: list[str], label: str = "label", score: str = "probability", at: float = 0.5) -> DataFrame:
    """One row for each model (by), best f1 first: counts, accuracy, precision, recall, f1, roc_auc, average_precision."""
    out = confusion(predictions, F.col(label), (F.col(score) >= at).cast("int"), by)
    out = out.join(roc_auc(predictions, label, score, by), by).join(average_precision(predictions, label, score, by), by)
    return out.orderBy(F.desc("f1"), *by)


def best_by(compared: DataFrame, by: list[str], metric: str, fit: Column | None = None) -> DataFrame:
    """The row of compared with the largest metric among those that fit; of equals the first by name."""
    pool = compared if fit is None else compared.where(fit)
    return pool.orderBy(F.desc(metric), *by).limit(1)


def errors(predictions: DataFrame, label: str = "label", score: str = "probability", at: float = 0.5) -> DataFrame:
    """The rows that a model gets wrong, with kind: false_positive or false_negative."""
    guess = F.col(score) >= at
    return predictions.where(F.col(label) != guess.cast("int")).withColumn("kind", F.when(guess, "false_positive").otherwise("false_negative"))


def stratified_folds(df: DataFrame, row: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(row, label, fold): in each label, rows in the order of a hash are dealt to k folds. A rank within hash buckets
    stands in for one over the whole label, so no task holds a label."""
    h = F.md5(F.concat_ws("-", F.lit(seed), F.col(row)))
    w = Window.partitionBy(label, F.left(h, F.lit(2))).orderBy(h)
    return df.select(row, label, ((F.row_number().over(w) + F.conv(F.left(h, F.lit(2)), 16, 10).cast("int")) % k).cast("int").alias("fold"))


def ensemble_average(scores: DataFrame, row: str, label: str, models: list[str]) -> DataFrame:
    """Scores of several models side by side and their mean; rows that a model lacks raise."""
    wide = scores.groupBy(row, label).pivot("model", models).agg(F.first("score"))
    full = F.when(F.greatest(*(F.col(m).isNull() for m in models)), F.raise_error(F.lit("a model lacks a row"))).otherwise(sum((F.col(m) for m in models), F.lit(0.0)) / len(models))
    return wide.withColumn("mean", full)


# Weights that are tried for each model.
WEIGHT_STEPS = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


def ensemble_grid(wide: DataFrame, label: str, models: list[str], steps: list[float] = WEIGHT_STEPS, cut: float = 0.5) -> DataFrame:
    """f1 of every weighting of the models, normalised: (g, weights, tp, fp, fn, f1), g in the order of the grid. A few
    hundred weightings are exploded for each row and folded before the shuffle."""
    grid = [g for g in product(steps, repeat=len(models)) if sum(g)]
    ws = F.array(*(F.array(*(F.lit(w / sum(g)) for w in g)) for g in grid))
    each = wide.select(label, F.posexplode(F.transform(ws, lambda w: sum((F.get(w, F.lit(k)) * F.col(m) for k, m in enumerate(models)), F.lit(0.0)))).alias("g", "s"))
    out = confusion(each, F.col(label), (F.round("s", 9) >= cut).cast("int"), ["g"])
    named = F.array(*(F.lit(":".join(f"{w:g}" for w in g)) for g in grid))
    return out.select("g", F.get(named, F.col("g")).alias("weights"), "tp", "fp", "fn", "f1")


def best_weighting(grid: DataFrame) -> DataFrame:
    """The first weighting with the best f1, by whole counts."""
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return grid.orderBy(F.desc(F.coalesce(f1, F.lit(0.0))), "g").limit(1)


def blend(scores: dict[str, float]) -> Column:
    """The weighted sum of columns of probabilities, four digits."""
    return F.round(sum((F.col(m) * F.lit(w) for m, w in scores.items()), F.lit(0.0)), 4)


def rescreened(df: DataFrame, row: str, probability: str, high_precision: float, high_recall: float, audited: int = 20, seed: int = 42) -> DataFrame:
    """df with review_bucket, and audited: whether a row is in the seeded sample of those that the model calls irrelevant."""
    bucket = F.when(F.col(probability) >= high_precision, "candidate_relevant").when(F.col(probability) >= high_recall, "manual_review").otherwise("candidate_irrelevant")
    out = df.withColumn("review_bucket", bucket)
    drawn = out.where("review_bucket = 'candidate_irrelevant'").select(row).orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col(row))), row).limit(audited).withColumn("_drawn", F.lit(True))
    return out.join(F.broadcast(drawn), row, "left").withColumn("audited", F.coalesce("_drawn", F.lit(False))).drop("_drawn")


def pooled(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean and max of each dimension over a key's vectors."""
    each = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("mean"), F.max("x").alias("max"))
    return each.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "mean"))), lambda s: s["mean"]).alias("mean"), F.transform(F.sort_array(F.collect_list(F.struct("i", "max"))), lambda s: s["max"]).alias("max"))
