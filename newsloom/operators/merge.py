"""Joins and merges of corpus tables. Every look-up says which of several rows of a key it takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _no_key(keys: list[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.col(k).isNull()
    return out


def _one_of_each(df: DataFrame, keys: list[str], chosen: Column) -> DataFrame:
    """The chosen row of each key, pre-aggregated before the shuffle; rows whose keys are null stay all and go nowhere."""
    keyed = df.where(~_no_key(keys)).groupBy(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys))).agg(chosen.alias("_row")).select("_row.*")
    return keyed.unionByName(df.where(_no_key(keys)))


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given, ascending order; rows whose keys are null stay all."""
    return _one_of_each(df, keys, F.min_by(F.struct("*"), F.struct(*order)))


def keep_last(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key: what a dictionary that is filled in this order holds."""
    return _one_of_each(df, keys, F.max_by(F.struct("*"), F.struct(*order)))


def duplicates_of_first(df: DataFrame, keys: list[str], *order: Column) -> tuple[DataFrame, DataFrame]:
    """(first rows, the others with their key's first row beside them as first.*). Rows whose keys are null are firsts.
    The order tells all rows of a key apart."""
    first = keep_first(df, keys, *order)
    beside = first.where(~_no_key(keys)).select(*keys, F.struct(*[F.col(c) for c in df.columns]).alias("first"), F.struct(*order).alias("_first"))
    rest = df.join(beside, keys).where(F.struct(*order) != F.col("_first")).drop("_first")
    return first, rest


def look_up(df: DataFrame, table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A left join; table has a row for each key at most."""
    return df.join(table.select(*keys, *columns), keys, "left")


def seen_keys(tables: list[DataFrame], keys: list[Column]) -> DataFrame:
    """All keys of all tables, each under any of its forms: one column, key."""
    each = [t.select(F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key")) for t in tables]
    out = each[0]
    for t in each[1:]:
        out = out.unionByName(t)
    return out.where("key <> ''").distinct()


def split_seen(df: DataFrame, seen: DataFrame, row_id: str, keys: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(new rows, rows one of whose keys has been seen). An OR over keys as one equi-join over exploded keys."""
    exploded = df.select(row_id, F.explode(F.array_compact(F.array(*keys))).alias("key"))
    known = exploded.join(seen, "key", "left_semi").select(row_id).distinct()
    return df.join(known, row_id, "left_anti"), df.join(known, row_id, "left_semi")


def insert_new(base: DataFrame, batch: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """base and those rows of batch whose key is not there yet, the first of each; nothing is overwritten."""
    fresh = keep_first(batch, keys, *order).join(base.select(*keys), keys, "left_anti")
    return base.unionByName(fresh, allowMissingColumns=True)


def upsert_latest(base: DataFrame, batch: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Batch rows replace rows of their key; of several the last wins."""
    return base.join(batch.select(*keys), keys, "left_anti").unionByName(keep_last(batch, keys, *order), allowMissingColumns=True)


def patch(base: DataFrame, update: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns of base replaced where update has the key and a value."""
    other = update.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    out = base.join(other, keys, "left")
    return out.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))


def delete_keys(base: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return base.join(keys, on, "left_anti")


def plan_against_actual(plan: DataFrame, actual: DataFrame, key: str, count: str) -> DataFrame:
    """Planned keys that nothing met have 0, keys that were not planned are marked."""
    both = plan.withColumn("_p", F.lit(True)).join(actual, key, "full_outer")
    return both.withColumn(count, F.coalesce(F.col(count), F.lit(0).cast("long"))).withColumn("in_plan", F.coalesce(F.col("_p"), F.lit(False))).drop("_p")


def merge_labels(votes: DataFrame, key: str, label: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(agreed labels with their sources, conflicts with all labels)."""
    grouped = votes.where(F.col(label).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(label)).alias("labels"), F.array_join(F.sort_array(F.collect_set(source)), "; ").alias("sources"))
    agreed = grouped.where(F.size("labels") == 1).select(key, F.get("labels", F.lit(0)).alias(label), "sources")
    return agreed, grouped.where(F.size("labels") > 1)


def resolve(conflicts: DataFrame, decisions: DataFrame, key: str, label: str) -> DataFrame:
    """Conflicts with their decision; a decision that is none of the labels, or two decisions for a key, raise."""
    once = decisions.groupBy(key).agg(F.collect_set(label).alias("_d"))
    once = once.select(key, F.when(F.size("_d") == 1, F.get("_d", F.lit(0))).otherwise(F.raise_error(F.lit("contradictory decisions"))).alias("_d"))
    out = conflicts.join(once, key, "left")
    fits = F.col("_d").isNull() | F.array_contains("labels", F.col("_d"))
    return out.withColumn(label, F.when(fits, F.col("_d")).otherwise(F.raise_error(F.lit("a decision that is no label")))).drop("_d")


def strict_look_up(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """A look-up that raises where a key has no row."""
    out = df.join(table.withColumn("_hit", F.lit(True)), key, "left")
    return out.withColumn(key, F.when(F.col("_hit"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string"))))).drop("_hit")


def fallback_join(df: DataFrame, table: DataFrame, steps: list[tuple[Column, Column]], value: str, order: str) -> DataFrame:
    """value by the first step whose keys meet, for each row; of several rows of a key the first in order."""
    out = df
    for k, (left, right) in enumerate(steps):
        own = table.select(right.alias(f"_k{k}"), F.col(order).alias("_o"), F.col(value).alias(f"_v{k}")).where(f"_k{k} is not null and _k{k} <> ''")
        own = own.groupBy(f"_k{k}").agg(F.min_by(f"_v{k}", "_o").alias(f"_v{k}"))
        out = out.join(own, left == F.col(f"_k{k}"), "left").drop(f"_k{k}")
    names = [f"_v{k}" for k in range(len(steps))]
    return out.withColumn(value, F.coalesce(*names)).drop(*names)



def overlay_labels(base: DataFrame, override: DataFrame, key: str, label: str, source: str, name: str) -> DataFrame:
    """base with the label that override has for its key, if it has the key at all (the last one of it, also an empty
    one), and from it final_label and review_status; a label that came from override adds name to the source."""
    last = override.where(F.btrim(key) != "").groupBy(F.btrim(F.col(key)).alias("_k")).agg(F.max_by(F.coalesce(label, F.lit("")), "position").alias("_label"))
    out = base.join(last, F.btrim(base[key]) == F.col("_k"), "left")
    keep = F.coalesce("_label", F.when(F.col("_k").isNull(), F.coalesce(F.col(label), F.lit(""))), F.lit(""))
    final = F.when(keep == "1", "relevant").when(keep == "0", "irrelevant").otherwise("")
    added = F.when(F.col("_k").isNotNull() & (keep != ""), F.regexp_replace(F.concat_ws("; ", F.coalesce(F.col(source), F.lit("")), F.lit(name)), "^[; ]+", "")).otherwise(F.coalesce(F.col(source), F.lit("")))
    status = F.when(keep.isin("0", "1"), "human_reviewed").otherwise("needs_review")
    return out.withColumns({"final_keep": keep, "final_label": final, "review_status": status, "_source": added}).drop("_k", "_label", source).withColumnRenamed("_source", source)


def attach(base: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of other for base's key, each only where it has a value; else base's own."""
    return patch(base, other, [key], columns)
