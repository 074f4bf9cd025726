"""Running sums over any number of rows, in an order, with no window over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.sources.shared import cut


def sums_before(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """df with a column name: the sum of value over all rows with a smaller order. Orders are distinct.

    Rows are dealt out by ranges of order; what stands before a range is a table of as many rows as there are ranges."""
    dealt = cut(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    ranges = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # ranges
    before = ranges.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(before), "_range")
    return out.withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(own), F.lit(0))).drop("_range", "_before")


#: Buckets of an axis in which a median is sought.
BUCKETS = 4096


def medians(df: DataFrame, key: str, value: str, most: int | None = None) -> DataFrame:
    """(key, median) of whole numbers from 0 on, exact: counts by bucket tell in which one the middle lies, and only that
    bucket's values are ordered. So no task holds a key's values, however many there are; equal values are folded. most: a
    bound of values where a key has each but once and df is a table that may be read again: nothing is kept then."""
    held = cut(df.groupBy(key, value).agg(F.count("*").alias("_n"))) if most is None else df.select(key, value, F.lit(1).alias("_n"))
    width = max((held.agg(F.max(value)).first()[0] or 0) if most is None else most, 0) // BUCKETS + 1
    bucketed = held.withColumn("_b", F.floor(F.col(value) / width))
    upto = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)  # BUCKETS rows
    whole = Window.partitionBy(key)
    sums = bucketed.groupBy(key, "_b").agg(F.sum("_n").alias("_n"))
    sums = sums.select(key, "_b", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), "_n", F.sum("_n").over(whole).alias("_all"))
    # The two ranks in the middle, from 0; one and the same for an odd number.
    ranks = F.array_distinct(F.array(F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)))
    asked = sums.select(key, "_b", "_before", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n"))).alias("_ranks")).where(F.size("_ranks") > 0)
    within = Window.partitionBy(key, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    near = bucketed.join(cut(asked), [key, "_b"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(within))
    met = near.select(key, value, F.size(F.filter("_ranks", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n")))).alias("_hits")).where("_hits > 0")
    return met.groupBy(key).agg((F.sum(F.col(value) * F.col("_hits")) / F.sum("_hits")).alias("median"))
