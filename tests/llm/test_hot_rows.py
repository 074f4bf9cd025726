"""One key that holds most rows: the joins that meet it are split."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.llm import chunk_dedup, near_texts, warc

LOW = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12"}


@pytest.fixture
def low(spark):
    before = {k: spark.conf.get(k, None) for k in LOW}
    for k, v in LOW.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def plan_of(df):
    """The final plan, after it has run."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def prose(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_a_hot_payload(low):
    rng = random.Random(1)
    page = "<p>" + prose(rng, 300)
    pages = low.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 2 == 0, page).otherwise(F.concat(F.lit(page), F.col("id").cast("string"))).alias("html")).repartition(8)
    assert "skew=true" in plan_of(warc.with_types(pages))


def test_a_hot_chunk(low):
    rng = random.Random(2)
    hot = prose(rng, 80)
    docs = low.createDataFrame([(k, f"{hot} {prose(rng, 40)}") for k in range(3000)], "doc_id long, text string").repartition(8)
    found = chunk_dedup.marks(docs, chunk_dedup.MIN_WORDS)
    assert "skew=true" in plan_of(found)
    assert found.count() == 2999


def test_a_hot_group_of_sets(low):
    sets = low.range(4000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).alias("grp"), F.col("id").alias("key"), F.expr("cast(sha2(cast(id as string), 256) as binary)").alias("words")).repartition(8)
    links = near_texts.near_links(sets)
    assert "skew=true" in plan_of(links)
