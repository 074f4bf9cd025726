"""One key that holds most rows: the joins that meet it are split."""

import pytest
from pyspark.sql import functions as F

from newsloom.operators import duplicates, keywords
from newsloom.plans import catalogue

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
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_word_of_every_document(low):
    tf = low.range(6000).select(F.col("id").alias("doc"), F.explode(F.array(F.lit("the"), F.concat(F.lit("w"), (F.col("id") % 3000).cast("string")))).alias("term"), F.lit(1).cast("long").alias("tf")).repartition(8)
    assert "skew=true" in plan_of(keywords.tfidf_of(tf, "doc", 6000))


def test_a_text_of_many_copies(low, tmp_path):
    low.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text")).repartition(8).write.parquet(f"file://{tmp_path}/documents.parquet")
    for query in ("dup_flag_all", "dup_exact_hash"):
        assert "skew=true" in plan_of(catalogue.QUERIES[query](low, f"file://{tmp_path}"))


def test_a_shingle_of_every_text(low):
    df = low.range(3000).select(F.col("id").alias("r"), F.concat_ws(" ", F.lit("a b c"), F.expr("transform(sequence(1, 20), k -> cast(hash(id, k) % 7 as string))")).alias("t"))
    assert duplicates.near_index(df, "r", F.col("t")).count() == 3000
