"""Models read whole texts, however long."""

from pyspark.sql import functions as F

from newsloom.operators import term_model
from newsloom.plans import model_queries

TABLES = "/root/testdata/sf0.01"


def longest(df):
    return df.agg(F.max(F.length("text"))).first()[0]


def test_labelled_texts_are_whole(spark):
    got = model_queries.labelled_texts(spark, TABLES).select("doc_id", "text")
    whole = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", F.col("text").alias("body")).join(got, "doc_id")
    assert longest(got) > 15_000
    assert whole.where(~F.endswith("text", F.btrim("body"))).count() == 0


def test_rescreened_texts_are_whole(spark, monkeypatch):
    """Both the texts that the model is fitted on and those that it scores."""
    seen, fit, probability = [], term_model.fit, term_model.TermModel.probability
    monkeypatch.setattr(term_model, "fit", lambda df, *a: seen.append(longest(df)) or fit(df, *a))
    monkeypatch.setattr(term_model.TermModel, "probability", lambda self, df, *a: seen.append(longest(df)) or probability(self, df, *a))
    assert model_queries.rescreened_by_model(spark, TABLES).count() == 1000
    assert len(seen) == 2 and min(seen) > 15_000
