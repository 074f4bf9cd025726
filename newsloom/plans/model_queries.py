"""Queries over predictions: thresholds, comparisons, ensembles, rescreening, and the classifiers themselves."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import diversity, fold_models, metrics, models, term_model, token_windows, windows
from newsloom.plans.catalogue import query
from newsloom.plans.text_queries import SCORED, scored, title
from newsloom.sources.shared import cut, shared_dir
from newsloom.sources.tables import table

SWEEP = SCORED + """, t AS (SELECT range / 100.0 AS t FROM range(5, 96)),
sw AS (SELECT t AS threshold, count(*) FILTER (quality = 1 AND score >= t) AS tp, count(*) FILTER (quality = 0 AND score >= t) AS fp, count(*) FILTER (quality = 1) AS al FROM s, t GROUP BY t),
pr AS (SELECT threshold, tp, fp, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(al, 0), 0), 9) AS recall, round(coalesce(2.0 * tp / nullif(tp + fp + al, 0), 0), 9) AS f1 FROM sw)"""


@query(SWEEP + " SELECT threshold::DOUBLE AS threshold, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pr")
def threshold_sweep(spark, sf_dir):
    """ML-10: what every threshold gives."""
    found = metrics.threshold_sweep(scored(spark, sf_dir), "quality", "score")
    return found.select("threshold", "tp", "fp", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(SWEEP + """ SELECT 'balanced' AS point, threshold::DOUBLE AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM (SELECT * FROM pr ORDER BY f1 DESC, threshold LIMIT 1)
UNION ALL SELECT 'high_recall', threshold::DOUBLE, round(precision, 6), round(recall, 6) FROM (SELECT * FROM pr WHERE precision >= 0.25 ORDER BY recall DESC, threshold LIMIT 1)
UNION ALL SELECT 'high_precision', threshold::DOUBLE, round(precision, 6), round(recall, 6) FROM (SELECT * FROM pr WHERE recall >= 0.40 ORDER BY precision DESC, threshold LIMIT 1)""")
def operating_points(spark, sf_dir):
    """ML-10: thresholds for high recall, balance and high precision."""
    points = metrics.operating_points(metrics.threshold_sweep(scored(spark, sf_dir), "quality", "score"))
    return points.select("point", "threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


#: SQL: predictions of four models: the two scores, and each for half of the languages.
PREDICTED = SCORED + """, p AS (SELECT 'tfidf_a' AS model, 'full' AS representation, doc_id, quality AS label, score AS probability FROM s UNION ALL SELECT 'emb_a', 'full', doc_id, quality, other FROM s
 UNION ALL SELECT 'tfidf_b', 'windows', doc_id, quality, CASE WHEN lang = 'en' THEN score ELSE other END FROM s UNION ALL SELECT 'hf_a', 'windows', doc_id, quality, CASE WHEN lang = 'en' THEN other ELSE score END FROM s)"""
BY = ["model", "representation"]


def predicted(spark, sf_dir) -> DataFrame:
    own, english = scored(spark, sf_dir), F.col("lang") == "en"
    shapes = [("tfidf_a", "full", F.col("score")), ("emb_a", "full", F.col("other")), ("tfidf_b", "windows", F.when(english, F.col("score")).otherwise(F.col("other"))), ("hf_a", "windows", F.when(english, F.col("other")).otherwise(F.col("score")))]
    each = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(r).alias("representation"), p.alias("probability")) for m, r, p in shapes))
    return own.select("doc_id", F.col("quality").alias("label"), F.explode(each).alias("m")).select("m.model", "m.representation", "doc_id", "label", "m.probability")


COMPARED = PREDICTED + """, c AS (SELECT model, representation, count(*) FILTER (label = 1 AND probability >= 0.5) AS tp, count(*) FILTER (label = 0 AND probability >= 0.5) AS fp, count(*) FILTER (label = 1 AND probability < 0.5) AS fn, count(*) FILTER (label = 0 AND probability < 0.5) AS tn FROM p GROUP BY ALL),
m AS (SELECT model, representation, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM c),
rk AS (SELECT model, representation, label, rank() OVER (PARTITION BY model, representation ORDER BY probability) + (count(*) OVER (PARTITION BY model, representation, probability) - 1) / 2.0 AS r FROM p),
au AS (SELECT model, representation, round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS roc_auc FROM rk GROUP BY ALL),
g AS (SELECT model, representation, probability, sum(label) AS pos, count(*) AS n FROM p GROUP BY ALL), cu AS (SELECT model, representation, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS k FROM g WINDOW w AS (PARTITION BY model, representation ORDER BY probability DESC)),
ap AS (SELECT model, representation, round(sum(pos * tp / k) / sum(pos), 6) AS average_precision FROM cu GROUP BY ALL)"""


@query(COMPARED + " SELECT * FROM m JOIN au USING (model, representation) JOIN ap USING (model, representation)")
def model_comparison(spark, sf_dir):
    """ML-08, ML-09, ML-11: all models and representations side by side, best f1 first."""
    return metrics.comparison(predicted(spark, sf_dir), BY)


@query(COMPARED + """ SELECT * FROM (SELECT 'f1' AS best, model, representation FROM m ORDER BY f1 DESC, model, representation LIMIT 1) UNION ALL SELECT * FROM (SELECT 'recall', model, representation FROM m ORDER BY recall DESC, model, representation LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'tfidf', model, representation FROM m WHERE starts_with(model, 'tfidf_') ORDER BY f1 DESC, model, representation LIMIT 1) UNION ALL SELECT * FROM (SELECT 'windows', model, representation FROM m WHERE representation = 'windows' ORDER BY f1 DESC, model, representation LIMIT 1)""")
def best_models(spark, sf_dir):
    """ML-12, ML-17: the best by f1 and by recall, and the best of a family and of a representation."""
    held = cut(metrics.comparison(predicted(spark, sf_dir), BY))
    picks = [("f1", "f1", None), ("recall", "recall", None), ("tfidf", "f1", F.startswith("model", F.lit("tfidf_"))), ("windows", "f1", F.col("representation") == "windows")]
    return reduce(DataFrame.unionByName, [metrics.best_by(held, BY, metric, fit).select(F.lit(name).alias("best"), *BY) for name, metric, fit in picks])


@query(PREDICTED + " SELECT model, doc_id, CASE WHEN label = 0 THEN 'false_positive' ELSE 'false_negative' END AS kind FROM p WHERE (label = 1) <> (probability >= 0.5)")
def model_errors(spark, sf_dir):
    """ML-13: what each model gets wrong."""
    return metrics.errors(predicted(spark, sf_dir)).select("model", "doc_id", "kind")


GRID = SCORED + """, w AS (SELECT row_number() OVER () - 1 AS g, a, b FROM (SELECT a, b FROM (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]) AS a) , (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]) AS b) ORDER BY a, b)),
v AS (SELECT g, a, b, quality, round(a::DOUBLE / (a + b)::DOUBLE * score + b::DOUBLE / (a + b)::DOUBLE * other, 9) >= 0.5 AS hit FROM s, w),
c AS (SELECT g, a, b, count(*) FILTER (quality = 1 AND hit) AS tp, count(*) FILTER (quality = 0 AND hit) AS fp, count(*) FILTER (quality = 1 AND NOT hit) AS fn FROM v GROUP BY ALL)"""


@query(GRID + " SELECT a || ':' || b AS weights, tp, fp, fn, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM c")
def ensemble_grid(spark, sf_dir):
    """ML-16: every weighting of two models."""
    return metrics.ensemble_grid(scored(spark, sf_dir), "quality", ["score", "other"]).select("weights", "tp", "fp", "fn", "f1")


@query(GRID + " SELECT a || ':' || b AS weights, tp, fp, fn FROM c ORDER BY coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) DESC, g LIMIT 1")
def ensemble_best(spark, sf_dir):
    """ML-16: the first weighting with the best f1."""
    return metrics.best_weighting(metrics.ensemble_grid(scored(spark, sf_dir), "quality", ["score", "other"])).select("weights", "tp", "fp", "fn")


@query(PREDICTED + " SELECT doc_id, round(avg(probability) FILTER (model IN ('tfidf_a', 'emb_a')), 6) AS mean FROM p GROUP BY doc_id")
def ensemble_mean(spark, sf_dir):
    """ML-15: the mean of two models' scores, which both must have."""
    rows = predicted(spark, sf_dir).where(F.col("model").isin("tfidf_a", "emb_a")).select("doc_id", "label", "model", F.col("probability").alias("score"))
    return metrics.ensemble_average(rows.withColumnRenamed("model", "m").select("doc_id", "label", F.col("m").alias("model"), "score"), "doc_id", "label", ["tfidf_a", "emb_a"]).select("doc_id", F.round("mean", 6).alias("mean"))


@query(SCORED + " SELECT doc_id, round(0.17 * score + 0.83 * other, 4) AS blended, CASE WHEN round(0.17 * score + 0.83 * other, 4) >= 0.84 THEN 'relevant' WHEN round(0.17 * score + 0.83 * other, 4) >= 0.05 THEN 'review' ELSE 'irrelevant' END AS bucket FROM s")
def blended_scores(spark, sf_dir):
    """ML-22, PRJ-04: a weighted blend of models and its bucket."""
    p = scored(spark, sf_dir).withColumn("blended", metrics.blend({"score": 0.17, "other": 0.83}))
    return p.select("doc_id", "blended", F.when(F.col("blended") >= 0.84, "relevant").when(F.col("blended") >= 0.05, "review").otherwise("irrelevant").alias("bucket"))


@query(SCORED + ", b AS (SELECT doc_id, CASE WHEN score >= 0.8 THEN 'candidate_relevant' WHEN score >= 0.2 THEN 'manual_review' ELSE 'candidate_irrelevant' END AS review_bucket FROM s) SELECT doc_id, review_bucket, review_bucket = 'candidate_irrelevant' AND row_number() OVER (PARTITION BY review_bucket ORDER BY md5('42-' || doc_id), doc_id) <= 20 AS audited FROM b")
def rescreened(spark, sf_dir):
    """ML-21: rejected rows by a model's score: to review, uncertain, and a seeded sample of the rest."""
    return metrics.rescreened(scored(spark, sf_dir).select("doc_id", "score"), "doc_id", "score", 0.8, 0.2).select("doc_id", "review_bucket", "audited")


def labelled_texts(spark, sf_dir) -> DataFrame:
    """Whole texts: a representation of their beginnings is title_and_body's default, and not these queries'."""
    docs = table(spark, sf_dir, "documents").select("doc_id", windows.title_and_body(title(), F.col("text"), None).alias("text"))
    docs = models.checked(scored(spark, sf_dir).select("doc_id", "quality").join(docs, "doc_id"), "text", "quality")
    return docs.withColumn("grams", models.character_grams(F.col("text")))


@query()
def bench_classifiers(spark, sf_dir):
    """ML-01..ML-08, ML-11, ML-20: out-of-fold metrics of five folds of logistic regression and calibrated linear machines
    over texts (words, pairs of words and runs of characters, counts damped) and of these and a kernel machine, by random
    Fourier features, over vectors, side by side."""
    # Runs of characters are made where they are counted: they are many times the text.
    docs = models.balanced(labelled_texts(spark, sf_dir).drop("grams"), "quality")
    vecs = models.balanced(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.col("label") % 2).alias("quality"), "embedding"), "quality")
    spaces = {
        ("tfidf", "full"): (docs, ["logreg", "linsvm"], lambda rows: fold_models.of_terms(docs, "doc_id", rows, term_model.terms_of(F.col("text"), models.character_grams(F.col("text"))))),
        ("emb", "vector"): (vecs, ["logreg", "linsvm", "rbfsvm"], lambda rows: fold_models.of_vectors(vecs, "doc_id", rows, "embedding")),
    }
    found = []
    for (shape, representation), (df, kinds, space) in spaces.items():
        rows = fold_models.rows_of(df, "doc_id", "quality")
        got = fold_models.told(rows, fold_models.out_of_fold(rows, kinds, space(rows)), "doc_id")
        found.append(got.select(F.concat(F.lit(f"{shape}_"), "kind").alias("model"), F.lit(representation).alias("representation"), "doc_id", "label", "probability"))
    return metrics.comparison(cut(reduce(DataFrame.unionByName, found)), BY)


@query()
def feature_weights(spark, sf_dir):
    """ML-14: the 30 features that speak most for and against quality, by name."""
    # Runs of characters are made where they are counted: they are many times the text.
    docs = models.balanced(labelled_texts(spark, sf_dir).drop("grams"), "quality")
    terms = term_model.terms_of(F.col("text"), models.character_grams(F.col("text")))
    return term_model.fit(docs, "doc_id", "quality", terms).top(docs, terms, 30)


@query()
def rescreened_by_model(spark, sf_dir):
    """ML-21, SNK-13: all documents scored by a model that was fitted on the labelled ones, saved and loaded, in buckets."""
    rows = lambda: models.balanced(labelled_texts(spark, sf_dir).drop("grams"), "quality")
    terms = term_model.terms_of(F.col("text"))
    made = models.kept(spark, f"{shared_dir(spark)}/models-{uuid.uuid4().hex}", "logreg-1", lambda: term_model.fit(rows(), "doc_id", "quality", terms))
    docs = table(spark, sf_dir, "documents").select("doc_id", windows.title_and_body(title(), F.col("text"), None).alias("text"))
    scores = made.probability(docs, "doc_id", terms)
    return metrics.rescreened(scores, "doc_id", "probability", 0.8, 0.2).select("doc_id", F.round("probability", 6).alias("probability"), "review_bucket", "audited")


MARGINAL = """WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL) GROUP BY label), r AS MATERIALIZED (SELECT vec_id, label, v, list_cosine_similarity(v, c) AS rel FROM e JOIN c USING (label)),
s AS (SELECT label, 1 AS place, max_by(vec_id, rel) AS vec_id, max(rel) AS rel, max(rel) AS score, [max_by(vec_id, rel)] AS ids, [max_by(v, rel)] AS vs FROM r GROUP BY label
  UNION ALL
  SELECT label, place + 1, max_by(vec_id, score), max_by(rel, score), max(score), list_append(any_value(ids), max_by(vec_id, score)), list_append(any_value(vs), max_by(v, score))
  FROM (SELECT s.label, place, ids, vs, r.vec_id, r.rel, r.v, 0.3 * r.rel - 0.7 * list_max(list_transform(vs, lambda w: list_cosine_similarity(r.v, w))) AS score FROM s JOIN r USING (label) WHERE place < 20 AND NOT list_contains(ids, r.vec_id)) GROUP BY label, place)
SELECT label, vec_id, place, round(rel, 6) AS relevance, round(score, 6) AS score FROM s"""


@query(MARGINAL)
def marginal_relevance(spark, sf_dir):
    """TXT-27: of each label 20 vectors near its centre and unlike each other, with a diversity of 0.7."""
    found = diversity.mmr(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 20, 0.7)
    return found.select("label", "vec_id", "place", F.round("relevance", 6).alias("relevance"), F.round("score", 6).alias("score"))


@query()
def document_windows(spark, sf_dir):
    """ML-18: all documents in windows of 512 tokens; that windows are the text is tested against the tokenizer."""
    found = token_windows.token_windows(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("doc").alias("doc_id"), "place", "first", "last", "n_tokens", F.md5("text").alias("text"))


@query("""WITH x AS (SELECT label, 1 + vec_id % 5 AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT label, dim, round(sum(w * x) / sum(w), 4) AS mean, round(max(x), 4) AS max FROM x GROUP BY ALL""")
def weighted_pool(spark, sf_dir):
    """ML-18: vectors pooled by weight; labels stand for documents and vectors for their windows."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"), (1 + F.col("vec_id") % 5).alias("w"))
    each = token_windows.pooled_by_weight(rows, "label", "v", "w").select("label", F.posexplode(F.arrays_zip("mean", "max")).alias("dim", "z"))
    return each.select("label", F.col("dim").cast("long").alias("dim"), F.round("z.mean", 4).alias("mean"), F.round("z.max", 4).alias("max"))
