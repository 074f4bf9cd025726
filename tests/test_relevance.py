"""Scores and cascades on rows by hand, with terms of other scripts, hyphens and dates."""

from pyspark.sql import functions as F

from newsloom.operators import relevance as r

P = r.Profile(
    product=["mustard oil", "oil", "तेल"], adulteration=["adulterated", "fake"], action=["seized", "raid"], places=["India", "Gujarat", "Punjab"], country=["india", "gujarat", "punjab"], country_names=["india", "indian"],
    non_food=["crude"], business=["price hike"], out_of_scope=["vanaspati"], other_food=["milk"], reject=[r"how to cook"], strong=[r"fake oil (?:was )?sold"], as_adulterant=[r"milk .{0,30}mixed with .{0,10}oil"],
)


def run(spark, f, rows, *columns):
    df = spark.createDataFrame(rows, "title string, text string, url string, day string")
    return df.select(f(P, *(F.col(c) for c in columns)).alias("r")).select("r.*").collect()


def test_scores(spark):
    rows = [
        ("Fake mustard oil seized", "A raid in Gujarat.", "", "2024-05-01T10:00"),
        ("Fake mustard oil seized", "A raid in Gujarat.", "", "2019-05-01"),
        ("Mustard-oil faked", "in india", "", None),
        ("Palm-oil", "adulterated, India", "", None),
        ("नकली तेल", "fake, punjab", "", None),
        ("How to cook", "fake oil in India", "", None),
        ("x", "fake oil", "https://a.in/india/x", None),
        ("x", "fake oil", "", None),
        (None, "oil in India", None, None),
        ("turmoil", "fake india", "", None),
    ]
    got = [(round(x.score, 4), x.label, x.reject_reason) for x in run(spark, r.score, rows, "title", "text", "url", "day")]
    # two products .30, fake .20, seized and raid .20, Gujarat .15, date .10
    assert got[0] == (0.95, "relevant", None) and got[1] == (0.85, "relevant", None)
    assert got[2] == (0.05, "irrelevant", "no adulteration or action term")
    # oil .25, adulterated .20, India alone .10
    assert got[3] == (0.55, "relevant", None) and got[4] == (0.6, "relevant", None)
    assert got[5] == (0.0, "irrelevant", "reject pattern") and got[6] == (0.55, "relevant", None) and got[7] == (0.0, "irrelevant", "no country term")
    assert got[8] == (0.05, "irrelevant", "no adulteration or action term") and got[9] == (0.0, "irrelevant", "no product term")
    assert run(spark, r.score, rows[:1], "title", "text", "url", "day")[0].product == ["mustard oil", "oil"]


def test_cascade(spark):
    far = " and so on" * 30
    rows = [
        ("Crude prices", "up", "", None), ("t", "milk was mixed with oil", "", None), ("t", "vanaspati only", "", None), ("t", "oil price hike", "", None), ("t", "fake oil was sold here", "", None),
        ("Fake oil tins", "in town", "", None), ("t", f"<p>the oil&nbsp;was seized</p>{far}", "", None), ("t", f"oil {far} raid", "", None), ("t", "some oil", "", None), ("t", "a raid", "", None), ("t", "nothing", "", None),
        ("oil faked", "t", "", None), ("Fake oil", f"tins{far}", "", None),
    ]
    got = run(spark, r.cascade, rows, "title", "text", "url")
    want = [
        ("non_food_oil", "irrelevant", 0.95), ("adulterant", "irrelevant", 0.90), ("adjacent_or_unclear", "irrelevant", 0.85), ("adjacent_or_unclear", "irrelevant", 0.85), ("adulterated_product", "relevant", 0.94),
        ("adulterated_product", "manual_review", 0.74), ("adulterated_product", "manual_review", 0.74), ("adjacent_or_unclear", "manual_review", 0.55), ("adjacent_or_unclear", "irrelevant", 0.70), ("adjacent_or_unclear", "irrelevant", 0.70),
        ("adjacent_or_unclear", "irrelevant", 0.80), ("adjacent_or_unclear", "irrelevant", 0.70), ("adulterated_product", "manual_review", 0.74),
    ]
    assert [(x.role, x.label, x.confidence) for x in got] == want
    assert got[0].evidence == "Crude prices up" and got[1].evidence == "t milk was mixed with oil" and got[1].negative == ["milk"] and got[5].evidence == "Fake oil tins in town" and got[10].evidence == ""
    # The evidence stands whole in title and URL.
    sure = run(spark, r.cascade, [("Fake oil tins", "", "http://a.in", None)], "title", "text", "url")[0]
    assert (sure.label, sure.confidence, sure.evidence) == ("relevant", 0.82, "Fake oil tins http://a.in")
