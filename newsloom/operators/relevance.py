"""Relevance: weighted scores, the strict cascade, additive audits. A profile holds all word lists; none is built in."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T


@dataclass
class Profile:
    """The word lists and weights of a product domain."""

    product: list[str] = field(default_factory=list)
    adulteration: list[str] = field(default_factory=list)
    action: list[str] = field(default_factory=list)
    places: list[str] = field(default_factory=list)
    country: list[str] = field(default_factory=list)
    #: Places that are the country itself and earn nothing on top.
    country_names: list[str] = field(default_factory=list)
    non_food: list[str] = field(default_factory=list)
    business: list[str] = field(default_factory=list)
    out_of_scope: list[str] = field(default_factory=list)
    other_food: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    #: Regular expressions, over lower-cased text.
    reject: list[str] = field(default_factory=list)
    strong: list[str] = field(default_factory=list)
    as_adulterant: list[str] = field(default_factory=list)
    first_date: str = "2021-01-01"
    last_date: str = "2026-12-31"

    @staticmethod
    def load(path: str) -> Profile:
        """A profile from a JSON file whose names are the fields'."""
        return Profile(**json.loads(Path(path).read_text()))


# Weight of a hit and its cap for product, adulteration and action; country, place, place cap, date;
# thresholds for relevant and maybe_relevant; score of a row without adulteration or action.
WEIGHTS = {"product": (0.25, 0.30), "adulteration": (0.20, 0.25), "action": (0.15, 0.20)}
COUNTRY, PLACE, PLACE_CAP, DATE, RELEVANT, MAYBE, NO_ACTION = 0.10, 0.05, 0.15, 0.10, 0.55, 0.25, 0.05


def any_of(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(text.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts))


def score(profile: Profile, title: Column, text: Column, url: Column, date: Column) -> Column:
    """struct(score, label, reject_reason, hits per list). Gates come first, in their order; rejects look at title and
    text only, terms at the url, too. Terms are whole words of any script, in the order of their list."""
    names = ("product", "adulteration", "action", "places", "country")

    def of_hits(corpus: Column, h: Column) -> Column:
        n = {k: F.size(h[k]) for k in names}
        weighed = sum((F.least(n[k] * F.lit(w), F.lit(cap)) for k, (w, cap) in WEIGHTS.items()), F.lit(0.0))
        elsewhere = F.size(F.filter(h["places"], lambda p: ~F.lower(p).isin([c.lower() for c in profile.country_names] or [""])))
        place = F.least(F.lit(COUNTRY) + F.when(elsewhere > 0, PLACE).otherwise(0.0), F.lit(PLACE_CAP))
        total = F.round(F.least(weighed + place + F.when(T.in_range(date, profile.first_date, profile.last_date), DATE).otherwise(0.0), F.lit(1.0)), 4)
        reason = F.when(any_of(corpus, profile.reject), "reject pattern").when(n["country"] == 0, "no country term").when(n["product"] == 0, "no product term").when(n["adulteration"] + n["action"] == 0, "no adulteration or action term")

        def decided(r: Column) -> Column:
            value = F.when(r.isNull(), total).when(r == "no adulteration or action term", NO_ACTION).otherwise(0.0)
            label = F.when(r.isNotNull() | (value < MAYBE), "irrelevant").when(value >= RELEVANT, "relevant").otherwise("maybe_relevant")
            return F.struct(value.alias("score"), label.alias("label"), r.alias("reject_reason"), *(h[k].alias(k) for k in names))

        return T.let(reason, decided)

    def of_low(low: Column) -> Column:
        hits = F.struct(*(T.terms_in_low(low["whole"], getattr(profile, k)).alias(k) for k in names))
        return T.let(hits, lambda h: of_hits(low["corpus"], h))

    return T.let(F.struct(F.lower(_joined(title, text)).alias("corpus"), F.lower(_joined(title, text, url)).alias("whole")), of_low)


def cascade(profile: Profile, title: Column, text: Column, url: Column) -> Column:
    """struct(rule_candidate, role, label, confidence, evidence, product, action, negative): the first rule that holds
    decides. Terms are whole words of any script; evidence is the text around what decided."""
    names = ("product", "non_food", "business", "out_of_scope", "other_food")
    make = lambda candidate, role, label, c: F.struct(F.lit(candidate).alias("rule_candidate"), F.lit(role).alias("role"), F.lit(label).alias("label"), F.lit(c).alias("confidence"))

    def of_hits(t: Column, h: Column) -> Column:
        any_ = {k: F.size(h[k]) > 0 for k in (*names, "action")}
        beside = lambda terms: T.term_evidence(t["clean"], t["low"], terms)
        none = F.array().cast("array<string>")

        def of_close(c: Column) -> Column:
            # Outcomes and confidences.
            rules = [
                (any_["non_food"] & ~any_["product"], make(False, "non_food_oil", "irrelevant", 0.95), beside(h["non_food"]), h["non_food"]),
                (any_of(t["low"], profile.as_adulterant), make(True, "adulterant", "irrelevant", 0.90), T.pattern_evidence(t["clean"], profile.as_adulterant), h["other_food"]),
                (any_["out_of_scope"] & ~any_["product"], make(False, "adjacent_or_unclear", "irrelevant", 0.85), beside(h["out_of_scope"]), h["out_of_scope"]),
                (any_["business"] & ~any_["action"], make(False, "adjacent_or_unclear", "irrelevant", 0.85), beside(h["business"]), h["business"]),
                (any_of(t["low"], profile.strong), make(True, "adulterated_product", "relevant", 0.94), T.pattern_evidence(t["clean"], profile.strong), none),
                ((c != "") & F.contains(t["head"], c), make(True, "adulterated_product", "relevant", 0.82), c, none),
                (c != "", make(True, "adulterated_product", "manual_review", 0.74), c, none),
                (any_["product"] & any_["action"], make(True, "adjacent_or_unclear", "manual_review", 0.55), beside(F.concat(h["product"], h["action"])), none),
                (any_["product"], make(False, "adjacent_or_unclear", "irrelevant", 0.70), beside(h["product"]), h["business"]),
                (any_["action"], make(False, "adjacent_or_unclear", "irrelevant", 0.70), beside(h["action"]), h["non_food"]),
            ]
            out = F.struct(make(False, "adjacent_or_unclear", "irrelevant", 0.80).alias("d"), F.lit("").alias("evidence"), F.concat(h["non_food"], h["business"]).alias("negative"))
            for when, value, evidence, negative in reversed(rules):
                out = F.when(when, F.struct(value.alias("d"), evidence.alias("evidence"), negative.alias("negative"))).otherwise(out)
            return T.let(out, lambda o: F.struct(*(o["d"][k].alias(k) for k in ("rule_candidate", "role", "label", "confidence")), o["evidence"].alias("evidence"), h["product"].alias("product"), h["action"].alias("action"), o["negative"].alias("negative")))

        close = T.proximity_evidence(t["clean"], profile.product, profile.adulteration + profile.action)
        return T.let(F.when(any_["product"] & any_["action"], close).otherwise(""), of_close)

    def of_text(t: Column) -> Column:
        lists = {k: getattr(profile, k) for k in names} | {"action": profile.adulteration + profile.action}
        return T.let(F.struct(*(T.terms_in_low(t["low"], v).alias(k) for k, v in lists.items())), lambda h: of_hits(t, h))

    return T.let(T.strip_markup(_joined(title, text, url)), lambda c: T.let(F.struct(c.alias("clean"), F.lower(c).alias("low"), T.strip_markup(_joined(title, url)).alias("head")), of_text))


def merge_reading(role: Column, label: Column, confidence: Column, other: Column, other_confidence: Column, evidence: Column) -> Column:
    """The rule's and a reader's label: the reader wins from 0.65 on, but over a hard exclusion it can only ask for a
    review, from 0.90 on and with evidence."""
    hard = role.isin("adulterant", "non_food_oil")
    heard = ~hard & other.isin("relevant", "irrelevant") & (other_confidence >= 0.65)
    asks = hard & (other == "relevant") & (other_confidence >= 0.90) & (F.coalesce(evidence, F.lit("")) != "")
    final = F.when(F.coalesce(heard, F.lit(False)), other).when(F.coalesce(asks, F.lit(False)), "manual_review").otherwise(label)
    sure = F.when(F.coalesce(heard, F.lit(False)), F.greatest(confidence, other_confidence)).when(F.coalesce(asks, F.lit(False)), 0.60).otherwise(confidence)
    return F.struct(final.alias("label"), F.round(sure, 3).alias("confidence"))


def audit(profile: Profile, text: Column) -> Column:
    """struct(points, decision) of the additive metadata audit."""
    low = F.concat(F.lit(" "), F.replace(F.lower(text), F.lit("-"), F.lit(" ")), F.lit(" "))
    has = {k: F.coalesce(F.greatest(*(F.contains(low, F.lit(t)) for t in getattr(profile, k)), F.lit(False), F.lit(False)), F.lit(False)) for k in ("product", "adulteration", "action", "country", "excluded", "business")}
    close = T.near(low, profile.product, profile.adulteration + profile.action)
    points = {"product": 3, "adulteration": 4, "action": 2, "country": 2, "excluded": -6, "business": -5}
    total = sum((F.when(has[k], p).otherwise(0) for k, p in points.items()), F.lit(0)) + F.when(close, 4).otherwise(0)
    clean = ~has["excluded"] & ~has["business"]
    strict = has["product"] & has["country"] & clean & close & has["adulteration"]
    maybe = has["product"] & has["country"] & ~has["excluded"] & close
    return F.struct(total.alias("points"), F.when(strict, "strict_rescue_candidate").when(maybe, "possible_review").otherwise("confirm_metadata_drop").alias("decision"))


def title_label(text: Column, products: list[str], signals: list[str]) -> Column:
    """What the padded text has: a product, a signal, both or neither."""

    def of(p: Column) -> Column:
        a, b = (F.greatest(*(F.contains(p, F.lit(f" {t} ")) for t in terms), F.lit(False), F.lit(False)) for terms in (products, signals))
        return F.when(a & b, "product_and_signal").when(a, "product_only").when(b, "signal_only").otherwise("neither")

    return T.let(T.padded(text), of)


def bucket(p: Column, high: float, low: float, names: tuple[str, str, str] = ("relevant", "review", "irrelevant")) -> Column:
    return F.when(p >= high, names[0]).when(p >= low, names[1]).otherwise(names[2])


def url_looks_relevant(url: Column, title: Column, blocked: list[str], lifestyle: list[str], signals: list[str]) -> Column:
    """Blocked patterns in url and title or lifestyle patterns in the url reject; a title of over 15 characters needs a signal."""
    both = F.lower(F.concat_ws(" ", url, title))
    return ~any_of(both, blocked) & ~any_of(F.lower(url), lifestyle) & ((F.length(F.coalesce(title, F.lit(""))) <= 15) | any_of(F.lower(title), signals))


def count_labels(df: DataFrame, label: str) -> DataFrame:
    """Rows for each label; null counts as unknown."""
    return df.groupBy(F.coalesce(F.col(label), F.lit("unknown")).alias(label)).agg(F.count("*").alias("n"))


# Points of the metadata score: an incident phrase, a product, a product in the query only, a signal, a
# signal in the query only, by query family, product and signal close; cut-offs.
METADATA = {"incident": 60, "product": 35, "query_product": 10, "signal": 35, "query_signal": 12, "close": 20}
FAMILY = {"title_only": 18, "phrase": 14, "boolean": 8, "proximity": 5}
LIKELY, REVIEW = 75, 45


def metadata_score(head: Column, family: Column, query: Column, products: list[str], signals: list[str], incidents: list[str], query_product: str, query_signals: list[str]) -> Column:
    """struct(score 0 to 100, label, priority, products, signals) of a row by its title and URL (head), the family of
    the query that found it and that query."""

    def of(t: Column) -> Column:
        hits = F.struct(*(T.terms_in_low(t["low"], v).alias(k) for k, v in (("p", products), ("s", signals), ("i", incidents))))

        def scored(h: Column) -> Column:
            some = {k: F.size(h[k]) > 0 for k in "psi"}
            asked = F.lit(False)
            for term in query_signals:
                asked = asked | F.contains(t["query"], F.lit(term))
            points = F.when(some["i"], METADATA["incident"]).when(some["p"], METADATA["product"]).when(F.contains(t["query"], F.lit(query_product)), METADATA["query_product"]).otherwise(0)
            points = points + F.when(some["s"], METADATA["signal"]).when(asked, METADATA["query_signal"]).otherwise(0)
            by_family = F.lit(0)
            for name, n in FAMILY.items():
                by_family = F.when(family == name, n).otherwise(by_family)
            close = T.proximity_evidence(t["clean"], products, signals, 80) != ""
            return T.let(F.least(points + by_family + F.when(close, METADATA["close"]).otherwise(0), F.lit(100)), lambda n: labelled(n, h, some))

        def labelled(n: Column, h: Column, some: dict[str, Column]) -> Column:
            likely = (n >= LIKELY) & (some["p"] | some["i"]) & (some["s"] | some["i"])
            label = F.when(likely, "likely_relevant").when(n >= REVIEW, "manual_review").otherwise("metadata_drop")
            priority = F.when(likely, "high").when(n >= REVIEW, "medium").otherwise("low")
            return F.struct(n.alias("score"), label.alias("label"), priority.alias("priority"), h["p"].alias("products"), h["s"].alias("signals"))

        return T.let(hits, scored)

    clean = T.strip_markup(head)
    return T.let(F.struct(clean.alias("clean"), F.lower(clean).alias("low"), T.strip_markup(query).alias("query")), of)


# Base points of a match's strength.
STRENGTH = {"strong_title_match": 100, "ghee_context_only_in_title": 70, "broad_food_safety_title": 45, "weak_or_body_only_match": 10}


def chosen(value: Column, choices: dict[str, int], default: int = 0) -> Column:
    """The number that a name stands for."""
    out = F.lit(default)
    for name, n in choices.items():
        out = F.when(value == name, n).otherwise(out)
    return out


def priority_score(label: Column, family: Column, products: Column, signals: Column, bonus: dict[str, int]) -> Column:
    """Points of a match's strength and its query's family, 3 for each product and 5 for each signal."""
    return chosen(label, STRENGTH) + chosen(family, bonus) + 3 * F.size(products) + 5 * F.size(signals)


def crawl_priority(family: Column, query_id: Column, label: Column, role: Column, candidate: Column, weak_query: str) -> Column:
    """high, medium or drop; a proximity query that is known to be weak does not raise a row."""
    kept = label != "irrelevant"
    return (
        F.when(label == "relevant", "high").when((family == "title_only") & candidate, "high").when((family == "proximity") & (query_id != weak_query) & kept, "high")
        .when(label == "manual_review", "medium").when((family == "title_only") & (role != "non_food_oil"), "medium").when(family.isin("phrase", "boolean") & kept, "medium").otherwise("drop")
    )


def query_family(method: Column, query: Column) -> Column:
    """The family that a record's discovery method names, else the one that its query's syntax shows."""
    own = F.when(F.contains(query, F.lit("article_title:")), "title_only").when(F.contains(query, F.lit("~")), "proximity").otherwise("boolean")
    return F.when(F.startswith(method, F.lit("mediacloud_")), F.substr(method, F.lit(len("mediacloud_") + 1))).otherwise(own)


def query_id(query: Column, fraud: list[str], enforcement: list[str], title_term: str, named: str) -> Column:
    """A name for a query by what stands in it; the first case that holds."""

    def any_in(q: Column, terms: list[str]) -> Column:
        out = F.lit(False)
        for t in terms:
            out = out | F.contains(q, F.lit(t))
        return out

    def of(q: Column) -> Column:
        phrase = F.when(F.contains(q, F.lit('"')), F.split_part(q, F.lit('"'), F.lit(2))).otherwise(F.left(q, F.lit(40)))
        words = F.array_join(F.filter(F.split(phrase, r"\s+"), lambda w: w != ""), "_")
        title, a, b = F.contains(q, F.lit("article_title:")), any_in(q, fraud), any_in(q, enforcement)
        return (
            F.when(title & F.contains(q, F.lit(title_term)), "title_oils_enforcement").when(title & F.contains(q, F.lit(named)), "title_named_oils_fraud").when(title, "title_core_oils_fraud")
            .when(F.contains(q, F.lit("~")), F.concat(F.lit("proximity_"), words)).when(b & ~a, "boolean_oils_enforcement_only").when(a & b, "boolean_oils_enforcement_evidence")
            .when(F.contains(q, F.lit(named)), "boolean_named_oils_fraud").otherwise("boolean_core_oils_fraud")
        )

    return T.let(F.lower(query), of)


def hard_excluded(terms: list[str], *columns: Column) -> Column:
    """Whether one of the terms stands in any of the columns as whole words."""
    return F.size(T.terms_in(_joined(*columns), terms)) > 0


def title_high_risk(title: Column, products: list[str], risks: list[str], excluded: list[str]) -> Column:
    """A product and a risk, and nothing that excludes."""
    return T.let(F.lower(F.coalesce(title, F.lit(""))), lambda low: (F.size(T.terms_in_low(low, products)) > 0) & (F.size(T.terms_in_low(low, risks)) > 0) & (F.size(T.terms_in_low(low, excluded)) == 0))


# Columns under which reviewers' marks may stand.
KEEP_COLUMNS = ["final_keep", "human_keep", "review_keep", "keep", "final_decision", "final_decisio"]
LABEL_COLUMNS = ["final_human_label", "human_label"]


def human_marked(df: DataFrame) -> Column:
    """Whether any of the reviewers' columns that df has holds a decision."""
    marks = [F.btrim(F.col(c).cast("string")).isin("0", "1") for c in KEEP_COLUMNS if c in df.columns] + [F.lower(F.btrim(F.col(c).cast("string"))).isin("relevant", "irrelevant") for c in LABEL_COLUMNS if c in df.columns]
    out = F.lit(False)
    for m in marks:
        out = out | F.coalesce(m, F.lit(False))
    return out


def audit_decision(label: Column, confidence: Column, role: Column) -> Column:
    return F.when(label.isin("relevant", "unclear") | (role == "adulterated_product") & (confidence < 0.95), "rescue_review").otherwise("confirm_reject")


def keyword_source(df: DataFrame, text: str, duplicate: Column | None = None, label: Column | None = None) -> DataFrame:
    """Rows with a text, without duplicates if they are told, relevant ones only if a label is given."""
    out = df.where(T.trimmed(F.coalesce(F.col(text), F.lit(""))) != "")
    out = out if duplicate is None else out.where(~F.coalesce(duplicate, F.lit(False)))
    return out if label is None else out.where(label == "relevant")


def prompt(title: Column, url: Column, text: Column, most: int) -> Column:
    """What a reader model is asked, with most characters of the text."""
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\nURL: "), F.coalesce(url, F.lit("")), F.lit("\nText: "), F.left(F.coalesce(text, F.lit("")), F.lit(most)))


def suspect_flags(text: Column, products: list[str], bare: str, others: list[str], reuse: str) -> Column:
    """What speaks against a row that was called relevant: reuse (a pattern), no_product or only_bare (the bare word
    without a product's name), others_dominate (three other things and one product at most)."""

    def of(low: Column) -> Column:
        def flags(h: Column) -> Column:
            none = F.size(h["p"]) == 0
            word = F.size(T.terms_in_low(low, [bare])) > 0
            return F.array_compact(F.array(F.when(low.rlike(reuse), "reuse"), F.when(none & ~word, "no_product").when(none, "only_bare"), F.when((F.size(h["o"]) >= 3) & (F.size(h["p"]) <= 1), "others_dominate")))

        return T.let(F.struct(T.terms_in_low(low, products).alias("p"), T.terms_in_low(low, others).alias("o")), flags)

    return T.let(F.lower(F.coalesce(text, F.lit(""))), of)
