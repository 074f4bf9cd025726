"""Quality and toxicity by hierarchical empirical Bayes.

A document's own evidence is a logistic model over the shape of its text and over words that the labels show to be
toxic; it is fitted on a bounded sample of labelled rows (SAMPLE). Around it stands a hierarchy of rates from all
labels, by grouped aggregation: the global rate, each host's and each path's. A host's rate is shrunk toward the global
one, by a prior whose strength the spread between hosts gives, and a path's toward its host's, by one that the spread
within hosts gives (method of moments), so a sparse site says little. The document model is fitted on labels too, and
what it sees in a site's documents is no news about the site: the same shrinkage of the rates that it expects is taken
off. A document's log odds are its evidence plus what its path's posterior adds beyond that expectation. Of documents
the host is source, the path lang.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import carried, cut, doc_order, let, lower_words, restored, row_key

#: Labelled rows that the document model is fitted on, at most (they bound its lexicon, too); the score and the number
#: of distinct texts from which a word, or a beginning of words, counts as toxic; ridge; odds of rejection.
SAMPLE, LEAST_Z, LEAST_TEXTS, RIDGE, CUT = 12_000, 3.0, 4, 1e-3, 0.5
#: Words whose value a worker remembers.
REMEMBERED = 200_000
#: Lengths, in characters, of the beginnings of words that are looked at, too: inflected and compound words.
STARTS = (4, 5, 6, 7, 8)
#: Sites (a host and a path, and four rates) that are broadcast at most: some 20 MB.
FEW_SITES = 100_000
#: Bounds for a prior's strength, in labels.
WEAK, STRONG = 2.0, 1000.0

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER, ALPHA, JUNK = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123), *range(128, 256)]), b"#$%&*!@^~<>{}[]\\_=+"
SHAPE = ["words", "distinct", "repeats", "upper", "alpha", "bars", "junk", "digits", "lines", "length", "same_lines", "bad", "bad_three", "bad_all", "bad_share", "bad_kinds"]
LOWER = {c: c + 32 for c in range(65, 91)}
KINDS = ("quality", "toxic")


class Values(dict):
    """Word -> its log odds or those of a beginning of it, whichever is more, 0 where neither is in the lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        get = self.lexicon.get
        value = max(get(word, 0.0), max(get(word[:c] + "*", 0.0) for c in STARTS))
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def shape(text: str | None, values: Values) -> list[float]:
    """The numbers in SHAPE for a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words, n = raw.split(), max(1, len(raw))
    k = max(1, len(words))
    kinds = set(WORD.findall(text.translate(LOWER) if not text.isascii() else text.lower())) if values.lexicon else set()
    bad = sorted(filter(None, map(values.__getitem__, kinds)), reverse=True)
    lines = raw.split(b"\n")
    less = lambda drop: (len(raw) - len(raw.translate(None, drop))) / n
    return [
        math.log(k), len(set(words)) / k / (1 + k) ** -0.1, sum(map(eq, words, words[1:])) / k, less(UPPER), less(ALPHA), raw.count(b"|") / k, less(JUNK) * n / k, less(b"0123456789"),
        len(lines) / k, len(raw) / k, 1 - len(set(lines)) / len(lines), max(bad, default=0.0), sum(bad[:3]), math.sqrt(sum(bad)), math.sqrt(sum(bad) / max(5, len(kinds))), math.log1p(len(bad)),
    ]


@dataclass
class Model:
    """What is broadcast: a few kB."""

    lexicon: dict[str, float] = field(default_factory=dict)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    #: For quality and toxicity: weights with the intercept last; None where the sample has one class only.
    weights: dict[str, np.ndarray | None] = field(default_factory=dict)

    def evidence(self, texts: pd.Series, values: Values) -> pd.DataFrame:
        """The log odds of each text, for classes of equal size; 0 where there is no model."""
        out = {}
        x = clipped(np.array([shape(t, values) for t in texts]).reshape(len(texts), -1), self.mean, self.scale) if self.mean is not None and len(texts) else None
        for kind in KINDS:
            w = self.weights.get(kind)
            out[kind] = np.zeros(len(texts)) if w is None or x is None else np.clip(x @ w[:-1] + w[-1], -30, 30)
        return pd.DataFrame(out)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray | None:
    """Weights of a ridge-penalised logistic regression by Newton's method, both classes weighed alike; None for one
    class. y are shares of the class, 0 to 1."""
    if not 0 < y.mean() < 1:
        return None
    x = np.hstack([x, np.ones((len(x), 1))])
    weigh = (y * 0.5 / y.mean() + (1 - y) * 0.5 / (1 - y.mean())) / len(y)
    y = y * 0.5 / y.mean() / len(y) / weigh  # what a share is once classes are weighed
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weigh * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(pull), x.T @ (weigh * (p - y)) + pull * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def clipped(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The document model, from at most sample labelled rows, dealt by a hash of their id.

    Copies of a text count once, with the share of each class among their labels; a text is toxic to the lexicon if at
    least half of its labels say so. So the model does not depend on how rows are dealt out or ordered."""
    chosen = labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", F.col("quality").cast("int").alias("_q"), F.col("toxic").cast("int").alias("_t"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(11)), "_q", "_t").limit(sample)
    whole = F.coalesce("text", F.lit(""))
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(whole.alias("text"), "_q", "_t")
    texts = marked.groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("h")).agg(F.first("text").alias("text"), F.avg("_q").alias("q"), F.avg("_t").alias("t"))
    texts = texts.withColumn("_t", (F.col("t") >= 0.5).cast("int"))
    texts = cut(texts.repartition(max(2, texts.sparkSession.sparkContext.defaultParallelism), "h"))
    totals = texts.agg(F.count("*").alias("n"), F.sum("_t").alias("t")).first()
    n, toxic = totals["n"], totals["t"] or 0
    if not n:
        return Model()

    def start(w: Column, c: int) -> Column:
        return F.array_distinct(F.transform(F.filter(w, lambda x: F.length(x) >= c), lambda x: F.concat(F.substring(x, 1, c), F.lit("*"))))

    def starts(w: Column) -> Column:
        return F.concat(w, *(start(w, c) for c in STARTS))

    words = texts.select("_t", F.explode(let(F.array_distinct(lower_words(F.col("text"))), starts)).alias("w")).groupBy("w").agg(F.sum("_t").alias("a"), F.count("*").alias("c")).where(F.col("a") >= LEAST_TEXTS)
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("c") - F.col("a") + 0.5) / (n - toxic + 1))
    words = words.select("w", odds.alias("odds"), (odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("c") - F.col("a") + 0.5))).alias("z")).where(F.col("z") >= LEAST_Z)
    lexicon = {r["w"]: r["odds"] for r in words.collect()}  # words of the sample's toxic texts

    @F.pandas_udf("array<double>")
    def shapes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        values = Values(lexicon)
        for part in parts:
            yield pd.Series([shape(t, values) for t in part])

    rows = texts.select("h", "q", "t", shapes("text").alias("x")).collect()  # sample rows at most, of a few numbers
    rows.sort(key=lambda r: r["h"])
    x = np.array([r["x"] for r in rows])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    x = clipped(x, mean, scale)
    return Model(lexicon, mean, scale, {"quality": logistic(x, np.array([r["q"] for r in rows])), "toxic": logistic(x, np.array([r["t"] for r in rows]))})


def moments(groups: DataFrame, rate: Column | None = None) -> float:
    """The strength of a beta prior by the method of moments: the spread of the rates of groups (n, s) around a common
    rate (or around each group's own, from all of its set: set_n, set_s) beyond what sampling makes. The driver gets a
    few sums."""
    n, own = F.col("n"), F.col("s") / F.col("n")
    centre = rate if rate is not None else F.col("set_s") / F.col("set_n")
    # A rate that is taken from the groups' own labels is nearer to them than the true one.
    taken = F.lit(0.0) if rate is not None else n / F.col("set_n")
    sums = groups.where("n > 0").agg(
        F.sum(n * F.pow(own - centre, 2)).alias("q"), F.sum((1 - taken) * centre * (1 - centre)).alias("noise"), F.sum(n * (1 - taken)).alias("room"), F.sum(n * centre * (1 - centre)).alias("v"), F.sum(n).alias("n"), F.count("*").alias("k"),
    ).first()
    if not sums["k"] or sums["k"] < 2 or sums["room"] <= 1e-9 or not sums["v"]:
        return STRONG
    between = (sums["q"] - sums["noise"]) / sums["room"]
    return STRONG if between <= 0 else min(STRONG, max(WEAK, sums["v"] / sums["n"] / between - 1))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def expected(own: Column, rate: Column) -> Column:
    """The chance that evidence for classes of equal size gives where the rate is rate."""
    return 1 / (1 + F.exp(-(own + logit(rate))))


def posteriors(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> tuple[DataFrame, dict[str, float]]:
    """(host, path, and for quality and toxic: host_, path_ and news_) for every host and path with a label, and the
    global rates. Nulls are a host and a path of their own.

    host_ and path_ are posterior rates; news_ is what path_ adds in log odds to the rate that the documents' own
    evidence (columns own_quality and own_toxic, log odds; without them 0) has one expect there.
    """
    marks = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").alias("id"), "quality", "toxic")
    own = [F.col(f"own_{k}") if f"own_{k}" in docs.columns else F.lit(0.0).alias(f"own_{k}") for k in KINDS]
    named = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.coalesce(F.col(path), F.lit("")).alias("path"), *own)
    seen = named.join(marks, "id")
    total = seen.agg(F.count("*").alias("n"), *(F.sum(k).alias(k) for k in KINDS)).first()
    # one pseudo-label of each class keeps rates off 0 and 1
    rates = {k: ((total[k] or 0) + 1) / (total["n"] + 2) for k in KINDS}
    sums = [x for k in KINDS for x in (F.sum(k).alias(f"s_{k}"), F.sum(expected(F.col(f"own_{k}"), F.lit(rates[k]))).alias(f"e_{k}"))]
    paths = cut(seen.groupBy("host", "path").agg(F.count("*").alias("n"), *sums))
    names = ["n", *(f"{x}_{k}" for k in KINDS for x in "se")]
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(f"h_{c}") for c in names))
    out, columns = paths.join(hosts, "host"), ["host", "path"]
    for k in KINDS:
        rate = F.lit(rates[k])
        over_hosts = moments(hosts.select(F.col("h_n").alias("n"), F.col(f"h_s_{k}").alias("s")), rate)
        over_paths = moments(out.select("n", F.col(f"s_{k}").alias("s"), F.col("h_n").alias("set_n"), F.col(f"h_s_{k}").alias("set_s")))

        def shrunk(kind: str, k: str = k, rate: Column = rate, over_hosts: float = over_hosts, over_paths: float = over_paths) -> tuple[Column, Column]:
            of_host = (F.col(f"h_{kind}_{k}") + over_hosts * rate) / (F.col("h_n") + over_hosts)
            return of_host, (F.col(f"{kind}_{k}") + over_paths * of_host) / (F.col("n") + over_paths)

        (of_host, of_path), (_, foreseen) = shrunk("s"), shrunk("e")
        out = out.withColumns({f"host_{k}": of_host, f"path_{k}": of_path, f"news_{k}": logit(of_path) - logit(foreseen)})
        columns += [f"host_{k}", f"path_{k}", f"news_{k}"]
    return out.select(columns), rates


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, rk (which text), p_quality, p_toxic, rejected (either is on the wrong side of CUT) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    @F.pandas_udf("quality double, toxic double")
    def evidence(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        values = Values(shared.value.lexicon)
        for part in parts:
            yield shared.value.evidence(part, values)

    # The texts are read once; what follows, twice, are a few numbers for each row.
    names = F.coalesce(F.col(host), F.lit("")), F.coalesce(F.col(path), F.lit(""))
    own = docs.select("doc_id", row_key(F.col("text")).alias("rk"), names[0].alias("host"), names[1].alias("path"), evidence(F.col("text")).alias("own"))
    own = cut(own.select("doc_id", "rk", "host", "path", *(F.col(f"own.{k}").alias(f"own_{k}") for k in KINDS)))
    # A join by host would bring a hot host's rows together, so sites are broadcast while they are few; a checkpoint
    # leaves a plain join, which Spark splits where it is skewed, for more.
    sites = cut(posteriors(own, labels, "host", "path")[0].select("host", "path", *(f"news_{k}" for k in KINDS)))
    met = own.join(F.broadcast(sites) if sites.count() <= FEW_SITES else sites, ["host", "path"], "left")

    def chance(kind: str) -> Column:
        return 1 / (1 + F.exp(-(F.col(f"own_{kind}") + F.coalesce(F.col(f"news_{kind}"), F.lit(0.0)))))

    bad = F.lit(False)
    if shared.value.weights.get("quality") is not None:
        bad = bad | (chance("quality") < CUT)
    if shared.value.weights.get("toxic") is not None:
        bad = bad | (chance("toxic") > 1 - CUT)
    return met.select("doc_id", "rk", chance("quality").alias("p_quality"), chance("toxic").alias("p_toxic"), bad.alias("rejected"))


def report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, p_quality, p_toxic, rejected for every row.

    Null texts count as empty, texts of any length are read whole; null hosts and paths are sites of their own; sites
    without labels have the global rate. Where the labels show one class only there is no evidence of that kind and
    nothing is rejected for it; without labels everything stays. Labels that differ, of one document or of copies, count
    as shares, see fit(). Repeated rows stay; an empty table gives an empty one. Other columns are not looked at,
    whatever their names.
    """
    return judged(docs.select("doc_id", "text", "source", "lang"), labels, sample).drop("rk")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without what the classifier rejects, see report(). All columns stay, whatever their names."""
    bad = judged(docs.select("doc_id", "text", "source", "lang"), labels, sample).where("rejected").select(doc_order(F.col("doc_id")).alias("doc"), "rk").distinct()
    rows = carried(docs, doc_order(F.col("doc_id")).alias("doc"), row_key(F.col("text")).alias("rk"))
    return restored(rows.join(bad, ["doc", "rk"], "left_anti"), docs.columns)
