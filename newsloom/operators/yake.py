"""Keyphrases by statistics of one text, the corpus read in the order of its documents.

A term is weighed by how it is written (capitals), where its sentences stand, how often it comes against the mean of all
terms, in how many sentences, and by how many different neighbours it has on either side. A phrase is a run of up to n
words that no sign parts, none of them a number or mixed with signs, that does not start or end with a stop word; its
score is the product of its terms' weights over their sum and its frequency, and the smaller the better. Stop words
within a phrase count by how firmly they go with their neighbours. Phrases near a better one by edit distance are folded.

All statistics are aggregations by term, by pair of neighbours and by phrase, so the corpus is one text of any length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators.running import medians, sums_before
from newsloom.sources.shared import cut, written

#: Where sentences end; words, with signs inside them, and single other signs.
SENTENCE_END, TOKEN, WORD = r"[.!?]+\s+|[\r\n]+", r"([\pL\pM\pN_]+(?:['’.,:/&@+-][\pL\pM\pN_]+)*|[^\s\pL\pM\pN_])", r"^[\pL\pM\pN_]"
#: Words of a phrase, phrases, and the likeness to a better one from which on a phrase is folded.
WORDS, TOP, ALIKE = 4, 80, 0.75
#: Phrases that are compared at a time when near ones are folded.
BLOCK = 400


def term_of(word: Column) -> Column:
    """Lower case, without a plural's s."""
    low = F.lower(word)
    return F.when((F.length(low) > 3) & F.endswith(low, F.lit("s")), F.left(low, F.length(low) - 1)).otherwise(low)


#: Words of letters alone: without capitals, and with one, their first, before others. Most are, and what they are needs
#: no further look.
PLAIN, CAPITAL = r"^[\p{L}&&[^\p{Lu}]]+$", r"^\p{Lu}[\p{L}&&[^\p{Lu}]]+$"


def kind_of(word: Column, at: Column) -> Column:
    """d: a number; u: mixed with digits or signs; a: all capitals; n: a capital first, not first of its sentence; p: plain."""
    count = lambda pattern: F.length(word) - F.length(F.regexp_replace(word, pattern, ""))
    digits, letters, signs, upper = count(r"\pN"), count(r"\pL"), count(r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"), count(r"\p{Lu}")
    number = F.regexp_replace(word, ",", "").rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$")
    mixed = ((digits > 0) & (letters > 0)) | ((digits == 0) & (letters == 0)) | (signs > 1)
    name = (upper == 1) & (F.length(word) > 1) & F.left(word, F.lit(1)).rlike(r"^\p{Lu}") & (at > 0)
    return F.when(number, "d").when(mixed, "u").when(upper == F.length(word), "a").when(name, "n").otherwise("p")


def is_stop(low: Column, term: Column, stop: list[str]) -> Column:
    return low.isin(stop) | term.isin(stop) | (F.length(F.regexp_replace(term, r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", "")) < 3)


def sentences_of(docs: DataFrame, doc: str, text: Column) -> tuple[DataFrame, int]:
    """(doc, sentence, tokens) of all documents, sentences numbered through the corpus from 0, and their number."""
    split = F.filter(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda s: s.rlike(r"\S"))
    rows = docs.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), split.alias("parts")).select("doc", "parts", F.size("parts").cast("long").alias("n"))
    counted = sums_before(rows.select("doc", "n"), "doc", "n", "first")
    total = counted.agg(F.coalesce(F.max(F.col("first") + F.col("n")), F.lit(0))).first()[0]
    # Texts are dealt to as many tasks as shuffles have: they are few bytes for the work on them, and would be coalesced.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = rows.join(counted.select("doc", "first"), "doc").repartition(tasks, "doc").select("doc", "first", F.posexplode("parts").alias("at", "part"))
    return each.select("doc", (F.col("first") + F.col("at")).alias("sentence"), F.regexp_extract_all("part", F.lit(TOKEN), F.lit(1)).alias("tokens")), total


def told(tokens: Column, stop: list[str]) -> Column:
    """low, term, kind and stop of each token; null of signs."""

    def of(word: Column, at: Column) -> Column:
        def struct(kind: Column, stopped: Callable[[Column, Column], Column]) -> Column:
            of_low = lambda low: T.let(term_of(low), lambda term: F.struct(low.alias("low"), term.alias("term"), kind.alias("kind"), stopped(low, term).alias("stop")))
            return T.let(F.lower(word), of_low)

        letters = lambda low, term: (F.length(term) < 3) | low.isin(stop) | term.isin(stop)
        short = F.when(word.rlike(PLAIN), struct(F.lit("p"), letters)).when(word.rlike(CAPITAL), struct(F.when(at > 0, "n").otherwise("p"), letters))
        return short.when(word.rlike(WORD), struct(kind_of(word, at), lambda low, term: is_stop(low, term, stop)))

    return F.transform(tokens, of)


def terms(rows: DataFrame, sentences: int, edges: DataFrame) -> DataFrame:
    """(sentence, tokens) and neighbours() of them -> term, stop, tf and h, the weight of each term."""
    each = rows.select(F.explode("tokens").alias("t")).where("t is not null").select("t.*")
    found = each.groupBy("term").agg(F.count("*").alias("tf"), F.count_if(F.col("kind") == "a").alias("caps"), F.count_if(F.col("kind") == "n").alias("names"), F.max("stop").alias("stop"))
    # A sentence is one row, so its terms are told apart where they are. Stop words need no place.
    own = F.array_distinct(F.transform(F.filter("tokens", lambda t: t.isNotNull() & ~t["stop"]), lambda t: t["term"]))
    held = written(rows.select("sentence", own.alias("terms"))).select("sentence", F.explode("terms").alias("term"))
    spread = held.groupBy("term").agg(F.count("*").alias("spread"))
    left = edges.groupBy(F.col("b").alias("term")).agg(F.count("*").alias("dl"), F.sum("n").alias("nl"))
    right = edges.groupBy(F.col("a").alias("term")).agg(F.count("*").alias("dr"), F.sum("n").alias("nr"))
    found = cut(found.join(spread, "term", "left").join(medians(held, "term", "sentence", sentences - 1), "term", "left").join(left, "term", "left").join(right, "term", "left").fillna(0, ["spread", "dl", "nl", "dr", "nr"]))
    own = found.where("not stop").agg(F.max("tf").alias("most"), F.avg("tf").alias("mean"), F.stddev_pop("tf").alias("spread")).first()  # three numbers
    if own["most"] is None:
        return found.select("term", "stop", "tf", F.lit(None).cast("double").alias("h"))
    most = F.lit(float(own["most"]))
    side = lambda d, n: 0.5 + F.coalesce(F.try_divide(F.col(d), F.col(n)), F.lit(0.0)) * (F.col("tf") / most) + F.col(d) / most
    related, often = side("dl", "nl") + side("dr", "nr"), F.col("tf") / F.lit(own["mean"] + own["spread"])
    wide, case, place = F.col("spread") / F.lit(float(sentences)), F.greatest("caps", "names") / (1 + F.log("tf")), F.log(F.log(3 + F.col("median")))
    return found.select("term", "stop", "tf", F.when(~F.col("stop"), place * related / (case + often / related + wide / related)).alias("h"))


def neighbours(rows: DataFrame) -> DataFrame:
    """(a, b, n): how often term b comes right behind term a, both of them words that may stand in phrases."""
    fit = lambda t: t.isNotNull() & t["kind"].isin("a", "n", "p")
    pairs = F.filter(F.transform("tokens", lambda t, i: F.struct(t.alias("x"), F.get(F.col("tokens"), i + 1).alias("y"))), lambda p: fit(p["x"]) & fit(p["y"]))
    return rows.select(F.explode(F.transform(pairs, lambda p: F.struct(p["x"]["term"].alias("a"), p["y"]["term"].alias("b")))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def phrases(rows: DataFrame, most: int, loose: int = 0) -> DataFrame:
    """(phrase, tf, df): runs of up to most words, with loose stop words within at least. What goes through the shuffle is a
    phrase's words and two counts; its terms and stop words follow from the words, see parts_of(). Documents are counted
    where they are, before it."""

    def runs(tokens: Column) -> Column:
        size = F.size(tokens)
        stopped = lambda i, j: F.get(tokens, i + j)["stop"]
        fit = lambda i, j: F.coalesce(F.get(tokens, i + j)["kind"].isin("a", "n", "p"), F.lit(False))

        def of(k: int) -> Column:
            def phrase(i: Column) -> Column:
                ends = fit(i, 0) & ~stopped(i, 0) & fit(i, k - 1) & ~stopped(i, k - 1)
                within = sum((F.coalesce(stopped(i, j).cast("int"), F.lit(0)) for j in range(1, k - 1)), F.lit(0)) >= loose
                return reduce(Column.__and__, (fit(i, j) for j in range(1, k - 1)), ends & within)

            at = F.filter(F.sequence(F.lit(0), F.greatest(size - k, F.lit(0))), phrase)
            return F.transform(at, lambda i: F.concat_ws(" ", *(F.get(tokens, i + j)["low"] for j in range(k))))

        return F.concat(*(of(k) for k in range(min(loose + 2, most) if loose else 1, most + 1)))

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = rows.where(F.size("tokens") > 0).repartition(tasks, "doc").select("doc", F.explode(T.let(F.col("tokens"), runs)).alias("phrase"))
    return each.groupBy("doc", "phrase").agg(F.count("*").alias("tf")).groupBy("phrase").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def parts_of(phrase: Column, stop: list[str]) -> Column:
    """The term of each word of a phrase, and whether it is a stop word: a word has no white space within."""
    return F.transform(F.split(phrase, " "), lambda low: F.struct(term_of(low).alias("term"), is_stop(low, term_of(low), stop).alias("stop")))


@dataclass
class Corpus:
    """rows: (doc, sentence, tokens) as told(); edges: neighbours(); weights: terms()."""

    rows: DataFrame
    edges: DataFrame
    weights: DataFrame


def read(docs: DataFrame, doc: str, text: Column, stop: list[str]) -> Corpus:
    """Null texts and rows without a doc are left out; doc is a number and tells rows apart."""
    rows, sentences = sentences_of(docs, doc, text)
    # As Parquet: the words of a corpus repeat, and take a fraction of a checkpoint's bytes there.
    rows = written(rows.select("doc", "sentence", told(F.col("tokens"), stop).alias("tokens")))
    edges = written(neighbours(rows))
    return Corpus(rows, edges, cut(terms(rows, sentences, edges)))


def scored(docs: DataFrame, doc: str, text: Column, stop: list[str], most: int = WORDS) -> DataFrame:
    """(phrase, tf, df, raw) of all phrases of the corpus, the best with the smallest raw score."""
    return scores(read(docs, doc, text, stop), stop, most)


def scores(corpus: Corpus, stop: list[str], most: int = WORDS, loose: int = 0) -> DataFrame:
    """scored(), of the phrases with loose stop words within at least.

    Loose stop words within a phrase may make its score negative, as the method has it; where the sum of weights is -1
    there is none."""
    rows, edges, weights = corpus.rows, corpus.edges, corpus.weights
    # Phrases go by numbers until they are scored.
    found = written(phrases(rows, most, loose).withColumn("id", F.monotonically_increasing_id()))
    parts = found.select("id", parts_of(F.col("phrase"), stop).alias("parts")).select("id", F.posexplode("parts").alias("at", "p"), "parts").select("id", "at", "p.term", "p.stop", F.get("parts", F.col("at") - 1)["term"].alias("before"), F.get("parts", F.col("at") + 1)["term"].alias("after"))
    # Both sides of these joins have shuffles of their own, so that Spark splits a term that stands in most phrases.
    plain = parts.where("not stop").join(weights.select("term", "h"), "term").select("id", "at", "h", F.lit(None).cast("double").alias("tied"))
    counts = weights.select("term", "tf")
    inner = parts.where("stop")
    tied = lambda near, pair: inner.select("id", "at", *(F.col(c).alias(n) for c, n in pair)).join(edges, ["a", "b"]).join(counts.withColumnsRenamed({"term": near, "tf": "of"}), near).select("id", "at", (F.col("n") / F.col("of")).alias("p"))
    both = tied("a", (("before", "a"), ("term", "b"))).join(tied("b", (("term", "a"), ("after", "b"))).withColumnRenamed("p", "q"), ["id", "at"], "full_outer")
    loose = inner.select("id", "at").join(both, ["id", "at"], "left").select("id", "at", F.lit(None).cast("double").alias("h"), (F.coalesce("p", F.lit(0.0)) * F.coalesce("q", F.lit(0.0))).alias("tied"))
    # A phrase has most parts at most.
    joined = plain.unionByName(loose).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "h", "tied"))).alias("parts"))
    product = F.aggregate("parts", F.lit(1.0), lambda a, p: a * F.coalesce(p["h"], 2 - p["tied"]))
    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + F.coalesce(p["h"], p["tied"] - 1))
    return joined.select("id", product.alias("product"), total.alias("total")).join(found, "id").select("phrase", "tf", "df", F.try_divide(F.col("product"), (F.col("total") + 1) * F.col("tf")).alias("raw")).where("raw is not null")


def folded(ranked: DataFrame, top: int = TOP, alike: float = ALIKE, block: int = BLOCK) -> list[Row]:
    """The best top of (phrase, raw, ...), without those that are alike a better one of them. Phrases are looked at block
    by block; the driver holds a block and what was taken."""
    taken: list[Row] = []
    last = None
    while len(taken) < top:
        rest = ranked if last is None else ranked.where((F.col("raw") > last["raw"]) | ((F.col("raw") == last["raw"]) & (F.col("phrase") > last["phrase"])))
        rows = rest.orderBy("raw", "phrase").limit(block).collect()
        if not rows:
            break
        last, first = rows[-1], len(taken)
        names = [r["phrase"] for r in (*taken, *rows)]
        others = F.transform(F.array(*map(F.lit, names)), lambda p, i: F.struct(i.alias("i"), (1 - F.levenshtein(F.col("phrase"), p) / F.greatest(F.length("phrase"), F.length(p))).alias("s")))
        met = ranked.sparkSession.createDataFrame([(first + k, r["phrase"]) for k, r in enumerate(rows)], "k int, phrase string")
        near = {r["k"]: r["near"] for r in met.select("k", F.transform(F.filter(others, lambda o: (o["i"] < F.col("k")) & (o["s"] > alike)), lambda o: o["i"]).alias("near")).collect()}
        kept = set(range(first))
        for k, r in enumerate(rows, first):
            if len(taken) < top and not kept.intersection(near[k]):
                kept.add(k)
                taken.append(r)
    return taken


def keyphrases(docs: DataFrame, doc: str, text: Column, stop: list[str], most: int = WORDS, top: int = TOP, alike: float = ALIKE) -> DataFrame:
    """(term, tf, df, score) of the best phrases: how often and in how many documents each stands, and its score,
    1 / (1 + raw), the better the larger."""
    corpus = read(docs, doc, text, stop)
    # Weights are positive, and a stop word takes one at most from their sum, to which one is added: a score below 0 needs
    # two of them. All these scores come before all others, so where they suffice, no other phrase is counted.
    best = folded(cut(scores(corpus, stop, most, 2).where("raw < 0")), top, alike) if most > 3 else []
    if len(best) < top:
        best = folded(cut(scores(corpus, stop, most)), top, alike)
    return docs.sparkSession.createDataFrame([(r["phrase"], r["tf"], r["df"], 1 / (1 + r["raw"])) for r in best], "term string, tf long, df long, score double")
