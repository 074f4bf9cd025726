"""Filter interaction audit: what each filter removes at each place of every order of the filters.

The orders form a trie, whose edges apply one filter more. Which rows survive a prefix depends on the set of its
filters, not on their order, so the 120 orders of five filters share 32 survivor tables. They are walked depth first:
a state's survivors are its predecessor's, filtered by one filter more, and are persisted while states below are walked;
a state that a prefix with the same filters has left behind is not walked again. In each state one aggregation counts, for
every edge that leaves it, what that filter removes there. At most one state of each depth is persisted at a time.

Verdicts of the filters on a row do not depend on the order, so they are found once and written to the shared folder,
with the row's part and labels; a lost executor's share of a state is filtered from there again. Counts by state and
part are a table there too, so the number of parts is not bounded by the driver. The orders are put together from them.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import LAST, UPPER, cut, doc_order, let, materialize, shared_path

#: What stands between words.
SPACES = " \t\n\v\f\r"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")


def text_filters(text: Column) -> dict[str, Column]:
    """Name -> whether a text without null fails: too few words, too many repeated words, too many capitals, signs."""
    sizes = let(words(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return {"A": sizes["n"] < 200, "B": 100 * sizes["distinct"] < 50 * sizes["n"], "C": 100 * capitals > 2 * F.char_length(text), "D": text.rlike(r"[#$%&*|]")}


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic and a boolean for each filter A to E of every row of docs.

    A text is identical to an earlier one if a row with a smaller doc_id has it; rows without a doc_id come after all
    others, and rows of one doc_id are not before each other. Copies are told by SHA-256. The first row of each text is
    looked up by doc_id and digest, so the rows of a text that fills a third of the table meet its first one in many
    tasks; finding the first is a minimum, which is folded before its shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        doc_order(F.col("doc_id")).alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"),
        *(F.coalesce(fails, F.lit(False)).alias(k) for k, fails in text_filters(text).items()),
    )
    rows = cut(rows)
    first = cut(rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True)))
    rows = rows.join(first, ["id", "digest"], "left").withColumn("E", F.col("first").isNull())
    marks = cut(labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")))
    rows = rows.join(marks.where(F.col("id") != LAST), "id", "left")
    return rows.select("part", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")), *"ABCDE")


def states(names: str) -> list[str]:
    """The states in the order of a depth-first walk over the trie of all orders, each where it is met first."""
    seen, out = set(), []

    def visit(path: str) -> None:
        key = frozenset(path)
        if key not in seen:
            seen.add(key)
            out.append(path)
            for f in names:
                if f not in path:
                    visit(path + f)

    visit("")
    return out


def walk(rows: DataFrame, names: str, path: str) -> None:
    """Writes to path one row for each part and state that has survivors: state (its filters), kept, and for each filter
    that is still to come what it removes: removed, good, toxic. rows: part, good, toxic and a boolean for each filter."""
    open_: list[tuple[str, DataFrame]] = []
    for state in states(names):
        while open_ and not state.startswith(open_[-1][0]):
            open_.pop()[1].unpersist()
        survivors = open_[-1][1].where(~F.col(state[-1])).drop(state[-1]) if open_ else rows
        to_come = [f for f in names if f not in state]
        if to_come:
            survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        open_.append((state, survivors))

        def edge(f: str) -> Column:
            return F.struct(F.lit(f).alias("f"), F.count_if(F.col(f)).alias("removed"), F.count_if(F.col(f) & F.col("good")).alias("good"), F.count_if(F.col(f) & F.col("toxic")).alias("toxic"))

        edges = F.array(*map(edge, to_come)) if to_come else F.array().cast("array<struct<f:string,removed:bigint,good:bigint,toxic:bigint>>")
        counts = survivors.groupBy("part").agg(F.count("*").alias("kept"), edges.alias("edges"))
        counts.select(F.lit("".join(sorted(state))).alias("state"), "part", "kept", "edges").coalesce(1).write.mode("append").parquet(path)
    for _, df in open_:
        df.unpersist()


def report(docs: DataFrame, labels: DataFrame, names: str = "ABCDE") -> DataFrame:
    """One row for each part (source; null is an empty string), filter_order and step: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    A null text is empty. Repeated rows count each. Several labels of a document count as one that is good, or toxic, if
    any is; labels without a doc_id are not looked at. An empty table has no parts and gives no rows. Other columns are
    not looked at, whatever their names. Texts of any length are read whole."""
    spark = docs.sparkSession
    ready = materialize(judged(docs, labels), shared_path(spark, "judged"))
    at = shared_path(spark, "edges")
    walk(ready, names, at)
    counted = spark.read.schema("state string, part string, kept bigint, edges array<struct<f:string,removed:bigint,good:bigint,toxic:bigint>>").parquet(at)
    # A part's states, one for each set of filters at most, as a map.
    parts = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct("kept", F.map_from_entries(F.transform("edges", lambda e: F.struct(e["f"], e))).alias("edges"))))).alias("states"))

    def gone(state: Column | str, f: Column | str, what: str) -> Column:
        state, f = (F.lit(x) if isinstance(x, str) else x for x in (state, f))
        return F.coalesce(F.try_element_at(F.try_element_at(F.col("states"), state)["edges"], f)[what], F.lit(0).cast("long"))

    def shapley(f: str) -> Column:
        """A state of k filters stands before f in k! (n - 1 - k)! of the orders."""
        others = [s for s in map(lambda s: "".join(sorted(s)), states(names)) if f not in s]
        return sum((gone(s, f, "removed") * (math.factorial(len(s)) * math.factorial(len(names) - 1 - len(s))) for s in others), F.lit(0).cast("long"))

    of_filter = F.create_map(*(x for f in names for x in (F.lit(f), F.struct(gone("", f, "removed").alias("fails"), gone("".join(sorted(set(names) - {f})), f, "removed").alias("unique"), shapley(f).alias("shapley")))))
    steps = F.array(*(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(order[k]).alias("f"), F.lit("".join(sorted(order[:k]))).alias("before")) for order in permutations(names) for k in range(len(names))))
    each = parts.select("part", "states", of_filter.alias("own")).select("part", "states", "own", F.explode(steps).alias("s")).select("part", "states", "own", "s.*")
    removed, own = gone(F.col("before"), F.col("f"), "removed"), F.element_at("own", F.col("f"))
    before = F.coalesce(F.try_element_at(F.col("states"), F.col("before"))["kept"], F.lit(0).cast("long"))
    return each.select(
        "part", "filter_order", "step", (before - removed).alias("kept"), removed.alias("removed"), (own["fails"] - removed).alias("redundant"), own["unique"].alias("unique_fails"),
        gone(F.col("before"), F.col("f"), "good").alias("good_lost"), gone(F.col("before"), F.col("f"), "toxic").alias("toxic_lost"), own["shapley"].alias("shapley"),
    )
