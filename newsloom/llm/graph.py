"""Connected components over any number of links, with no step that gathers them in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import cut

#: Components that are broadcast at most: those with more than one in HOT_ROOTS of all nodes.
HOT_ROOTS = 10_000
#: Links of a task, and tasks at least, where the session would deal fewer links to each.
TASK_LINKS, LEAST_TASKS = 20_000, 12


def _tasks(total: int) -> int:
    """Tasks for so many links. Every round shuffles several times, so tasks of a few links each would cost files and
    events of many times the links; coalesce() never raises the number, so many links stay dealt as they are."""
    return max(LEAST_TASKS, -(-total // TASK_LINKS))


def _told(links: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """links (u, v) with m of least (u, m, n)."""
    many = F.col("n") * HOT_ROOTS > 2 * total
    met = links.join(F.broadcast(least.where(many).select("u", "m").coalesce(_tasks(total))), "u", "left")
    rest = met.where("m is null").select("u", "v").join(least.where(~many).select("u", "m"), "u")
    return met.where("m is not null").select("u", "v", "m").unionByName(rest.select("u", "v", "m")).coalesce(_tasks(total))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links (a long, b long), in either direction, repeats and loops allowed -> (node, root) for every linked node.

    root is the smallest node of the component. Alternates large-star and small-star steps: each node hands its
    larger (or smaller) neighbours to its smallest one, so that links become a star around the root after about
    log(n) rounds. Minima are pre-aggregated before the shuffle; a node with more than one in HOT_ROOTS of all links,
    as the centre of a large star is, hands on its minimum by a broadcast of HOT_ROOTS rows at most. Every round is
    checkpointed. No links: no rows. Nulls are no nodes.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    edges, before = cut(edges), None
    total = edges.count()
    for _ in range(max_rounds):
        edges = edges.coalesce(_tasks(total))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _told(both, least, total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(_tasks(total))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        moved = _told(large, least, total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(_tasks(total)).distinct().coalesce(_tasks(total)))
        state = after.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        edges, total = after, state["n"]
        if (state["n"], state["x"]) == before:
            break
        before = (state["n"], state["x"])
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).coalesce(_tasks(total))


def least_of_component(rooted: DataFrame) -> DataFrame:
    """(key, least, root) -> (key, root, first): the smallest least of the key's component.

    A component with more than one in HOT_ROOTS of all nodes would land in one task of a join by root, so these, of
    which there are HOT_ROOTS at most, are broadcast; the others meet their rows in a join that no root skews.
    """
    rooted = cut(rooted)
    firsts = cut(rooted.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("n")))
    total = rooted.count()
    hot = firsts.where(F.col("n") * HOT_ROOTS > total).select("root", "first", F.lit(True).alias("hot"))
    met = rooted.join(F.broadcast(hot), "root", "left")
    rest = met.where("hot is null").select("key", "root").join(firsts.where(F.col("n") * HOT_ROOTS <= total).select("root", "first"), "root")
    return met.where("hot").select("key", "root", "first").unionByName(rest.select("key", "root", "first"))
