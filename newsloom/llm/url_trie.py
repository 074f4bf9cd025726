"""URL filters: a trie over reversed host labels and then path segments; the longest rule that fits decides.

The trie is broadcast while the rules stay under max_rules; above that the same verdicts come from a join of each
URL's possible hosts with the rules, which needs no broadcast.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import LOWER, UPPER

#: Rules in a broadcast trie, at about 1 kB each at most.
MAX_RULES = 50_000
SCHEMA = "rule string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first ://, up to /, ?, # or the end, A-Z lower-cased. Path: from there to ?, # or the
    end. Null, or no ://: both empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class Trie:
    """Nodes are dicts: a host label (from the right) leads on; under None stands the path trie of that host. There a
    whole segment leads on; rules that end within a segment are kept at its start, by the text they ask for, with the
    lengths of these texts: a URL's segment is tried at these lengths only."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        """rules: (verdict, host, path); a rule that is listed twice is a block if either says so."""
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, last = path.split("/")
            for part in whole:
                node = node.setdefault(part, {})
            lengths, ends = node.setdefault(None, ([], {}))
            if len(last) not in lengths:
                insort(lengths, len(last))
            blocks = "block" in (verdict, ends.get(last, (verdict,))[0])
            ends[last] = ("block" if blocks else "allow", host + path)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits; at equal length the one of the longer host."""
        best: tuple[str, str] | None = None
        node, parts = self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            at = node.get(None)
            for part in parts:
                if at is None:
                    break
                lengths, ends = at.get(None, ((), {}))
                for k in lengths:
                    if k > len(part):
                        break
                    end = ends.get(part[:k])
                    if end and (best is None or len(end[1]) >= len(best[1])):
                        best = end
                at = at.get(part)
        return best


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """(page_id, url, ...) -> page_id, host, path, rule, verdict for every row; rule is null where none fits.

    rules: (verdict, host, path) as a list, or a DataFrame with these columns. A rule fits its host and all
    subdomains if the path starts with its path. Null and malformed URLs have an empty host and path and get the
    default; URLs of any length are read whole. Repeated rows stay; an empty table gives an empty one. Other columns are
    not looked at, whatever their names.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        few = rules.select("verdict", "host", "path").limit(max_rules + 1).collect()
        if len(few) > max_rules:
            return judge_by_join(parts, rules, default)
        rules = [tuple(r) for r in few]
    elif len(rules) > max_rules:
        return judge_by_join(parts, spark.createDataFrame(rules, "verdict string, host string, path string"), default)
    shared = spark.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf(SCHEMA)
    def look(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for hosts, paths in batches:
            found = [trie.find(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [f and f[1] for f in found], "verdict": [f[0] if f else default for f in found]})

    return parts.select("page_id", "host", "path", look("host", "path").alias("v")).select("page_id", "host", "path", "v.rule", "v.verdict")


def judge_by_join(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for more rules than a broadcast may hold. Distinct URLs only are matched, by host suffix and by the
    folders of their path, a rule by its host and the folder that its path ends in; so neither a top-level domain nor a
    host with many rules meets more than it shares a folder with. A URL's rows meet by (host, path), pre-aggregated to
    the longest rule."""
    urls = parts.select("host", "path").distinct()
    labels, names = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    folders = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.concat(F.slice(names, 1, k - 1), F.array(F.lit(""))), "/"))
    places = urls.select("host", "path", F.explode(suffixes).alias("at"), folders.alias("fs")).select("host", "path", "at", F.explode("fs").alias("folder"))
    rules = rules.groupBy(F.col("host").alias("at"), F.col("path").alias("start")).agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumn("folder", F.regexp_extract("start", "(?s)^(.*/)", 1))
    fits = places.join(rules, ["at", "folder"]).where(F.col("path").startswith(F.col("start")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct((F.length("at") + F.length("start")).alias("n"), F.length("at").alias("h"), F.concat("at", "start").alias("rule"), "verdict")).alias("b"))
    return parts.join(best, ["host", "path"], "left").select("page_id", "host", "path", "b.rule", F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
