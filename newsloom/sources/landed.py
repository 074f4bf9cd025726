"""Connectors' responses as a data source: pages that a fetcher has landed, followed by their tokens.

A folder holds a query's responses, as they came: first.json, and for each page token that a response names the response to
it, under that token. Responses land in order, as the token of a page stands in the one before. No network is used.

    spark.read.format("landed").options(path=..., connector="mediacloud", cap=1000).load()
    spark.readStream.format("landed").options(path=..., connector="mediacloud").load()

There is a task for each query; a stream's offset is the number of pages of each, so it goes on where it stopped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from newsloom.functions import text as T

# Fields of each connector's records, where a response has them, and where it names the next page.
CONNECTORS = {
    "gdelt": ("url title seendate domain language sourcecountry", ["articles"], []),
    "mediacloud": ("url title publish_date media_name media_url language", ["stories", "results"], ["pagination_token"]),
    "ddgs": ("title url href body date source", ["results"], []),
    "cse": ("title link snippet displayLink", ["items"], ["queries", "nextPage", "startIndex"]),
    "bing": ("name url description datePublished", ["value"], ["nextOffset"]),
    "serpapi": ("title link snippet source date", ["news_results", "organic_results"], ["serpapi_pagination", "next_page_token"]),
}
FIRST = "first"


def schema_of(connector: str) -> str:
    return "query string, page int, place int, " + ", ".join(f"`{c}` string" for c in CONNECTORS[connector][0].split())


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/(?!//)", "file:///", path))


def found(value: object, path: list[str]) -> object:
    for name in path:
        value = value[0] if isinstance(value, list) and value else value
        value = value.get(name) if isinstance(value, dict) else None
    return value


def pages(path: str, folder: str, connector: str) -> Iterator[tuple[int, list[dict]]]:
    """(number, records) of a query's pages, from the first on, while there are tokens and their responses have landed. A
    token that comes again ends the pages."""
    _, items, token_at = CONNECTORS[connector]
    system, root = opened(path)
    at = f"{root}/{folder}"
    token, seen, n = FIRST, set(), 0
    while token and token not in seen:
        name = f"{at}/{quote(token, safe='')}.json"
        if system.get_file_info(name).type == fs.FileType.NotFound:
            return
        with system.open_input_stream(name) as raw:
            data = json.loads(raw.read())
        records = data if isinstance(data, list) else next((data[k] for k in items if isinstance(data.get(k), list)), [])
        yield n, [r for r in records if isinstance(r, dict)]
        seen.add(token)
        following = found(data, token_at) if token_at else None
        token, n = None if following is None else str(following), n + 1


@dataclass
class Query(InputPartition):
    """Pages start to before stop of a query."""

    folder: str
    start: int = 0
    stop: int | None = None


class Reading:
    def __init__(self, options: dict):
        self.path, self.connector, self.cap = options["path"].rstrip("/"), options["connector"], int(options.get("cap", 0))

    def folders(self) -> list[str]:
        system, at = opened(self.path)
        return [x.base_name for x in sorted(system.get_file_info(fs.FileSelector(at, allow_not_found=True)), key=lambda x: x.path) if x.type == fs.FileType.Directory]

    def rows(self, part: Query) -> Iterator[tuple]:
        fields, had = CONNECTORS[self.connector][0].split(), 0
        for n, records in pages(self.path, part.folder, self.connector):
            if part.stop is not None and n >= part.stop:
                return
            for place, record in enumerate(records):
                if self.cap and had >= self.cap:
                    return
                had += 1
                if n >= part.start:
                    yield (part.folder, n, place, *(None if record.get(f) is None else str(record[f]) for f in fields))


class Reader(Reading, DataSourceReader):
    def partitions(self) -> list[Query]:
        return [Query(f) for f in self.folders()] or [Query("", 0, 0)]

    def read(self, partition: Query) -> Iterator[tuple]:
        return self.rows(partition) if partition.folder else iter(())


class Stream(Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """How many responses of each query have landed; the driver lists them and reads none."""
        (system, root), out = opened(self.path), {}
        for folder in self.folders():
            names = system.get_file_info(fs.FileSelector(f"{root}/{folder}"))
            out[folder] = sum(x.base_name.endswith(".json") for x in names)
        return out

    def partitions(self, start: dict, end: dict) -> list[Query]:
        return [Query(f, start.get(f, 0), n) for f, n in end.items() if n > start.get(f, 0)]

    def read(self, partition: Query) -> Iterator[tuple]:
        return self.rows(partition)


class Landed(DataSource):
    """Options: path, connector (one of CONNECTORS) and cap, records of a query at most (0: all)."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return schema_of(self.options["connector"])

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> Stream:
        return Stream(self.options)


def read_pages(spark: SparkSession, path: str, connector: str, cap: int = 0) -> DataFrame:
    spark.dataSource.register(Landed)
    return spark.read.format("landed").options(path=path, connector=connector, cap=cap).load()


# How connectors write days.
DAYS = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSX", "yyyyMMdd'T'HHmmssX", "dd MMM yyyy HH:mm:ss z"]


def discovered(records: DataFrame, connector: str) -> DataFrame:
    """Records of a connector as discovered ones, the first of each URL in the order of queries, pages and places."""
    has = set(records.columns)

    def pick(*names: str) -> Column:
        return F.coalesce(*(F.nullif(F.btrim(n), F.lit("")) for n in names if n in has), F.lit(None).cast("string"))

    url, said = pick("url", "href", "link"), F.concat_ws(" ", pick("title", "name"), pick("snippet", "body", "description"))
    day = T.any_date(pick("seendate", "publish_date", "datePublished", "date"), DAYS)
    out = records.select(url.alias("url"), F.lit(connector).alias("discovery_method"), F.col("query").alias("query_used"), F.left(said, F.lit(500)).alias("title_snippet"), pick("media_name", "source", "displayLink", "domain").alias("source"), T.domain(url).alias("domain"), day.cast("string").alias("published_date"), F.struct("query", "page", "place").alias("at")).where("url is not null")
    first = out.groupBy("url").agg(F.min_by(F.struct(*(c for c in out.columns if c not in ("url", "at"))), "at").alias("r"))
    return first.select("url", "r.*", F.lit("pending").alias("status"))
