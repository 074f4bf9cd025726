"""Readers and writers of landed files. Every reader takes a path that Spark reaches; none opens files itself."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsloom.functions import text as T
from newsloom.operators.merge import keep_first, keep_last

#: Schemas of landed records, by connector; what the connectors have in common is the last one.
LANDED = {
    "gdelt": "url string, title string, seendate string, domain string, language string, sourcecountry string",
    "mediacloud": "url string, title string, publish_date string, media_name string, media_url string, language string",
    "news_rss": "title string, link string, pubDate string, description string, source string",
    "search": "url string, title string, snippet string, source string, published_date string",
    "articles": "url string, title string, text string, publish_date string",
    "discovered": "url string, discovery_method string, query_used string, discovered_at string, title_snippet string, source string, domain string, published_date string, status string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str | list[str], schema: str | StructType | None = None) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; a byte order mark before the first name is dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', schema=schema)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def _placed(df: DataFrame) -> DataFrame:
    """df with file and position: a row's place in the order of files' names, of their blocks and of lines, however
    files are dealt to tasks."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return df.select("*", F.col("_metadata.file_path").alias("file"), place.alias("position"))


def read_jsonl(spark: SparkSession, path: str, schema: str, keys: list[str] = ()) -> DataFrame:
    """JSON lines without malformed ones; with keys, the last line of each in the order of files and lines."""
    df = spark.read.json(path, schema=schema, mode="DROPMALFORMED")
    if not keys:
        return df
    return keep_last(_placed(df), list(keys), "position").select(df.columns)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def read_many(spark: SparkSession, pattern: str) -> DataFrame:
    """All CSV files of a pattern, with file and position, which sorts by file name and then by line."""
    return _placed(read_csv(spark, pattern))


def scan(df: DataFrame, equals: dict[str, object], order: list[str], most: int | None = None) -> DataFrame:
    """Rows with the given values (None: null), in an order; at most that many."""
    for name, value in equals.items():
        df = df.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    df = df.orderBy(*order)
    return df.limit(most) if most else df


def seeds(df: DataFrame, name: str) -> DataFrame:
    """Seed rows (url, position and any of title_snippet, published_date, query_used, domain) as discovered records: the
    first row of each URL; blank cells get the defaults."""
    first = keep_first(df.withColumn("url", F.btrim("url")).where("url <> ''"), ["url"], F.col("position"))
    own = {"title_snippet": F.lit(""), "published_date": F.lit(None).cast("string"), "query_used": F.lit("seed"), "domain": T.domain(F.col("url"))}
    given = {c: F.coalesce(F.nullif(F.btrim(c), F.lit("")), default) if c in df.columns else default for c, default in own.items()}
    return first.select("url", F.lit("seed").alias("discovery_method"), *(v.alias(k) for k, v in given.items()), F.lit(name).alias("source"), F.lit("pending").alias("status"))


def feed_entries(df: DataFrame, product: list[str], signals: list[str], feed: str) -> DataFrame:
    """Feed entries (link, title, description) whose title and summary have a product and a signal, as whole words."""
    said = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
    has = lambda terms: F.size(T.terms_in(said, terms)) > 0
    kept = df.where(F.btrim(F.coalesce("link", F.lit(""))) != "").where(has(product) & has(signals))
    return kept.select(F.btrim("link").alias("url"), F.lit("rss").alias("discovery_method"), F.lit(f"rss:{feed}").alias("query_used"), F.left(F.coalesce("title", F.lit("")), F.lit(500)).alias("title_snippet"), F.lit(feed).alias("source"), T.domain(F.btrim("link")).alias("domain"), F.lit("pending").alias("status"))


def decoded_redirect(url: Column, host: str) -> Column:
    """The first URL within the base64 path segment behind /articles/ of a host's redirect; any other URL as it is."""
    coded = F.regexp_extract(url, r"/articles/([A-Za-z0-9_-]+)", 1)
    plain = F.translate(coded, "-_", "+/")
    whole = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
    raw = F.decode(F.try_to_binary(whole, F.lit("base64")), "ISO-8859-1")
    found = F.regexp_extract(raw, r"(https?://[^\x00-\x20\x7f-\xff]+)", 1)
    return F.when(F.contains(url, F.lit(host)) & (coded != "") & (F.coalesce(found, F.lit("")) != ""), found).otherwise(url)


# The code of success, and codes that are not tried again.
FETCHED, FINAL = 200, [301, 302, 303, 307, 308, 403, 404, 410, 451]


def fetch_outcome(codes: Column, allowed: Column, retries: int = 3) -> Column:
    """struct(status, attempts, error) of a page from the response codes of its successive attempts (null: no response)
    and whether its host allows it: robots_blocked, success or failed. Attempts end with success, with a code that is not
    tried again, or after so many retries; a code that is bad to the end has failed."""
    tried = F.slice(F.coalesce(codes, F.array().cast("array<int>")), 1, retries + 1)
    ends = F.filter(F.transform(tried, lambda c, i: F.when((c == FETCHED) | c.isin(FINAL), i + 1)), lambda i: i.isNotNull())
    used = F.when(allowed, F.coalesce(F.get(ends, F.lit(0)), F.size(tried))).otherwise(0)
    last = F.get(tried, used - 1)
    status = F.when(~F.coalesce(allowed, F.lit(True)), "robots_blocked").when(last == FETCHED, "success").otherwise("failed")
    error = F.when(status == "failed", F.coalesce(F.concat(F.lit("HTTP "), last.cast("string")), F.lit("no response")))
    return F.struct(status.alias("status"), used.alias("attempts"), error.alias("error"))


# Fixed values of a reader's markdown: lines, beginnings of lines, words and kinds of files that are not the article's.
READER_LINES = ["advertisement", "read more", "also read"]
READER_HEADS = ["url source:", "published time:", "markdown content:"]
READER_MARKS = ["![", "[![", "[]("]
READER_WORDS = ["login", "subscribe", "newsletter", "share this", "follow us", "copyright"]
READER_FILES = ["jpg", "jpeg", "png", "webp", "gif"]
# markdown's images, links (of which the text stays) and signs.
MARKDOWN = r"!\[[^\]]*\]\([^)]+\)|\[([^\]]+)\]\([^)]+\)|[*_`#>]+"


def reader_article(markdown: Column) -> Column:
    """struct(title, published, body) of a page that a reader service turned into markdown.

    Fields stand in lines of their own; of several of a name the last counts. The body is what follows the line of its
    name: whole lines of other matter go by one pattern, then markup by another, then white space is folded."""
    text = F.regexp_replace(F.coalesce(markdown, F.lit("")), r"\r\n?", "\n")
    one_of = lambda values: "(?:" + "|".join(map(re.escape, values)) + ")"
    line = r"[^\n]*"
    gone = "|".join([rf"(?i:{one_of(READER_LINES)})[ \t]*(?=\n|$)", rf"(?i:{one_of(READER_HEADS)}){line}", rf"{one_of(READER_MARKS)}{line}", rf"(?:Title: |Published Time: ){line}", rf"{line}(?i:(?<![A-Za-z0-9_]){one_of(READER_WORDS)}(?![A-Za-z0-9_])|\.{one_of(READER_FILES)}\)){line}"])

    def field(name: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(rf"(?m)^[ \t]*{name}: ([^\n]*)$"), F.lit(1))
        return F.btrim(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")))

    body = F.regexp_extract(text, r"(?s)(?:^|\n)[ \t]*Markdown Content:[^\n]*\n(.*)$", 1)
    plain = F.regexp_replace(F.regexp_replace(body, rf"(?m)^[ \t]*(?:{gone})", ""), MARKDOWN, "$1")
    folded = F.regexp_replace(F.regexp_replace(plain, r"[ \t\x0B\f]+", " "), r"\s*\n\s*", "\n")
    return F.struct(field("Title").alias("title"), field("Published Time").alias("published"), F.btrim(folded, F.lit(" \n")).alias("body"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_landed(spark: SparkSession, path: str, connector: str) -> DataFrame:
    """Records that a connector has landed as JSON lines, as discovered records."""
    raw = spark.read.json(path, schema=LANDED[connector], mode="DROPMALFORMED")
    has = set(raw.columns)
    pick = lambda *names: F.coalesce(*(F.col(n) for n in names if n in has), F.lit(None).cast("string"))
    url, date = pick("url", "link"), pick("published_date", "publish_date", "seendate", "pubDate")
    day = T.any_date(F.regexp_replace(date, "^[A-Za-z]{3}, ", ""), ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyyMMdd'T'HHmmssX", "dd MMM yyyy HH:mm:ss z", "dd MMM yyyy HH:mm:ss xx"])
    return raw.select(url.alias("url"), F.lit(connector).alias("discovery_method"), F.left(F.concat_ws(" ", pick("title"), pick("snippet", "description")), F.lit(500)).alias("title_snippet"), pick("source", "media_name").alias("source"), T.domain(url).alias("domain"), day.cast("string").alias("published_date"), F.lit("pending").alias("status"))


def urls_in(text: Column) -> Column:
    """Distinct URLs in a text, in order, without closing punctuation."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(https?://[^\\s\"'<>]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, "[.,;)]+$", "")))


def conform(df: DataFrame, schema: StructType, aliases: dict[str, str] | None = None) -> DataFrame:
    """df in the given columns and types: names are trimmed, lower-cased and renamed by aliases; what is missing, or
    does not cast, is null."""
    aliases = aliases or {}
    names = {aliases.get(c.strip().lower().replace(" ", "_"), c.strip().lower().replace(" ", "_")): c for c in reversed(df.columns)}
    return df.select(*((F.col(f"`{names[f.name]}`").try_cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    df.select(columns or df.columns).write.mode("overwrite").csv(path, header=True, escape='"')


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_by_label(df: DataFrame, path: str, label: str = "final_label") -> None:
    """One table, a folder for each label: all, relevant, review and irrelevant are reads of it with a filter."""
    df.write.mode("overwrite").partitionBy(label).parquet(path)


def files_of(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any store."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: The file that names the version of a table which counts.
CURRENT = "current"


def replace_table(df: DataFrame, path: str) -> None:
    """df as the table at path, see read_table().

    The rows are written as a version of their own; then a small file that names it is renamed over the one that names
    the last version, in one step. Readers see the old table or the new one whole, also where the writer stops between
    any two steps. Of older versions the last one stays for readers that have begun; what was left behind by writers that
    stopped goes with the next version. One writer at a time."""
    spark = df.sparkSession
    version, before = f"v-{uuid.uuid4().hex}", current_version(spark, path)
    df.write.parquet(f"{path}/{version}")
    files, at = files_of(spark, path)
    _, note = files_of(spark, f"{path}/next-{version}")
    out = files.create(note, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    store = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(at).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    store.rename(files.makeQualified(note), files.makeQualified(files_of(spark, f"{path}/{CURRENT}")[1]), over)
    for found in files.listStatus(at):
        name = found.getPath().getName()
        if name.startswith(("v-", "next-")) and name not in (version, before):
            files.delete(found.getPath(), True)


def current_version(spark: SparkSession, path: str) -> str | None:
    files, at = files_of(spark, f"{path}/{CURRENT}")
    if not files.exists(at):
        return None
    return spark.read.text(str(at), wholetext=True).first()[0]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that replace_table() has put at path last; raises where there is none."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/{version}")


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path, made by make() and written where it is not there whole."""
    files, done = files_of(spark, f"{path}/_SUCCESS")
    if not files.exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
