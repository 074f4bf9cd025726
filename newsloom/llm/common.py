"""What the operators of this folder share: shared storage, key columns, ASCII lower case."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, and words, as Java regular expressions for texts in any case: all of ASCII but digits and letters.
NOT_WORD, ANY_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session, as in tests, may leave it unset and
    then gets an own one, which goes with it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="newsloom-checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The rows, written reliably to the shared folder; later jobs read them and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table at path, read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what stands at a path of any store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carried(df: DataFrame, *more: Column) -> DataFrame:
    """Each row as one struct column, row, and the given columns of it (they see df's columns): what an operator adds
    cannot clash with the names of its input."""
    return df.select(F.struct(*(F.col(_quoted(c)) for c in df.columns)).alias("row"), *more)


def restored(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of carried() rows again, some of them changed."""
    return df.select(*(changed[c].alias(c) if c in changed else F.col(f"row.{_quoted(c)}") for c in columns))


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else. lower() is the faster way where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for each row: a lambda's variable is never inlined again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column, separators: str = NOT_WORD) -> Column:
    """The words of a lower-cased text as an array; empty for null and for a text without words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


#: All of ASCII but digits and letters: what NOT_WORD stands for.
SEPARATORS = "".join(map(chr, (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))))


def lower_words(text: Column) -> Column:
    """words_of(ascii_lower(text)), made without running a regular expression."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SEPARATORS + UPPER, " " * len(SEPARATORS) + LOWER)
    return F.filter(F.split(spaced, " "), lambda w: w != "")


#: Sorts after all ids: rows without an id.
LAST = (1 << 63) - 1


def doc_order(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST))


def row_key(text: Column) -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.char_length(text))
