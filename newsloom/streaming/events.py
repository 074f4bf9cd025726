"""Event windows as functions of a DataFrame, batch or streaming alike, and the streaming sinks around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.operators.duplicates import shingle_hashes

LATE = "10 minutes"


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE) if events.isStreaming else events


def tumbling(events: DataFrame, width: str) -> DataFrame:
    w = timed(events).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    w = timed(events).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    w = timed(events).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), "n")


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key within the watermark: insert-or-ignore of a stream."""
    return timed(events).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def read_folder(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def upsert_into(events: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, buckets: int = 64) -> StreamingQuery:
    """Keeps the latest row of each key as a Parquet table in buckets of a hash of the key. A batch rewrites the buckets
    that it touches and no other; a batch that runs again gives the same rows."""
    from newsloom.operators.merge import keep_last
    from newsloom.sources.shared import cut
    from newsloom.sources.tables import files_of

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = cut(keep_last(batch, keys, order).withColumn("bucket", F.expr(f"cast(pmod(xxhash64({', '.join(keys)}), {buckets}) as int)")))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # buckets at most
        files, at = files_of(spark, path)
        if files.exists(at):
            old = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
            # The checkpoint is read before the buckets are written.
            new = cut(keep_last(old.unionByName(new), keys, order))
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def leader_store(rows: DataFrame, key: str, row: str) -> DataFrame:
    """(row, leader) of a stream: of each key the first row leads, in the order of arrival and within a batch of row
    numbers, and later ones name it. The state is a number for each key."""

    def lead(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = pd.concat(parts)[row].sort_values()
        first = state.get[0] if state.exists else int(own.iloc[0])
        state.update((first,))
        yield pd.DataFrame({"row": own.to_numpy(), "leader": [None if r == first and not n else first for n, r in enumerate(own)]}).astype({"leader": "Int64"})

    return rows.where(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(lead, "row long, leader long", "first long", "append", GroupStateTimeout.NoTimeout)


class NearLeaders(StatefulProcessor):
    """State of a key: the shingle sets of its leaders, and an index from shingles to the leaders that are to be looked at.

    Two sets of a similarity of least share one of the first n - ceil(least n) + 1 of their shingles, in any order that is
    the same for all, here that of their hashes; so a leader is posted under these, and a row asks under its own."""

    def __init__(self, least: float, ttl_ms: int | None):
        self.least, self.ttl_ms = least, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.index = handle.getMapState("index", "shingle long", "leaders array<long>", self.ttl_ms)
        self.sets = handle.getMapState("sets", "leader long", "shingles array<long>", self.ttl_ms)

    def prefix(self, own: np.ndarray) -> list[int]:
        return own[: len(own) - int(np.ceil(self.least * len(own) - 1e-9)) + 1].tolist()

    def posted(self, shingle: int) -> list[int]:
        return list(self.index.getValue((shingle,))[0]) if self.index.containsKey((shingle,)) else []

    def leader_of(self, own: np.ndarray) -> int | None:
        """The first leader that is near."""
        asked = sorted({x for p in self.prefix(own) for x in self.posted(p)})
        for leader in asked:
            if not self.sets.containsKey((leader,)):
                continue  # its time is over
            other = np.array(self.sets.getValue((leader,))[0], dtype=np.int64)
            if min(len(own), len(other)) >= self.least * max(len(own), len(other)) - 1e-9:
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both >= self.least * (len(own) + len(other) - both) - 1e-9:
                    return leader
        return None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        part, out = pd.concat(rows).sort_values("row"), []
        for number, shingles in zip(part["row"].tolist(), part["shingles"], strict=True):
            own = np.sort(np.array(shingles, dtype=np.int64))
            leader = self.leader_of(own) if len(own) else None
            if leader is None and len(own):
                self.sets.updateValue((number,), (own.tolist(),))
                for p in self.prefix(own):
                    self.index.updateValue((p,), (sorted({*self.posted(p), number}),))
            out.append((number, leader))
        yield pd.DataFrame(out, columns=["row", "leader"]).astype({"leader": "Int64"})

    def close(self) -> None:
        pass


def near_leader_store(rows: DataFrame, key: str, row: str, text: Column, least: float = 0.75, k: int = 3, ttl_ms: int | None = None) -> DataFrame:
    """(row, leader) of a stream: within each key a row whose text is near that of an earlier leader names it, others lead,
    in the order of batches and within one of row numbers, which grow as rows arrive. key (a host, a day) deals the state
    out; texts of different keys are not compared. Texts of fewer than k words are near none. What a leader knows is
    forgotten ttl_ms after it came. The state store has to be RocksDB."""
    shaped = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("of"), F.col(row).cast("long").alias("row"), shingle_hashes(text, k).alias("shingles"))
    return shaped.groupBy("of").transformWithStateInPandas(NearLeaders(least, ttl_ms), "row long, leader long", "append", "ProcessingTime" if ttl_ms else "None")
