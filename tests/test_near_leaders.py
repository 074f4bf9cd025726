"""The stream of near leaders against a scan in the order of arrival."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.streaming import events

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scan(rows, least=0.75):
    led, out = {}, {}
    for number, key, text in rows:
        w = (text or "").lower().split()
        own = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        found = next((r for r, s in led.setdefault(key, []) if own and len(own & s) / len(own | s) >= least), None)
        if found is None and own:
            led[key].append((number, own))
        out[number] = found
    return out


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_stream_equals_a_scan(rocks, tmp_path):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    rows = []
    for n in range(240):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        rows.append((n, rng.choice(["a", "b"]), " ".join(words) if n % 40 else None))
    for batch in range(4):
        rocks.createDataFrame(rows[batch * 60 : batch * 60 + 60], "n long, host string, text string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    source = events.read_folder(rocks, f"file://{tmp_path}/in", "n long, host string, text string", 1)
    found = events.near_leader_store(source, "host", "n", F.col("text"))
    query = found.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    got = {r.row: r.leader for r in rocks.read.parquet(f"file://{tmp_path}/out").collect()}
    want = scan(rows)
    assert got == want
    assert 20 < sum(v is not None for v in want.values()) < 220
