"""Components of graphs: few links make few tasks, however many partitions the session shuffles into."""

import pytest

pytest.importorskip("newsloom.llm.graph")

from newsloom.llm.graph import LEAST_TASKS, connected_components


def test_few_links_make_few_tasks(spark):
    links = [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(100, 130)] + [(200, 201), (5, 5)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = connected_components(spark.createDataFrame(links, "a long, b long"))
        assert found.rdd.getNumPartitions() <= LEAST_TASKS
        got = sorted(tuple(r) for r in found.collect())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == [(k, 0) for k in range(40)] + [(k, 100) for k in range(100, 131)] + [(200, 200), (201, 200)]
