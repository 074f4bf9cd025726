import os

import duckdb
import pytest

from newsloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rounded(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, twin, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(columns).collect()]
    if name not in catalogue.ORACLE:
        assert rows
        return
    got = twin.execute(catalogue.ORACLE[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    assert rounded(rows) == rounded([tuple(r[names.index(c)] for c in columns) for r in got.fetchall()])
