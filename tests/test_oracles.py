"""Every query over the smallest tables against the same query in DuckDB."""

import math
from pathlib import Path

import pytest

from readloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect(config={"threads": 2})
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>":
        return None
    return v


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = sorted((tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()), key=repr)
    assert rows
    if name not in ORACLES:
        return
    table = duck.sql(ORACLES[name]).to_arrow_table()
    assert sorted(table.column_names) == sorted(got.columns)
    want = sorted((tuple(r[c] for c in sorted(got.columns)) for r in table.to_pylist()), key=repr)
    assert rows == want
