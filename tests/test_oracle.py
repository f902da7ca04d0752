"""Every query of the graph engine against its SQL in DuckDB, at the smallest scale."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from graphloom.operators import layout as L
from graphloom.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(columns: list[str], values: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([v[i] for i in order]) for v in values)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    got = [tuple(r) for r in df.collect()]
    found = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert rows(df.columns, got) == rows(found.columns, found.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_cells_of_many_chunks(spark, con, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 3)
    test_same_rows(spark, con, "grid_cell_contents")
