"""Every registered query of the graph part against its SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from graphloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 6) if type(value).__name__ in ("float", "Decimal") else value


def rows(found) -> list[str]:
    return sorted(str(tuple(map(_plain, r))) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = rows(tuple(r) for r in df.select(*columns).collect())
    if name in SQL:
        wanted = duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
        assert found == rows(wanted)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert not __spark_entry__.entry(spark).limit(1).isEmpty()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
