"""Every query that has SQL, on the smallest tables, against DuckDB."""

import math
import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = [tuple(round(r[i], 5) if isinstance(r[i], float) and math.isfinite(r[i]) else r[i] for i in at) for r in data]
    return sorted(columns), sorted(clean, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    rel = con.sql(SQL[name])
    df = entry.queries()[name](spark, SF)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries())
