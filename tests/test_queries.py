"""Every registered query over session logs against DuckDB, or at least to its end."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from sessionlog import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows: pd.DataFrame) -> pd.DataFrame:
    def one(v):
        if v is None or (isinstance(v, float) and pd.isna(v)) or v is pd.NA:
            return ""
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    rows = rows[sorted(rows.columns)].astype(object).map(one)
    return rows.sort_values(list(rows.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    got, want = plain(queries.QUERIES[name](spark, sf_dir).toPandas()), plain(duck.execute(queries.ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
