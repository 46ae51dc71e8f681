"""Every registered query runs, and equals its DuckDB oracle where it has one."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from ionlake.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLES:
        assert len(got.columns)
        return
    want = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    a, b = tidy(got), tidy(want)
    for c in a.columns:
        if pd.api.types.is_float_dtype(a[c]) or pd.api.types.is_float_dtype(b[c]):
            assert np.allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=0, atol=2e-6, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_prune_columns_and_keep_python_out(spark):
    plan = catalog.QUERIES["ratio"](spark, SF)._jdf.queryExecution().toString()
    read = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "l_extendedprice" not in read and "l_comment" not in read
    assert "PushedFilters: [In(l_returnflag, [A,N])]" in plan and "Python" not in plan and "Join" not in plan
