"""Every registered query over the smallest tables against its SQL, and the driver's contract."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(df):
    """Rows as sorted tuples of comparable values."""
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        s = out[c]
        if "datetime" in str(s.dtype):
            out[c] = s.dt.strftime("%Y-%m-%d %H:%M:%S").fillna("")
        elif s.dtype == object or str(s.dtype) in ("str", "string"):
            out[c] = s.map(lambda v: "" if pd.isna(v) else f"{v} 00:00:00" if hasattr(v, "year") and not hasattr(v, "hour") else str(v))
        else:
            out[c] = s.astype(float).round(4)
    return sorted(map(str, out.itertuples(index=False)))


NAMES = [n for n in entry.oracle_sql() if n in entry.queries()]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert sorted(r.horizon for r in rows) == list(range(6))


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_specification_curve_takes_the_protocols_draws(spark):
    (row,) = entry.queries()["c06_specification_curve"](spark, SF).collect()
    assert row.draws == 1000
