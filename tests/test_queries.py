"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import decimal

import duckdb
import pytest

from dyadflow import plans
from dyadflow.plans.views import TABLES

SF = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, (bool, str)):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return f"{float(x):.6g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(set(plans.SQL)))
def test_same_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(plans.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_rows_without_sql(spark, name):
    """What SQL can't say is tested by itself elsewhere; here each such query gives rows, every column of which says something, twice the same."""
    df = plans.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    empty = {c for c in df.columns if all(r[c] is None for r in rows)}
    assert empty <= MAY_BE_EMPTY.get(name, set())
    if name not in MODELS:
        again = plans.QUERIES[name](spark, SF).collect()
        assert sorted(str([plain(x) for x in r]) for r in rows) == sorted(str([plain(x) for x in r]) for r in again)


#: Columns that these tables leave empty: no record has reporters or slots with places.
MAY_BE_EMPTY = {"k32_code_events": {"attrib", "source_at", "target_at"}}
#: Fits that take long; tests/test_runs.py repeats smaller ones.
MODELS = {"m17_fit", "m17_fit_smoothed", "m17_fit_scaled", "m24_run_chains", "v8_fit_l1_path", "v12_evaluate_timesplit", "v14_dyad_holdout", "k32_code_events", "k32_problems"}
