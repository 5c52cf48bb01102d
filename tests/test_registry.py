import datetime as dt
import decimal

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels " \
         "conversations".split()


def test_every_query_has_an_oracle_except_inventory():
    from auditlake.plans.catalog import ORACLES, QUERIES
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) <= set(E.queries())
    assert set(QUERIES) - set(ORACLES) == {"storage_inventory"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "Access" in df.columns


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


FAST = ["daily_page_rollup", "kpi", "trend_cumulative", "user_activity_last_seen", "auth_error_labels",
        "auth_error_classes", "change_log_next_rows", "table_access", "role_text", "page_map_parse",
        "sync_status", "freshness", "top_users", "removed_companies"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_duckdb_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    order = sorted(df.columns)
    s = sorted((tuple(_norm(r[c]) for c in order) for r in df.collect()), key=repr)
    drows = [dict(zip(dcols, r)) for r in res.fetchall()]
    d = sorted((tuple(_norm(r[c]) for c in order) for r in drows), key=repr)
    assert s == d
