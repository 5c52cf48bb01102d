"""Property tests: the custom operators against brute force on random inputs."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.functions.joins import keep_one
from auditlake.operators import increments as I
from auditlake.operators import views as V

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

entries = st.lists(st.tuples(st.sampled_from(["A", "B", "C"]), st.integers(min_value=-50, max_value=400)),
                   min_size=1, max_size=120, unique=True)


@SETTINGS
@given(rows=entries, cap=st.integers(min_value=1, max_value=60), width=st.sampled_from([1, 3, 16, 1 << 16]),
       descending=st.booleans())
def test_first_n_per_company_is_exact(spark, rows, cap, width, descending):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(c, e, t) for c, e in rows], "CompanyName string, EntryNo long, ChangedAt timestamp_ntz")
    got = {}
    for r in I.first_n_per_company(df, cap, descending=descending, coarse_slots=width).collect():
        got.setdefault(r.CompanyName, set()).add(r.EntryNo)
    exp = {}
    for c in {c for c, _ in rows}:
        ids = sorted((e for cc, e in rows if cc == c), reverse=descending)[:cap]
        exp[c] = set(ids)
    assert got == exp


@SETTINGS
@given(values=st.lists(st.integers(min_value=0, max_value=30), min_size=1, max_size=150),
       n=st.integers(min_value=1, max_value=200), parts=st.integers(min_value=1, max_value=6))
def test_distributed_top_n_equals_sorted_prefix(spark, values, n, parts):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long").repartition(parts)
    order = [F.col("v").desc(), F.col("i").asc()]
    got = sorted((r.v, r.i) for r in V.top_n(df, order, n, local_max=0).collect())
    exp = sorted(sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (-x[0], x[1]))[:n])
    assert got == exp


@SETTINGS
@given(data=st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3), st.integers(0, 1000)), min_size=1,
                     max_size=100))
def test_keep_one_picks_the_first_in_order_per_key(spark, data):
    df = spark.createDataFrame(data, "k long, j long, o long")
    got = sorted(tuple(r) for r in keep_one(df, [F.col("k")], [F.col("o"), F.col("j")]).collect())
    exp = {}
    for k, j, o in data:
        if k not in exp or (o, j) < (exp[k][2], exp[k][1]):
            exp[k] = (k, j, o)
    assert got == sorted(exp.values())


@SETTINGS
@given(data=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.sampled_from([None, "a", "b", "c"]),
                               st.integers(0, 5)), min_size=1, max_size=60))
def test_delta_fold_equals_sequential_merges(spark, data):
    """Folding per-batch deltas equals applying the MERGE batch by batch:
    hits add up, the page name is the newest batch's MAX (even NULL)."""
    from auditlake.operators import rollup as R
    day = dt.date(2024, 1, 1)
    rows_ = [(day, f"u{u}", str(p), name, "CO", 1, b) for u, p, name, b in data]
    df = spark.createDataFrame(rows_, "DateKey date, UserName string, PageId string, PageName string, "
                                      "CompanyName string, Hits long, BatchId long")
    # per-batch delta: the rollup of that batch's raw rows
    deltas = df.groupBy("DateKey", "UserName", "PageId", "CompanyName", "BatchId").agg(
        F.max("PageName").alias("PageName"), F.sum("Hits").alias("Hits"))
    got = {(r.UserName, r.PageId): (r.Hits, r.PageName) for r in R.merge_daily(deltas).collect()}
    state = {}
    for b in sorted({r[6] for r in rows_}):
        batch = [r for r in rows_ if r[6] == b]
        for key in {(r[1], r[2]) for r in batch}:
            hits = sum(r[5] for r in batch if (r[1], r[2]) == key)
            names = [r[3] for r in batch if (r[1], r[2]) == key and r[3] is not None]
            name = max(names) if names else None
            old = state.get(key, (0, None))
            state[key] = (old[0] + hits, name)          # Hits = Hits + src, PageName = src.PageName
    assert got == state
