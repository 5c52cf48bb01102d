import datetime as dt
import glob
import tempfile

import pytest
from pyspark.sql import functions as F

from auditlake.operators import filters as FL
from auditlake.operators import health as H
from auditlake.operators import retention as RT
from auditlake.operators import views as V
from auditlake.sources import sinks as S
from conftest import rows


def test_retention_edge_and_month_arithmetic(spark):
    assert RT.months_back(dt.datetime(2024, 3, 31, 8), 1) == dt.datetime(2024, 2, 29, 8)
    assert RT.months_back(dt.datetime(2024, 1, 15), 6) == dt.datetime(2023, 7, 15)
    df = spark.createDataFrame([(dt.datetime(2023, 7, 15, 0, 0, 0),), (dt.datetime(2023, 7, 14, 23, 59, 59),)],
                               "Timestamp timestamp_ntz")
    kept = RT.retain(df, "Timestamp", dt.datetime(2024, 1, 15), 6)
    assert rows(kept) == [(dt.datetime(2023, 7, 15),)]
    unknown = spark.createDataFrame([(None,)], "Timestamp timestamp_ntz")
    assert RT.retain(unknown, "Timestamp", dt.datetime(2024, 1, 15), 6).count() == 1


@pytest.mark.parametrize("value,expected", [(6, 6), ("12", 12), (None, 24), (1, 1), (1200, 1200)])
def test_retention_param_validation(value, expected):
    assert RT.retention_months(value, 24) == expected


@pytest.mark.parametrize("value", [0, 1201, 2.5, True, "x", "", -3])
def test_bad_retention_raises(value):
    with pytest.raises(ValueError):
        RT.retention_months(value, 24)


@pytest.mark.parametrize("value,expected", [(100, 100), (1_000_000, 1_000_000), ("250", 250), (None, 5000)])
def test_top_rows_validation(value, expected):
    assert V.top_rows(value) == expected


@pytest.mark.parametrize("value", [99, 10**7, 2_000_000, "x", 250.5, True, ""])
def test_top_rows_out_of_range_is_an_error(value):
    with pytest.raises(ValueError):
        V.top_rows(value)


def test_purge_validation_and_counts(spark):
    log = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3)], "CompanyName string, EntryNo long")
    req = RT.normalize_names(spark, [" A ", "", "A"])
    RT.validate_known(req, log.select("CompanyName").distinct())
    remaining, deleted = RT.purge_companies(log, req)
    assert rows(remaining, "EntryNo") == [(3,)] and rows(deleted) == [("A", 2)]
    with pytest.raises(ValueError, match="Z"):
        RT.validate_known(RT.normalize_names(spark, ["Z"]), log.select("CompanyName").distinct())


def test_removed_companies_null_previous_means_all(spark):
    known = spark.createDataFrame([("A",), ("B",), ("C",)], "CompanyName string")
    now = spark.createDataFrame([("B",)], "CompanyName string")
    assert rows(RT.removed_companies(None, known, now)) == [("A",), ("C",)]
    pending = spark.createDataFrame([("C",), ("D",)], "CompanyName string")
    assert rows(RT.queue_purge(pending, RT.removed_companies(None, known, now))) == [("A",), ("C",), ("D",)]


def test_feed_status_age_expiry_and_overall(spark):
    now = dt.datetime(2024, 1, 31, 12, 0, 0)
    st = spark.createDataFrame([(True, dt.datetime(2024, 1, 30, 9, 59, 30)), (False, dt.datetime(2024, 1, 1)),
                                (True, None)], "Ok boolean, CheckedAt timestamp_ntz")
    out = H.feed_status_age(st, now).collect()
    assert out[0].AgeMinutes == 1561 and out[0].Stale is True      # 1560.5 min rounds half up
    assert out[1].Stale is False and out[2].AgeMinutes is None and out[2].Stale is False
    future = spark.createDataFrame([(True, dt.datetime(2024, 2, 1))], "Ok boolean, CheckedAt timestamp_ntz")
    assert H.feed_status_age(future, now).first().AgeMinutes == 0
    sec = spark.createDataFrame([("sp", dt.datetime(2024, 2, 5)), ("sp2", dt.datetime(2024, 3, 1)),
                                 ("sp3", dt.datetime(2025, 1, 1))], "Name string, ExpiresAt timestamp_ntz")
    lv = {r.Name: (r.DaysLeft, r.Level) for r in H.expiry(sec, now, 30).collect()}
    assert lv == {"sp": (4, "problem"), "sp2": (29, "warning"), "sp3": (335, None)}
    probs = spark.createDataFrame([(False,), (True,)], "Problem boolean")
    assert H.overall_status(probs).first().Status == "ERROR"
    assert H.overall_status(probs.filter("not Problem")).first().Status == "OK"


def test_step_status_first_match_and_missing(spark):
    from auditlake.sources import landing as L
    lines = spark.createDataFrame([(1, "modul A exit=2"), (2, "modul A exit=0"), (3, "snapshot exit=0")],
                                  "LineNo long, value string")
    st = {r.Step: (r.ExitCode, r.Failed) for r in H.step_status(L.parse_run_log(lines), L.STEP_LABELS).collect()}
    assert st["modul A"] == (2, True) and st["snapshot"] == (0, False) and st["modul B"] == (None, None)


def test_reconcile_and_carry_last_known(spark):
    per = spark.createDataFrame([("B", 10, False), ("B", 0, True)], "Module string, Count long, Failed boolean")
    local = spark.createDataFrame([("B", 7)], "Module string, LocalCount long")
    assert H.reconcile_cloud_count(per, local).first().CloudShown == 7
    per2 = spark.createDataFrame([("B", 0, False)], "Module string, Count long, Failed boolean")
    assert H.reconcile_cloud_count(per2, local).first().CloudShown == 7
    new = spark.createDataFrame([("t", "prod", None)], "Tenant string, Env string, Companies long")
    prev = spark.createDataFrame([("t", "prod", 12)], "Tenant string, Env string, Companies long")
    assert H.carry_last_known(new, prev, ["Tenant", "Env"], "Companies").first().Companies == 12


def test_filters_and_threshold(spark):
    df = spark.createDataFrame([("Customer", "Deletion", dt.datetime(1996, 12, 31, 23)),
                                ("Item", "Deletion", dt.datetime(1996, 6, 1)),
                                ("customer x", "Insertion", dt.datetime(1996, 6, 1))],
                               "TableName string, ChangeType string, ChangedAt timestamp_ntz")
    spec = FL.FilterSpec(contains={"TableName": "CUST"}, equals={"ChangeType": "Deletion"},
                         date_range={"ChangedAt": ("1996.01.01", "1996.12.31")})
    assert rows(FL.apply_filters(df, spec), "TableName") == [("Customer",)]
    assert FL.min_operations(spark.createDataFrame([(1,), (5,)], "n long"), "n", 2).count() == 1


def test_top_groups_bars(spark):
    df = spark.createDataFrame([("a", 200), ("b", 1), ("c", 0), ("d", 101)], "g string, v long")
    out = {r.Label: r.Bar for r in V.top_groups(df, "g", "v", 10).collect()}
    assert out == {"a": 100, "b": 1, "c": 0, "d": 50}      # 50.5 -> 50 (half to even), min 1 %


def test_csv_export_has_bom_and_semicolons(spark):
    d = tempfile.mkdtemp(prefix="al-exp-") + "/out"
    df = spark.createDataFrame([("Ann", dt.date(2024, 1, 2), 3)], "Name string, Day date, Hits long")
    S.export_table(df, d, "csv")
    text = "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(d + "/part-*")))
    assert text.startswith("\ufeffName;Day;Hits") and "Ann;2024-01-02;3" in text
    S.export_table(df, d + "_txt", "txt")
    t2 = "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(d + "_txt/part-*")))
    assert "Ann\t2024-01-02\t3" in t2


def test_snapshot_sections(spark, monkeypatch):
    d = tempfile.mkdtemp(prefix="al-snap-") + "/snap"
    kpi = spark.createDataFrame([(1, 2)], "A long, B long")
    trend = spark.createDataFrame([(dt.date(2024, 1, 1), 5)], "DateKey date, Hits long")
    assert S.read_snapshot(spark, d) == {}
    first = S.write_snapshot({"kpi": kpi, "trend": trend}, d, "2024-01-31 12:00:00")
    assert S.read_snapshot(spark, d)["trend"].first().DateKey == "2024-01-01"
    # a later version that was not committed is not seen; a pinned one stays readable
    from auditlake.streaming.versions import Versions
    late = spark.createDataFrame([(9, None)], "A long, B long")
    commit = Versions.commit
    monkeypatch.setattr(Versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        S.write_snapshot({"kpi": late}, d, "2024-02-01 12:00:00")
    monkeypatch.setattr(Versions, "commit", commit)
    assert rows(S.read_snapshot(spark, d)["kpi"]) == [(1, 2)]
    second = S.write_snapshot({"kpi": late}, d, "2024-02-02 12:00:00")
    assert second > first and rows(S.read_snapshot(spark, d)["kpi"]) == [(9, None)]
    assert rows(S.read_snapshot(spark, d, first)["kpi"]) == [(1, 2)]
    assert S.read_snapshot(spark, d)["generatedUtc"].first()[0] == "2024-02-02 12:00:00"


def test_storage_inventory_rows(spark):
    out = S.storage_inventory(spark, {"region": "/root/testdata/sf0.001/region.parquet"}).first()
    assert out.Rows == 5 and out.SizeMB is not None


def test_top_n_distributed_path_equals_heap_path(spark):
    df = spark.range(0, 3000, numPartitions=7).select((F.col("id") % 97).alias("a"), F.col("id").alias("b"))
    order = [F.col("a").desc(), F.col("b").asc()]
    heap = rows(V.top_n(df, order, 500))
    dist = rows(V.top_n(df, order, 500, local_max=10))
    assert heap == dist and len(dist) == 500
    assert V.top_n(df, order, 5000, local_max=10).count() == 3000


def test_page_of_rows_deep_pages_match(spark):
    df = spark.range(0, 2500, numPartitions=5).select((F.col("id") * 7 % 2500).alias("v"))
    order = [F.col("v").desc()]
    for page in (0, 3, 24):
        a = rows(V.page_of_rows(df, order, page, 100))
        b = rows(V.page_of_rows(df, order, page, 100, local_max=10))
        exp = sorted([(v,) for v in range(2499 - page * 100, 2499 - page * 100 - 100, -1)], key=repr)
        assert a == b == exp


def test_settings_validation():
    from auditlake.plans.snapshot import Settings
    s = Settings(audit_retention_months="36", top_rows="500", forward_cap="7",
                 enabled_companies=[" CO_1", "", "CO_1", "CO_2"]).validated()
    assert (s.page_retention_months, s.audit_retention_months, s.top_rows) == (6, 36, 500)
    assert s.enabled_companies == ["CO_1", "CO_2"] and s.stale_hours == 24.0 and s.caps.forward == 7
    assert Settings().validated().enabled_companies is None
    for bad in (dict(page_retention_months=0), dict(stale_hours=-1), dict(seed_rows="x"), dict(secret_warn_days=0), dict(top_rows=3)):
        with pytest.raises(ValueError):
            Settings(**bad).validated()


def test_full_snapshot_from_stored_tables(spark):
    import datetime as _dt
    from auditlake.plans import tables as TB
    from auditlake.plans.snapshot import Settings, snapshot_sections
    sf = "/root/testdata/sf0.001"
    secs = snapshot_sections(TB.page_daily(spark, sf), TB.page_log(spark, sf), TB.auth_fail_daily(spark, sf),
                             TB.change_log(spark, sf), TB.users(spark, sf), TB.page_map(spark, sf),
                             _dt.date(2024, 1, 31), Settings(top_rows=100))
    d = tempfile.mkdtemp(prefix="al-dash-") + "/snap"
    S.write_snapshot(secs, d, "2024-01-31 12:00:00")
    back = S.read_snapshot(spark, d)
    assert back["changeLog"].count() == 100
    assert back["pageMapCount"].first().PageMapCount == TB.page_map(spark, sf).count()
    assert set(back) >= {"kpi", "trend", "tableAccess", "userActivity", "authFails", "pageRange", "auditRange"}


def test_partition_swap_recovers_from_interrupted_swap(spark):
    from auditlake.sources import sinks as SK
    base = tempfile.mkdtemp(prefix="al-swap-")
    t = base + "/t"
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, p string").write.partitionBy("p").parquet(t)
    # simulate a crash right after the old partition was moved aside
    fs, src = SK._fs(spark, t + "/p=a")
    fs.rename(src, SK._fs(spark, t + "/.replaced_p=a")[1])
    assert rows(spark.read.parquet(t), "k") == [(2,)]
    assert SK.recover_table(spark, t) == ["p=a"]
    assert rows(spark.read.parquet(t), "k") == [(1,), (2,)]
    # a normal swap: new content in, missing staged part removed
    stg = base + "/stg"
    spark.createDataFrame([(10, "a")], "k int, p string").write.partitionBy("p").parquet(stg)
    SK.swap_partitions(spark, t, stg, ["p=a", "p=b"])
    assert rows(spark.read.parquet(t), "k") == [(10,)]


def test_large_top_n_on_wide_rows_in_many_partitions(spark):
    """Rows and counts must agree on what a partition is, whatever AQE makes of each side."""
    from pyspark.sql import functions as SF
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        df = spark.range(0, 400_000, 1, 16).select(
            SF.xxhash64("id").alias("k"), "id", SF.repeat(SF.md5(SF.col("id").cast("string")), 6).alias("wide"))
        order = [SF.col("k").desc(), SF.col("id").asc()]
        for n in (20_000, 100_000, 300_000):
            want = df.orderBy(*order).limit(n).agg(SF.count("*"), SF.sum("id"), SF.min("k")).first()
            assert V.top_n(df, order, n).agg(SF.count("*"), SF.sum("id"), SF.min("k")).first() == want
        page = {r.id for r in V.page_of_rows(df, order, 30, 5000).collect()}
        want = {r.id for r in df.orderBy(*order).offset(150_000).limit(5000).collect()}
        assert page == want
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
