import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from auditlake.operators import dedup as D
from auditlake.sources import landing as L
from auditlake.streaming import ingest as ST
from conftest import rows

FEED = "Id long, Timestamp timestamp_ntz, UserId string, UserName string, PageId string, PageName string, " \
       "CompanyName string, ClientType string"
T0 = dt.datetime(2024, 1, 5, 10)


def views(spark, start, n, name="P"):
    data = [(k, T0 + dt.timedelta(minutes=k), f"u{k % 3}", f"u{k % 3}", str(k % 4), name, "CO", "Web")
            for k in range(start, start + n)]
    return spark.createDataFrame(data, FEED)


def daily_rows(spark, state):
    return rows(ST.daily_table(spark, state), "DateKey", "UserName", "PageId", "CompanyName", "Hits", "PageName")


def test_stream_twice_equals_once_and_compaction(spark):
    root = tempfile.mkdtemp(prefix="al-stream-")
    landing, state = f"{root}/landing", ST.State(f"{root}/state")
    views(spark, 0, 20).write.mode("append").parquet(landing)
    ST.run_page_stream(spark, landing, state, views(spark, 0, 1).schema)
    once = daily_rows(spark, state)
    raw_once = ST.stored_page_log(spark, state).count()
    ST.run_page_stream(spark, landing, state, views(spark, 0, 1).schema)   # nothing new
    assert daily_rows(spark, state) == once and ST.stored_page_log(spark, state).count() == raw_once == 20
    # re-delivery of the same rows plus new ones in a later run: only new rows count
    views(spark, 10, 20, name="Q").write.mode("append").parquet(landing)
    ST.run_page_stream(spark, landing, state, views(spark, 0, 1).schema)
    assert ST.stored_page_log(spark, state).count() == 30
    before = daily_rows(spark, state)
    assert sum(r[4] for r in before) == 30
    ST.compact_daily(spark, state)
    assert daily_rows(spark, state) == before
    # a batch after compaction still names the page
    views(spark, 40, 4, name="R").write.mode("append").parquet(landing)
    ST.run_page_stream(spark, landing, state, views(spark, 0, 1).schema)
    after = daily_rows(spark, state)
    assert sum(r[4] for r in after) == 34
    # the four groups the newest batch touched now carry its page name
    assert sum(1 for r in after if r[5] == "R") == 4


def test_retried_micro_batch_is_idempotent(spark):
    state = ST.State(tempfile.mkdtemp(prefix="al-retry-"))
    b1, b2 = views(spark, 0, 10), views(spark, 5, 10)
    ST.ingest_page_batch(spark, state, b1, 1)
    ST.ingest_page_batch(spark, state, b2, 2)
    first = daily_rows(spark, state)
    ST.ingest_page_batch(spark, state, b2, 2)          # the same batch again (retry)
    assert daily_rows(spark, state) == first
    assert ST.stored_page_log(spark, state).count() == 15


def test_late_row_lost_when_strict_kept_with_lookback(spark):
    stored = L.scan_page_views(views(spark, 0, 5))
    wm = stored.agg(F.max("Timestamp")).first()[0]
    late = views(spark, 2, 1).withColumn("Id", F.lit(99)).withColumn("UserId", F.lit("late"))
    feed = views(spark, 0, 5).unionByName(late)
    strict = L.scan_page_views(feed, since=wm)
    assert strict.count() == 0
    overlap = L.scan_page_views(feed, since=wm, lookback=dt.timedelta(hours=1))
    new = D.insert_if_absent(overlap, stored, D.page_key(), order=["Id"])
    assert rows(new, "Id") == [(99,)]


def test_change_batches_dedup_across_runs(spark):
    state = ST.State(tempfile.mkdtemp(prefix="al-chg-"))
    entry = "struct<Entry_No:bigint,Date_and_Time:timestamp_ntz,User_ID:string,Table_No:string," \
            "Table_Caption:string,Field_No:string,Field_Caption:string,Type_of_Change:string," \
            "Primary_Key:string,Old_Value:string,New_Value:string>"

    def page(company, lo, hi):
        vals = [(n, T0, "U", "18", "Customer", "1", "Name", "Modification", "k", "a", "b") for n in range(lo, hi)]
        return (company, vals)

    schema = f"Company string, value array<{entry}>"
    ST.ingest_change_batch(spark, state, spark.createDataFrame([page("A", 1, 6), page("B", 1, 3)], schema), 1)
    ST.ingest_change_batch(spark, state, spark.createDataFrame([page("A", 4, 9), page("A", 4, 9)], schema), 2)
    out = ST.stored_change_log(spark, state)
    assert out.count() == 8 + 2 and out.select("CompanyName", "EntryNo").distinct().count() == 10


def test_processing_time_trigger_keeps_running_and_ingests_new_files(spark):
    root = tempfile.mkdtemp(prefix="al-ptime-")
    landing, state = f"{root}/landing", ST.State(f"{root}/state")
    views(spark, 0, 6).write.parquet(landing)
    q = ST.run_page_stream(spark, landing, state, views(spark, 0, 1).schema, processing_time="1 second")
    try:
        q.processAllAvailable()
        assert ST.stored_page_log(spark, state).count() == 6
        views(spark, 6, 4).write.mode("append").parquet(landing)
        q.processAllAvailable()
        assert ST.stored_page_log(spark, state).count() == 10
        assert q.isActive
    finally:
        q.stop()


def test_quarantined_rows_are_kept_aside(spark):
    state = ST.State(tempfile.mkdtemp(prefix="al-quar-"))
    batch = views(spark, 0, 4).withColumn("UserId", F.when(F.col("Id") == 2, F.lit("")).otherwise(F.col("UserId")))
    ST.ingest_page_batch(spark, state, batch, 7)
    assert ST.stored_page_log(spark, state).count() == 3
    q = spark.read.parquet(state.path(ST.PAGE_QUARANTINE))
    assert [(r.Id, r.BatchId) for r in q.collect()] == [(2, 7)]


def test_page_log_compaction_per_day_shows_every_row_once_at_any_moment(spark, monkeypatch):
    state = ST.State(tempfile.mkdtemp(prefix="al-pcomp-"))
    ST.ingest_page_batch(spark, state, views(spark, 0, 10), 1_000_000_001)
    ST.ingest_page_batch(spark, state, views(spark, 10, 10), 1_000_000_002)
    before = rows(ST.stored_page_log(spark, state))
    # stopped after the compacted day appeared: its leftovers are not read again
    with monkeypatch.context() as m:
        real = ST.remove
        m.setattr(ST, "remove", lambda sp, path: real(sp, path) if "_staging" in path else (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            ST.compact_page_log(spark, state)
    day = f"{state.path(ST.PAGE_RAW)}/DateKey={T0:%Y-%m-%d}"
    assert len(ST.markers(spark, day, "BatchId")) > 1
    assert rows(ST.stored_page_log(spark, state)) == before
    ST.compact_page_log(spark, state)
    assert all(b < 0 for b in ST.markers(spark, day, "BatchId")) and rows(ST.stored_page_log(spark, state)) == before
    # a replay of an already stored batch still finds its rows in the compacted history
    ST.ingest_page_batch(spark, state, views(spark, 10, 10), 1_000_000_002)
    assert rows(ST.stored_page_log(spark, state)) == before
    assert ST.compact_page_log(spark, state) == []


def test_page_retention_hides_the_rest_of_the_cutoffs_day(spark):
    state = ST.State(tempfile.mkdtemp(prefix="al-pret-"))
    ST.ingest_page_batch(spark, state, views(spark, 0, 60), 1_000_000_001)
    hits = ST.daily_table(spark, state).agg(F.sum("Hits")).first()[0]
    times = sorted(r.Timestamp for r in ST.stored_page_log(spark, state).collect())
    cutoff = times[30]
    gone = ST.retain_page_log(spark, state, cutoff)
    assert gone == sorted({f"DateKey={t:%Y-%m-%d}" for t in times if t.date() < cutoff.date()})
    assert sorted(r.Timestamp for r in ST.stored_page_log(spark, state).collect()) == [t for t in times if t >= cutoff]
    assert ST.daily_table(spark, state).agg(F.sum("Hits")).first()[0] == hits


def test_rows_later_than_the_lookback_are_kept_aside(spark):
    state = ST.State(tempfile.mkdtemp(prefix="al-late-"))
    ST.ingest_page_batch(spark, state, views(spark, 20, 10), 1)
    newest = ST.newest_in_days(spark, state.path(ST.PAGE_RAW))
    assert newest == max(r.Timestamp for r in ST.stored_page_log(spark, state).collect())
    plan = ST.newest_first(spark.read.parquet(state.path(ST.PAGE_RAW)), "Timestamp")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "TakeOrderedAndProject" in plan
    batch = views(spark, 0, 25)
    look = newest - sorted(r.Timestamp for r in batch.collect())[12]
    for _ in range(2):                                     # a retried batch judges its rows as before
        ST.ingest_page_batch(spark, state, batch, 2, look)
        late = sorted(r.Id for r in ST.late_rows(spark, state).collect())
        assert late and sorted(r.Id for r in ST.stored_page_log(spark, state).collect()) == sorted(set(range(30)) - set(late))


def test_daily_base_vacuum_keeps_the_grace_version(spark):
    state = ST.State(tempfile.mkdtemp(prefix="al-vac-"))
    total, folders = 0, []
    slow = None
    for k in range(1, 13):
        ST.ingest_page_batch(spark, state, views(spark, 10 * k, 10), k)
        total += 10
        if k == 12:
            slow = ST.daily_table(spark, state)            # begins before the last compaction, ends after its vacuum
        ST.compact_daily(spark, state)
        ST.vacuum_daily(spark, state)
        folders.append(len(ST.names(spark, state.path(ST.DAILY_BASE))) + len(ST.markers(spark, state.path(ST.PAGE_DELTAS), "BatchId")))
        assert ST.daily_table(spark, state).agg(F.sum("Hits")).first()[0] == total
    assert max(folders) <= 4 and slow.agg(F.sum("Hits")).first()[0] == total


def test_raw_telemetry_json_landing_is_flattened_by_the_stream(spark):
    import json
    from auditlake.sources import landing as L
    root = tempfile.mkdtemp(prefix="al-tele-")
    landing, state = f"{root}/landing", ST.State(f"{root}/state")
    recs = [(T0 + dt.timedelta(minutes=i), f"g{i % 2}", "WebClient" if i % 3 else "Background",
             json.dumps({"alObjectId": str(i % 4), "alObjectName": "Page", "companyName": "CO"})) for i in range(9)]
    spark.createDataFrame(recs, L.TELEMETRY_SCHEMA).write.json(landing)
    ST.run_page_stream(spark, landing, state, L.TELEMETRY_SCHEMA, fmt="json")
    stored = ST.stored_page_log(spark, state)
    assert stored.count() == 6 and {r.CompanyName for r in stored.collect()} == {"CO"}


def test_unusable_rows_of_all_modules_go_to_quarantine_once(spark):
    from auditlake.streaming.daily_run import ingest_auth_failures
    state = ST.State(tempfile.mkdtemp(prefix="al-quar3-"))
    # A: a view without a time, delivered twice, is never stored nor counted
    batch = views(spark, 0, 4).withColumn("Timestamp", F.when(F.col("Id") != 2, F.col("Timestamp")))
    for n in (1, 2):
        ST.ingest_page_batch(spark, state, batch, n)
    assert rows(ST.stored_page_log(spark, state), "Id") == [(0,), (1,), (3,)]
    assert rows(spark.read.parquet(state.path(ST.PAGE_QUARANTINE)), "Id", "BatchId") == [(2, 1), (2, 2)]
    # B: entries without number or time, and a page that is no document
    entry = "struct<Entry_No:bigint,Date_and_Time:timestamp_ntz,User_ID:string,Table_No:string," \
            "Table_Caption:string,Field_No:string,Field_Caption:string,Type_of_Change:string," \
            "Primary_Key:string,Old_Value:string,New_Value:string>"
    rest = ("U", "18", "T", "1", "F", "Insertion")
    entries = [(1, T0, *rest, "a", "", ""), (None, T0, *rest, "b", "", ""), (None, T0, *rest, "c", "", ""),
               (4, None, *rest, "d", "", "")]
    pages = spark.createDataFrame([("A", entries), ("B", None)], f"Company string, value array<{entry}>")
    for _ in range(2):                                    # a retried batch replaces its own rows
        ST.ingest_change_batch(spark, state, pages, 1)
    assert rows(ST.stored_change_log(spark, state), "PrimaryKey") == [("a",)]
    kept = spark.read.parquet(state.path(ST.CHANGE_QUARANTINE))
    assert rows(kept, "CompanyName", "PrimaryKey") == sorted([("A", "b"), ("A", "c"), ("A", "d"), ("B", None)], key=repr)
    # a first batch with nothing usable leaves no table behind
    empty = ST.State(tempfile.mkdtemp(prefix="al-quar4-"))
    ST.ingest_change_batch(spark, empty, pages.filter("Company = 'B'"), 1)
    assert ST.change_store(spark, empty).versions.newest() is None
    # C: re-pulled unusable traces are held once
    cols = ["EventId", "PermissionType", "ObjectType", "ObjectNo", "ObjectName", "CompanyName", "ErrorMessage"]
    traces = spark.createDataFrame([(1, T0, "u"), (2, T0, None), (3, None, "u")],
                                   "Id long, Timestamp timestamp_ntz, UserId string")
    traces = traces.select("*", *[F.lit("RT0031" if c == "EventId" else "x").alias(c) for c in cols])
    for _ in range(2):
        ingest_auth_failures(spark, state, traces, repull=True)
        ingest_auth_failures(spark, state, traces)
    assert spark.read.parquet(state.path("auth_fail_raw")).count() == 1
    assert rows(spark.read.parquet(state.path(ST.AUTH_QUARANTINE)), "Id") == [(2,), (3,)]
