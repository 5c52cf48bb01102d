import datetime as dt
import json
import tempfile

from pyspark.sql import functions as F

from auditlake.operators import health as H
from auditlake.plans.snapshot import Settings
from auditlake.sources import sinks as S
from auditlake.streaming import ingest as ST
from auditlake.streaming import daily_run as DR
from auditlake.streaming.daily_run import AUTH_DAILY, AUTH_RAW, DailyRun
from conftest import rows

FEED = "Id long, Timestamp timestamp_ntz, UserId string, UserName string, PageId string, PageName string, " \
       "CompanyName string, ClientType string"
T0 = dt.datetime(2024, 1, 1, 8)


def page_rows(spark, lo, hi):
    return spark.createDataFrame([(k, T0 + dt.timedelta(hours=k), f"u{k % 2}", f"u{k % 2}", str(k % 3), "P",
                                   "CO", "Web") for k in range(lo, hi)], FEED)


def traces(spark, lo, hi):
    def f():
        return spark.createDataFrame(
            [(k, T0 + dt.timedelta(hours=k), f"g{k % 2}", "RT0031", "Read", "TableData", str(k % 5), "",
              "CO", "Missing permission") for k in range(lo, hi)],
            "Id long, Timestamp timestamp_ntz, UserId string, EventId string, PermissionType string, "
            "ObjectType string, ObjectNo string, ObjectName string, CompanyName string, ErrorMessage string")
    return f


def land_changes(spark, landing, company, lo, hi):
    entries = spark.createDataFrame(
        [(company, n, T0 + dt.timedelta(days=n), "U1", 18, "Customer", 1, "Name", "Insertion", "k", "", "x")
         for n in range(lo, hi)],
        "Company string, Entry_No long, Date_and_Time timestamp_ntz, User_ID string, Table_No int, "
        "Table_Caption string, Field_No int, Field_Caption string, Type_of_Change string, Primary_Key string, "
        "Old_Value string, New_Value string")
    ST.land_change_pages(entries, landing)


def test_daily_run_modes(spark):
    root = tempfile.mkdtemp(prefix="al-pipe-")
    pages, changes = f"{root}/landing/pages", f"{root}/landing/changes"
    page_rows(spark, 0, 48).write.parquet(pages)
    land_changes(spark, changes, "CO_A", 1, 30)
    land_changes(spark, changes, "CO_B", 1, 10)
    p = DailyRun(spark, f"{root}/state", page_landing=pages, page_schema=page_rows(spark, 0, 1).schema,
                 change_landing=changes, traces=traces(spark, 0, 30))
    p.run("ingest")
    raw = lambda: ST.stored_page_log(spark, p.pages).count()          # noqa: E731
    chg = lambda: ST.stored_change_log(spark, p.changes).count()      # noqa: E731
    err = lambda: spark.read.parquet(p.errors.path(AUTH_RAW)).count()
    assert (raw(), chg(), err()) == (48, 38, 30)
    p.run("ingest")                                                   # twice = once
    assert (raw(), chg(), err()) == (48, 38, 30)

    # purge-only run: ingest is skipped even though new files wait
    page_rows(spark, 48, 60).write.mode("append").parquet(pages)
    p.run("purge", purge=[" CO_B ", ""])
    assert raw() == 48 and chg() == 29
    assert ST.stored_change_log(spark, p.changes).filter(F.col("CompanyName") == "CO_B").count() == 0

    # compaction folds the small partitions without changing any result
    daily_before = sorted(tuple(r) for r in ST.daily_table(spark, p.pages).collect())
    p.compact()
    assert chg() == 29 and sorted(tuple(r) for r in ST.daily_table(spark, p.pages).collect()) == daily_before

    # re-pull of module C from the start is idempotent; the next ingest picks up new pages
    p.traces = traces(spark, 0, 40)
    p.run("repull")
    assert err() == 40 and raw() == 60
    daily = spark.read.parquet(p.errors.path(AUTH_DAILY))
    assert daily.agg(F.sum("Failures")).first()[0] == 40

    # retention drops raw page partitions but the daily rollup keeps the history
    hits_before = ST.daily_table(spark, p.pages).agg(F.sum("Hits")).first()[0]
    p.settings = Settings(page_retention_months=1)                  # from 2024-01-02 12:00
    p.run("ingest", as_of=dt.datetime(2024, 2, 2, 12))
    assert all(code == 0 for _, code, _ in p.log), p.log
    kept = ST.stored_page_log(spark, p.pages)
    assert kept.agg(F.min("Timestamp")).first()[0] >= dt.datetime(2024, 1, 2, 12)
    assert kept.count() < 60
    assert ST.daily_table(spark, p.pages).agg(F.sum("Hits")).first()[0] == hits_before == 60


def test_status_upsert_per_module(spark):
    root = tempfile.mkdtemp(prefix="al-status-")
    p = DailyRun(spark, root)
    cloud = [spark.createDataFrame([("A", 10)], "Module string, CloudCount long")]
    page_rows(spark, 0, 5).write.parquet(f"{root}/l")
    p.page_landing, p.page_schema = f"{root}/l", page_rows(spark, 0, 1).schema
    p.run("ingest")
    s1 = p.status(dt.datetime(2024, 1, 2), cloud).collect()
    assert [(r.Module, r.LocalCount, r.Pct) for r in s1] == [("A", 5, 50)]
    cloud2 = [spark.createDataFrame([("A", 5)], "Module string, CloudCount long")]
    s2 = p.status(dt.datetime(2024, 1, 3), cloud2).collect()
    assert [(r.Module, r.CloudCount, r.Pct, r.UpdatedAt) for r in s2] == [("A", 5, 100, dt.datetime(2024, 1, 3))]


def change_feed(spark, spec):
    def f():
        return spark.createDataFrame(
            [(c, n, T0 + dt.timedelta(days=n), "U1", "18", "Customer", "1", "Name", "Insertion", "k", "", "x")
             for c, lo, hi in spec for n in range(lo, hi)],
            "Company string, Entry_No long, Date_and_Time timestamp_ntz, User_ID string, Table_No string, "
            "Table_Caption string, Field_No string, Field_Caption string, Type_of_Change string, Primary_Key string, "
            "Old_Value string, New_Value string")
    return f


def directory(spark, people):
    def f():
        return spark.createDataFrame([(f"{{{i}}}", f"g{i}", f"U{i}", name, f"u{i}@x", "Enabled") for i, name in people],
                                     "User_Security_ID string, Telemetry_User_ID string, User_Name string, Full_Name string, "
                                     "Authentication_Email string, State string")
    return f


def full_run(spark, root, **changes):
    pages = f"{root}/landing/pages"
    page_rows(spark, 0, 30).write.mode("append").parquet(pages)
    given = dict(page_landing=pages, page_schema=page_rows(spark, 0, 1).schema, change_landing=f"{root}/landing/changes",
                 changes_feed=change_feed(spark, [("CO_A", 1, 41), ("CO_B", 1, 21)]), traces=traces(spark, 0, 10),
                 directory=directory(spark, [(0, "Ann"), (1, "Bob")]),
                 page_map=lambda: spark.createDataFrame([("1", 18, "Customer")], "PageId string, TableNo int, TableName string"),
                 cloud=lambda: [spark.createDataFrame([("A", 30), ("B", 60)], "Module string, CloudCount long")],
                 settings=Settings(forward_cap=5, backfill_cap=4, seed_rows=10, top_rows=100, auto_purge_on_remove=True))
    return DailyRun(spark, f"{root}/state", **{**given, **changes})


def stored(spark, p):
    out = {}
    for r in ST.stored_change_log(spark, p.changes).collect():
        out.setdefault(r.CompanyName, []).append(r.EntryNo)
    return {c: (min(v), max(v), len(v)) for c, v in out.items()}


def test_run_takes_changes_through_the_cursor_and_publishes(spark):
    root = tempfile.mkdtemp(prefix="al-full-")
    p = full_run(spark, root)
    at = dt.datetime(2024, 1, 20, 6)
    p.run(as_of=at)
    assert [(s, c) for s, c, _ in p.log] == [(s, 0) for s in ("selection", "modul A", "modul C", "modul B", "uzivatele", "sync-status",
                                                              "snapshot")], p.log
    assert stored(spark, p) == {"CO_A": (27, 40, 14), "CO_B": (7, 20, 14)}     # seed 10, then 4 below
    p.changes_feed = change_feed(spark, [("CO_A", 1, 60), ("CO_B", 1, 21)])
    p.run(as_of=at + dt.timedelta(days=1))
    assert stored(spark, p) == {"CO_A": (23, 45, 23), "CO_B": (3, 20, 18)}     # forward 5, backfill 4
    back = S.read_snapshot(spark, p.snapshot_path)
    assert set(back) == {"generatedUtc", "kpi", "sync", "dbSize", "dbTables", "changeLogByCompany", "pageRange", "auditRange", "userActivity",
                         "trend", "trendByCompany", "authFails", "changeLog", "tableAccess", "pageMapCount"}
    assert back["generatedUtc"].first()[0] == "2024-01-21 06:00:00"
    assert rows(back["changeLogByCompany"]) == [("CO_A", 23), ("CO_B", 18)]
    assert [(r.Module, r.CloudCount, r.LocalCount) for r in back["sync"].collect()] == [("A", 30, 30), ("B", 60, 41), ("C", None, 10)]
    assert rows(p.users.user_map()) == [("g0", "Ann"), ("g1", "Bob")]
    assert rows(p.table_names(), "TableNo", "TableName") == [(18, "Customer")]
    steps = {(r.Step, r.ExitCode) for r in p.run_log().collect() if r.Step}
    assert steps == {(s, 0) for s in ("modul A", "modul C", "modul B", "uzivatele", "sync-status", "snapshot")}


def test_failing_step_does_not_stop_the_rest(spark):
    def broken():
        raise OSError("no connection")
    p = full_run(spark, tempfile.mkdtemp(prefix="al-broken-"))
    p.run(as_of=dt.datetime(2024, 1, 20, 6))
    p.changes_feed = p.cloud = broken
    p.run(as_of=dt.datetime(2024, 1, 21, 6))
    codes = {s: c for s, c, _ in p.log[7:]}
    assert codes == {"selection": 0, "modul A": 0, "modul C": 0, "modul B": 1, "uzivatele": 0, "sync-status": 1, "snapshot": 0}
    assert "no connection" in dict((s, d) for s, _, d in p.log[7:])["modul B"]
    failed = H.step_status(p.run_log(), ["modul A", "modul B"]).filter("Failed")
    assert [r.Step for r in failed.collect()] == ["modul B"]


def test_purge_request_survives_a_kill_between_claim_and_acknowledgement(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="al-req-")
    p = full_run(spark, root)
    p.run(as_of=dt.datetime(2024, 1, 20, 6))
    p.requests.submit([" CO_B ", "", "CO_B"])
    page_rows(spark, 30, 40).write.mode("append").parquet(f"{root}/landing/pages")

    class Killed(BaseException):
        pass

    with monkeypatch.context() as m:
        m.setattr(DR, "purge_companies", lambda *a: (_ for _ in ()).throw(Killed()))
        try:
            p.run(as_of=dt.datetime(2024, 1, 21, 6))
        except Killed:
            pass
    assert len(p.requests.pending()) == 1 and "CO_B" in stored(spark, p)
    done = len(p.log)
    p.run(as_of=dt.datetime(2024, 1, 22, 6))               # an ordinary run: only the purge, then the snapshot
    assert [(s, c) for s, c, _ in p.log[done:]] == [("selection", 0), ("purge", 0), ("snapshot", 0)] and p.log[done + 1][2] == 14
    assert set(stored(spark, p)) == {"CO_A"} and p.requests.pending() == []
    assert ST.stored_page_log(spark, p.pages).count() == 30
    back = S.read_snapshot(spark, p.snapshot_path)
    assert rows(back["changeLogByCompany"]) == [("CO_A", 14)] and back["generatedUtc"].first()[0] == "2024-01-22 06:00:00"
    p.run(as_of=dt.datetime(2024, 1, 23, 6))               # then all steps again
    assert ST.stored_page_log(spark, p.pages).count() == 40


def test_deselected_company_is_purged_if_the_settings_say_so(spark):
    p = full_run(spark, tempfile.mkdtemp(prefix="al-sel-"))
    p.run(as_of=dt.datetime(2024, 1, 20, 6))
    p.settings = Settings(enabled_companies=["CO_A", "CO_C"], forward_cap=5, backfill_cap=0, seed_rows=10, top_rows=100)
    p.run(as_of=dt.datetime(2024, 1, 21, 6))
    assert set(stored(spark, p)) == {"CO_A", "CO_B"}        # not asked for: the rows stay, no more are fetched
    p.settings = Settings(enabled_companies=["CO_A"], forward_cap=5, backfill_cap=0, seed_rows=10, top_rows=100, auto_purge_on_remove=True)
    p.run(as_of=dt.datetime(2024, 1, 22, 6))
    assert set(stored(spark, p)) == {"CO_A", "CO_B"}        # CO_C held nothing, CO_B was deselected before
    p.settings = Settings(enabled_companies=["CO_B"], forward_cap=5, backfill_cap=0, seed_rows=10, top_rows=100, auto_purge_on_remove=True)
    p.run(as_of=dt.datetime(2024, 1, 23, 6))
    assert set(stored(spark, p)) == {"CO_B"}
    p.settings = Settings(audit_retention_months="many")
    try:
        p.run()
        raise AssertionError("a bad setting must raise")
    except ValueError:
        pass


def test_users_keep_their_history_and_the_map_follows(spark):
    from auditlake.streaming.users import UserStore
    u = UserStore(spark, tempfile.mkdtemp(prefix="al-users-"))
    assert u.users().count() == 0 and u.user_map() is None
    days = [dt.datetime(2024, 1, d) for d in range(1, 6)]
    from auditlake.sources import landing as L
    for day, people in zip(days, [[(0, "Ann"), (1, "Bob")], [(0, "Ann"), (1, "Rob")], [(0, "Ann")], [(0, "Ann"), (1, "Rob")],
                                  [(0, "Ann"), (1, "Rob"), (1, "Rob")]]):
        u.load(L.read_user_directory(directory(spark, people)()), day)
    got = sorted((r.UserSecurityId, r.FullName, r.ValidFrom.day, r.ValidTo and r.ValidTo.day, r.UpdatedAt.day,
                  r.DepartedAt and r.DepartedAt.day) for r in u.history().collect())
    assert got == [("0", "Ann", 1, None, 5, None), ("1", "Bob", 1, 2, 1, None), ("1", "Rob", 2, 4, 2, 3), ("1", "Rob", 4, None, 5, None)]
    manual = spark.createDataFrame([("g1", "Manual"), ("g9", "Temp")], "UserId string, Name string")
    u.load(L.read_user_directory(directory(spark, [(0, "Ann")])()), dt.datetime(2024, 1, 6), manual)
    assert rows(u.user_map()) == [("g0", "Ann"), ("g1", "Rob"), ("g9", "Temp")]       # departed users stay


def test_company_count_is_carried_over_in_the_same_scope(spark):
    from auditlake.streaming.ingest import State
    state = State(tempfile.mkdtemp(prefix="al-conn-"))
    at = dt.datetime(2024, 1, 1)
    for tenant, env, n, want in [("t", "prod", 7, 7), ("t", "prod", None, 7), ("t", "test", None, None), ("t", "prod", None, None)]:
        assert DR.record_connection(spark, state, tenant, env, n, at).first().Companies == want
