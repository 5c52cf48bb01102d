"""Operations queries: retention, purge, selection, sync health, filters, exports, streams."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from auditlake.functions import columns as C
from auditlake.functions.joins import materialized
from auditlake.operators import dedup as D
from auditlake.operators import filters as FL
from auditlake.operators import health as H
from auditlake.operators import identity as ID
from auditlake.operators import retention as RT
from auditlake.operators import views as V
from auditlake.plans import tables as TB
from auditlake.plans.q_audit import _stored_subset, stored_part
from auditlake.plans.oracle_ctes import extra
from auditlake.plans.registry import query, sql
from auditlake.session import read_table, scratch_path
from auditlake.sources import fixtures as X
from auditlake.sources import landing as L
from auditlake.sources import sinks as S
from auditlake.plans.snapshot import Settings, snapshot_sections
from auditlake.streaming import ingest as ST
from auditlake.streaming.daily_run import DailyRun

# Fixed scenario parameters.
PAGES_AS_OF = dt.datetime(2024, 2, 15)
PAGES_KEEP_MONTHS = 1
CHANGES_AS_OF = dt.datetime(2001, 8, 2)
PURGE_REQUEST = [" CO_2 ", "CO_4", "", "CO_2"]
PREVIOUSLY_ENABLED = ["CO_0", "CO_1", "CO_2", "CO_3", "CO_9"]
NOW_ENABLED = ["CO_1", "CO_3"]
PENDING_PURGE = ["CO_4"]
HEALTH_AS_OF = dt.datetime(2024, 1, 31, 12, 0, 0)
FILTER_SPEC = FL.FilterSpec(contains={"TableName": "ABLE 1"}, equals={"ChangeType": "Deletion"},
                            date_range={"ChangedAt": ("1996.01.01", "1996.12.31")})
PAGE_NO, PAGE_SIZE = 3, 100
SECRET_WARN_DAYS = 30
LATE_SPLIT = dt.datetime(2024, 1, 20)
LOOKBACK = dt.timedelta(days=5)
LATE_EVERY = 10
STREAM_CUTS = [dt.datetime(2024, 1, 8, 12), dt.datetime(2024, 1, 16, 12), dt.datetime(2024, 1, 23, 12)]
CHANGE_FIRST_LANDING_END = dt.datetime(1998, 1, 1)


@query("retention_pages", "R1 R5", sql("""
SELECT Id, "Timestamp", UserId, UserName, PageId, PageName, CompanyName FROM page_log
WHERE "Timestamp" >= TIMESTAMP '2024-01-15 00:00:00'""", "page_log"))
def retention_pages(spark, sf_dir):
    """Raw page log after retention (as of 2024-02-15, keep 1 month)."""
    months = RT.retention_months(PAGES_KEEP_MONTHS, RT.PAGE_RETENTION_MONTHS)
    return RT.retain(TB.page_log(spark, sf_dir), "Timestamp", PAGES_AS_OF, months)


@query("retention_changes", "R2", sql("""
SELECT * FROM change_log WHERE ChangedAt >= TIMESTAMP '1999-08-02 00:00:00'""", "change_log"))
def retention_changes(spark, sf_dir):
    """Audit after the default 24-month retention as of 2001-08-02."""
    return RT.retain(TB.change_log(spark, sf_dir), "ChangedAt", CHANGES_AS_OF, RT.AUDIT_RETENTION_MONTHS)


def _purge(spark, sf_dir):
    log = TB.change_log(spark, sf_dir)
    req = RT.normalize_names(spark, PURGE_REQUEST)
    RT.validate_known(req, L.company_list(log))
    return RT.purge_companies(log, req)


@query("purge_companies", "R3 P15 J7", sql("""
SELECT CompanyName, COUNT(*) AS DeletedRows FROM change_log WHERE CompanyName IN ('CO_2', 'CO_4')
GROUP BY CompanyName""", "change_log"))
def purge_companies(spark, sf_dir):
    """Rows deleted per purged company (request normalised and validated)."""
    return _purge(spark, sf_dir)[1]


@query("purged_change_log", "R3 J7", sql("""
SELECT * FROM change_log WHERE CompanyName NOT IN ('CO_2', 'CO_4')""", "change_log"))
def purged_change_log(spark, sf_dir):
    return _purge(spark, sf_dir)[0]


@query("removed_companies", "R4 U1 U2", sql("""
SELECT CompanyName FROM (
  (SELECT CompanyName FROM (VALUES ('CO_0'), ('CO_1'), ('CO_2'), ('CO_3'), ('CO_9')) p(CompanyName)
   INTERSECT SELECT DISTINCT CompanyName FROM change_log)
  EXCEPT SELECT CompanyName FROM (VALUES ('CO_1'), ('CO_3')) n(CompanyName)) r
UNION SELECT 'CO_4'""", "change_log"))
def removed_companies(spark, sf_dir):
    """Companies to purge after the selection changed (auto-purge on), merged
    with the pending purge request."""
    known = L.company_list(TB.change_log(spark, sf_dir))
    prev = RT.normalize_names(spark, PREVIOUSLY_ENABLED)
    now = RT.normalize_names(spark, NOW_ENABLED)
    removed = RT.removed_companies(prev, known, now)
    return RT.queue_purge(RT.normalize_names(spark, PENDING_PURGE), removed)


extra("sync_counts", ("page_views", "page_log", "change_log", "cl_stored", "trace_feed", "auth_fail_raw"), """
SELECT 'A' AS Module, (SELECT COUNT(*) FROM page_views) AS CloudCount,
       (SELECT COUNT(*) FROM page_views WHERE ClientType IN ('WebClient', 'Web', 'Desktop', 'Tablet', 'Phone'))
         AS CloudInteractive,
       (SELECT COUNT(*) FROM page_log) AS LocalCount
UNION ALL SELECT 'B', (SELECT COUNT(*) FROM change_log), NULL, (SELECT COUNT(*) FROM cl_stored)
UNION ALL SELECT 'C', (SELECT COUNT(*) FROM trace_feed WHERE EventId = 'RT0031'), NULL,
                 (SELECT COUNT(*) FROM auth_fail_raw)""")


def _pct(local: str, cloud: str) -> str:
    local, cloud = f"COALESCE({local}, 0)", f"COALESCE({cloud}, 0)"
    return (f"CAST(CASE WHEN {cloud} > 0 THEN round_even(100.0 * {local} / {cloud}, 0) "
            f"WHEN {cloud} = 0 AND {local} > 0 THEN 100 ELSE 0 END AS BIGINT)")


@query("sync_status", "A15 D8", sql(f"""
SELECT Module, CloudCount, CloudInteractive, LocalCount, {_pct('LocalCount', 'CloudCount')} AS Pct,
       TIMESTAMP '2024-01-31 12:00:00' AS UpdatedAt FROM sync_counts""", "sync_counts"))
def sync_status(spark, sf_dir):
    """Feed vs stored counts per module. Module A's feed count has no client
    filter (as in the reference), so the interactive feed count is shown too."""
    return H.sync_status([_module_counts(spark, sf_dir)], [], HEALTH_AS_OF).select(
        "Module", "CloudCount", "CloudInteractive", "LocalCount", "Pct", "UpdatedAt").orderBy("Module")


def _module_counts(spark, sf_dir):
    """The three modules' counts, by one scan of each feed: what was delivered, and what is stored of it."""
    rows = F.count(F.lit(1))
    views = X.page_views(spark, sf_dir)
    interactive = C.is_interactive("ClientType")
    usable = F.col("Timestamp").isNotNull() & (F.trim("UserId") != "")
    a = H.module_counts(views, "A", CloudCount=rows, CloudInteractive=F.count_if(interactive),
                        LocalCount=H.stored_keys(interactive & usable, *D.page_key()))
    none = F.max(F.lit(None).cast("long"))
    b = H.module_counts(TB.change_rows(spark, sf_dir), "B", CloudCount=rows, CloudInteractive=none,
                        LocalCount=F.count_if(stored_part()))
    c = H.module_counts(TB.auth_labels(spark, sf_dir), "C", CloudCount=rows, CloudInteractive=none,
                        LocalCount=H.stored_keys(usable, *D.auth_key()))
    return a.unionByName(b).unionByName(c)


@query("sync_total", "A20", sql(f"""
SELECT CAST(SUM(LocalCount) AS BIGINT) AS LocalCount, CAST(SUM(CloudCount) AS BIGINT) AS CloudCount,
       {_pct('SUM(LocalCount)', 'SUM(CloudCount)')} AS Pct FROM sync_counts""", "sync_counts"))
def sync_total(spark, sf_dir):
    return H.sync_total(sync_status(spark, sf_dir))


extra("newest", ("page_log", "change_log", "auth_fail_raw"), """
SELECT 'A' AS Section, (SELECT MAX("Timestamp") FROM page_log) AS Newest
UNION ALL SELECT 'B', (SELECT MAX(ChangedAt) FROM change_log)
UNION ALL SELECT 'C', (SELECT MAX("Timestamp") FROM auth_fail_raw)""")

FRESH_SQL = """
SELECT Section, Newest, round_even(date_diff('microsecond', Newest, TIMESTAMP '2024-01-31 12:00:00') / 3600000000.0, 1)
       AS LagHours,
       COALESCE(round_even(date_diff('microsecond', Newest, TIMESTAMP '2024-01-31 12:00:00') / 3600000000.0, 1) > 24,
                false) AS Stale
FROM newest"""


def _newest_rows(spark, sf_dir):
    """Newest row per module. ``Timestamp`` is part of the raw tables' dedup
    keys, so deduplication cannot change its maximum: the cleaned feeds give
    the same answer without the dedup shuffle."""
    pages, _ = L.split_quarantine(TB.interactive_views(spark, sf_dir), L.PAGE_REQUIRED)
    return (V.newest(pages, "Timestamp", "A")
            .unionByName(V.newest(TB.change_log(spark, sf_dir), "ChangedAt", "B"))
            .unionByName(V.newest(TB.auth_labels(spark, sf_dir), "Timestamp", "C")))


def _freshness(spark, sf_dir):
    return H.freshness(_newest_rows(spark, sf_dir), HEALTH_AS_OF)


@query("freshness", "H1 A18", sql(FRESH_SQL, "newest"))
def freshness(spark, sf_dir):
    """Hours since the newest row per module (UTC), stale beyond 24 h."""
    return _freshness(spark, sf_dir)


@query("filtered_table", "P13", sql("""
SELECT * FROM change_log WHERE lower(TableName) LIKE '%able 1%' AND ChangeType = 'Deletion'
  AND CAST(ChangedAt AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'""", "change_log"))
def filtered_table(spark, sf_dir):
    """Audit table with a text, a dropdown and a date-range filter."""
    return FL.apply_filters(TB.change_log(spark, sf_dir), FILTER_SPEC)


@query("page_of_rows", "T9 T8", sql("""
SELECT * FROM change_log ORDER BY ChangedAt DESC, CompanyName, EntryNo DESC LIMIT 100 OFFSET 300""",
                                     "change_log"))
def page_of_rows(spark, sf_dir):
    """Fourth page of 100 rows of the audit, newest first."""
    return V.page_of_rows(TB.change_log(spark, sf_dir),
                          [F.col("ChangedAt").desc(), F.col("CompanyName").asc(), F.col("EntryNo").desc()],
                          PAGE_NO, PAGE_SIZE)


def _bars(value: str) -> str:
    return f"""CAST(LEAST(CASE WHEN r < 1 AND {value} > 0 THEN 1 ELSE r END, 100) AS INTEGER)"""


@query("top_users", "T5 W5 A16", sql(f"""
SELECT Label, Value, {_bars('Value')} AS Bar FROM (
  SELECT *, CASE WHEN MAX(Value) OVER () > 0 THEN round_even(100.0 * Value / MAX(Value) OVER (), 0) ELSE 0 END AS r
  FROM (SELECT COALESCE((SELECT MAX(Name) FROM user_map m WHERE m.UserId = t.UserName), UserName) AS Label, Value
        FROM (SELECT UserName, CAST(SUM(Hits) AS BIGINT) AS Value FROM page_daily GROUP BY UserName
              ORDER BY Value DESC, UserName LIMIT 10) t) n) b""", "page_daily", "user_map"))
def top_users(spark, sf_dir):
    """Report: top 10 users by opens with bar widths; the shown users get their names."""
    top = V.top_groups(TB.page_daily(spark, sf_dir), "UserName", "Hits", 10)
    named = ID.enrich_with_user_map(top, "Label", ID.user_map(TB.users(spark, sf_dir)))
    return named.select(F.col("Name").alias("Label"), "Value", "Bar")


def _change_report(column: str, n: int) -> str:
    return f"""
SELECT Label, Value, {_bars('Value')} AS Bar FROM (
  SELECT *, round_even(100.0 * Value / MAX(Value) OVER (), 0) AS r
  FROM (SELECT {column} AS Label, COUNT(*) AS Value FROM change_log GROUP BY ALL
        ORDER BY Value DESC, Label LIMIT {n}) t) b"""


@query("top_change_types", "T5 W5 A16", sql(_change_report("ChangeType", 8), "change_log"))
def top_change_types(spark, sf_dir):
    """Report: changes per type (top 8) with bar widths."""
    return V.top_groups(TB.change_log(spark, sf_dir).withColumn("_one", F.lit(1)), "ChangeType", "_one", 8)


@query("top_audit_companies", "T5 W5 A16", sql(_change_report("CompanyName", 10), "change_log"))
def top_audit_companies(spark, sf_dir):
    """Report: changes per company (top 10) with bar widths."""
    return V.top_groups(TB.change_log(spark, sf_dir).withColumn("_one", F.lit(1)), "CompanyName", "_one", 10)


@query("quarantined_rows", "P5 S2 S3", sql("""
SELECT 'A' AS Module, Id, 'missing Timestamp/UserId' AS QuarantineReason FROM interactive WHERE Id % 31 = 0 OR Id % 37 = 0
UNION ALL SELECT 'B', EntryNo, 'missing EntryNo/ChangedAt' FROM change_log WHERE EntryNo % 41 = 0 OR EntryNo % 43 = 0
UNION ALL SELECT 'C', Id, 'missing Timestamp/UserId' FROM auth_labels WHERE Id % 31 = 0 OR Id % 37 = 0""",
                                            "interactive", "change_log", "auth_labels"))
def quarantined_rows(spark, sf_dir):
    """Rows kept aside when feeds deliver missing times, blank users and missing entry numbers."""
    def damaged(feed):
        return feed.withColumns({"Timestamp": F.when(F.col("Id") % 31 != 0, F.col("Timestamp")),
                                 "UserId": F.when(F.col("Id") % 37 == 0, F.lit(" ")).otherwise(F.col("UserId"))})

    changes = X.change_feed(spark, sf_dir)
    number = F.col("Entry_No")
    changes = changes.withColumns({"Entry_No": F.when(number % 41 != 0, number),
                                   "Date_and_Time": F.when(number % 43 != 0, F.col("Date_and_Time"))})
    bad = [("A", "Id", L.scan_page_views(damaged(X.page_views(spark, sf_dir))), L.PAGE_REQUIRED),
           ("B", "PrimaryKey", L.shape_change_log(changes), L.CHANGE_REQUIRED),
           ("C", "Id", L.scan_auth_failures(damaged(X.trace_feed(spark, sf_dir))), L.AUTH_REQUIRED)]
    parts = [L.split_quarantine(df, need)[1].select(F.lit(m).alias("Module"), F.col(c).cast("long").alias("Id"),
                                                    "QuarantineReason") for m, c, df, need in bad]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("top_companies", "T5 W5 A16", sql(f"""
SELECT Label, Value, "Distinct", {_bars('Value')} AS Bar FROM (
  SELECT *, CASE WHEN MAX(Value) OVER () > 0 THEN round_even(100.0 * Value / MAX(Value) OVER (), 0) ELSE 0 END AS r
  FROM (SELECT CompanyName AS Label, CAST(SUM(Hits) AS BIGINT) AS Value, COUNT(DISTINCT UserName) AS "Distinct"
        FROM page_daily GROUP BY CompanyName ORDER BY Value DESC, Label LIMIT 12) t) b""", "page_daily"))
def top_companies(spark, sf_dir):
    """Report: activity per company (top 12) with distinct users."""
    return V.top_groups(TB.page_daily(spark, sf_dir), "CompanyName", "Hits", 12, distinct_of="UserName")


@query("top_pages", "T5 W5 A16", sql(f"""
SELECT Label, Value, {_bars('Value')} AS Bar FROM (
  SELECT *, CASE WHEN MAX(Value) OVER () > 0 THEN round_even(100.0 * Value / MAX(Value) OVER (), 0) ELSE 0 END AS r
  FROM (SELECT COALESCE(PageName, 'Page ?') AS Label, CAST(SUM(Hits) AS BIGINT) AS Value FROM page_daily
        GROUP BY COALESCE(PageName, 'Page ?') ORDER BY Value DESC, Label LIMIT 10) t) b""", "page_daily"))
def top_pages(spark, sf_dir):
    """Report: top 10 page names by opens (unnamed pages as 'Page ?')."""
    daily = TB.page_daily(spark, sf_dir).withColumn("PageName", F.coalesce("PageName", F.lit("Page ?")))
    return V.top_groups(daily, "PageName", "Hits", 10)


@query("active_companies", "A17", sql("SELECT DISTINCT CompanyName FROM page_daily", "page_daily"))
def active_companies(spark, sf_dir):
    return V.active_companies(TB.page_daily(spark, sf_dir))


extra("secrets", (), """
SELECT s_suppkey AS SecretId, TIMESTAMP '2024-01-26 12:00:00' + INTERVAL (s_suppkey % 50) DAY + INTERVAL (s_suppkey % 7) HOUR AS ExpiresAt
FROM supplier""")
extra("secret_days", ("secrets",), """
SELECT SecretId, ExpiresAt, CAST(floor(date_diff('second', TIMESTAMP '2024-01-31 12:00:00', ExpiresAt) / 86400.0) AS BIGINT) AS DaysLeft
FROM secrets""")


def _expiry(spark, sf_dir):
    """One secret per supplier, expiring from five days ago to six weeks ahead."""
    key = F.col("s_suppkey")
    at = F.lit(dt.datetime(2024, 1, 26, 12)).cast("timestamp_ntz")
    secrets = read_table(spark, sf_dir, "supplier").select(
        key.alias("SecretId"), (at + F.make_dt_interval((key % 50).cast("int"), (key % 7).cast("int"))).alias("ExpiresAt"))
    return H.expiry(secrets, HEALTH_AS_OF, SECRET_WARN_DAYS)


@query("secret_expiry", "H4", sql("""
SELECT *, CASE WHEN DaysLeft <= 7 THEN 'problem' WHEN DaysLeft <= 30 THEN 'warning' END AS Level FROM secret_days""", "secret_days"))
def secret_expiry(spark, sf_dir):
    """Whole days left per secret; a warning from 30 days on, a problem from 7 on."""
    return _expiry(spark, sf_dir)


extra("run_log", (), """
SELECT 'run-' || strftime(ts, '%Y%m%d') AS File, event_id AS LineNo,
       CASE WHEN event_type = 'error' AND CAST(floor(value) AS BIGINT) % 11 = 0
            THEN strftime(ts, '%H:%M:%S') || ' Import ROLLBACK'
            ELSE strftime(ts, '%H:%M:%S') || ' ' || CASE event_type WHEN 'view' THEN 'modul A' WHEN 'click' THEN 'modul C'
                 WHEN 'purchase' THEN 'modul B' WHEN 'signup' THEN 'uzivatele' WHEN 'error' THEN 'sync-status' END
                 || ' exit=' || CASE WHEN CAST(floor(value) AS BIGINT) % 7 = 0 THEN '2' ELSE '0' END END AS value
FROM events""")


extra("step_rows", ("run_log",), r"""
SELECT f.File, s.Step, x.ExitCode, x.ExitCode <> 0 AS Failed
FROM (SELECT DISTINCT File FROM run_log) f
CROSS JOIN (VALUES ('modul A'), ('modul C'), ('modul B'), ('uzivatele'), ('sync-status'), ('snapshot')) s(Step)
LEFT JOIN (SELECT File, Step, arg_min(ExitCode, LineNo) AS ExitCode FROM (
             SELECT File, LineNo,
                    regexp_extract(value, '(?i)(modul A|modul C|modul B|uzivatele|sync-status|snapshot)\s+exit=\d+', 1) AS Step,
                    TRY_CAST(NULLIF(regexp_extract(value, '(?i)\bexit=(\d+)', 1), '') AS INTEGER) AS ExitCode
             FROM run_log) p WHERE Step <> '' GROUP BY File, Step) x
  ON x.File = f.File AND x.Step = s.Step""")


@query("step_status", "H3 S8", sql("SELECT * FROM step_rows", "step_rows"))
def step_status(spark, sf_dir):
    """Per daily run log: exit code of each step's first report, NULL when it never ran."""
    return H.step_status(L.parse_run_log(X.run_log_lines(spark, sf_dir)), L.STEP_LABELS)


@query("import_rollback", "H3 S8", sql("""
SELECT File, bool_or(regexp_matches(value, '(?i)Import ROLLBACK')) AS Rollback FROM run_log GROUP BY File""",
                                       "run_log"))
def import_rollback(spark, sf_dir):
    """Per daily run log: was an import rolled back."""
    return H.rollback_seen(L.parse_run_log(X.run_log_lines(spark, sf_dir)))


@query("alerts", "H5 H1 H3 H4", sql(f"""
SELECT CASE WHEN bool_or(bad) THEN 'ERROR' ELSE 'OK' END AS Status, COUNT(*) FILTER (WHERE bad) AS Problems
FROM (SELECT Stale AS bad FROM ({FRESH_SQL}) f UNION ALL SELECT Failed FROM step_rows
      UNION ALL SELECT bool_or(regexp_matches(value, '(?i)Import ROLLBACK')) FROM run_log GROUP BY File
      UNION ALL SELECT DaysLeft <= 7 FROM secret_days) p""", "newest", "step_rows", "secret_days"))
def alerts(spark, sf_dir):
    """One status over stale data, failed steps, import rollbacks and secrets about to expire."""
    lines = L.parse_run_log(X.run_log_lines(spark, sf_dir))
    flags = [(_freshness(spark, sf_dir), "Stale"), (H.step_status(lines, L.STEP_LABELS), "Failed"),
             (H.rollback_seen(lines), "Rollback")]
    found = [df.select(F.col(c).alias("Problem")) for df, c in flags]
    expiring = _expiry(spark, sf_dir).select(F.coalesce(F.col("Level") == "problem", F.lit(False)).alias("Problem"))
    return H.overall_status(found[0].unionByName(found[1]).unionByName(found[2]).unionByName(expiring))


@query("feed_status_age", "H2 A18", sql("""
SELECT n.Section AS Module, s.ExitCode = 0 AS Ok, Newest AS CheckedAt,
       CAST(greatest(0, floor(date_diff('microsecond', Newest, TIMESTAMP '2024-01-31 12:00:00') / 60000000.0 + 0.5))
            AS BIGINT) AS AgeMinutes,
       COALESCE(s.ExitCode = 0 AND greatest(0, floor(date_diff('microsecond', Newest, TIMESTAMP '2024-01-31 12:00:00') / 60000000.0
                + 0.5)) > 1560, false) AS Stale
FROM newest n LEFT JOIN step_rows s
  ON s.Step = 'modul ' || n.Section AND s.File = (SELECT MAX(File) FROM run_log)""", "newest", "step_rows", "run_log"))
def feed_status_age(spark, sf_dir):
    """Status age per module (minutes, rounded half up) and staleness beyond 26 h of feeds that are
    fine: whose step of the newest run log ended without an error (unknown if it never ran)."""
    lines = L.parse_run_log(X.run_log_lines(spark, sf_dir))
    newest_log = lines.agg(F.max("File")).first()[0]
    steps = H.step_status(lines.filter(F.col("File") == newest_log), ["modul A", "modul B", "modul C"])
    ok = steps.select(F.right("Step", F.lit(1)).alias("Module"), (F.col("ExitCode") == 0).alias("Ok"),
                      F.lit(None).cast("timestamp_ntz").alias("CheckedAt"))
    checked = _newest_rows(spark, sf_dir).select(F.col("Section").alias("Module"), F.lit(None).cast("boolean").alias("Ok"),
                                                 F.col("Newest").alias("CheckedAt"))
    status = checked.unionByName(ok).groupBy("Module").agg(F.bool_or("Ok").alias("Ok"), F.max("CheckedAt").alias("CheckedAt"))
    return H.feed_status_age(status, HEALTH_AS_OF)


@query("sync_status_upsert", "D8 A15", sql(f"""
SELECT Module, CloudCount, LocalCount, {_pct('LocalCount', 'CloudCount')} AS Pct,
       CASE WHEN Module = 'B' THEN TIMESTAMP '2024-01-30 12:00:00' ELSE TIMESTAMP '2024-01-31 12:00:00' END
         AS UpdatedAt
FROM sync_counts""", "sync_counts"))
def sync_status_upsert(spark, sf_dir):
    """Yesterday's status of all modules, then today's A and C rows upserted by module; the counts are
    taken once and stored."""
    cols = ["Module", "CloudCount", "LocalCount", "Pct", "UpdatedAt"]
    counts = materialized(_module_counts(spark, sf_dir))
    yesterday = H.sync_status([counts], [], HEALTH_AS_OF - dt.timedelta(days=1)).select(*cols)
    today = H.sync_status([counts.filter("Module <> 'B'")], [], HEALTH_AS_OF).select(*cols)
    return D.keyed_replace(yesterday, today, [F.col("Module")])


# Fixed scenario parameter: a company whose cloud count could not be read this run.
UNCOUNTED_COMPANY = "CO_3"


@query("sync_reconciled", "H6 A15", sql("""
SELECT 'B' AS Module, CAST(SUM(n) AS BIGINT) AS CloudSum, (SELECT COUNT(*) FROM cl_stored) AS LocalCount,
       bool_or(failed) AS AnyFailed,
       CASE WHEN bool_or(failed) OR (COALESCE(SUM(n), 0) = 0 AND (SELECT COUNT(*) FROM cl_stored) > 0)
            THEN (SELECT COUNT(*) FROM cl_stored) ELSE CAST(SUM(n) AS BIGINT) END AS CloudShown
FROM (SELECT CompanyName, CASE WHEN CompanyName = 'CO_3' THEN NULL ELSE COUNT(*) END AS n,
             CompanyName = 'CO_3' AS failed
      FROM change_log GROUP BY CompanyName) c""", "change_log", "cl_stored"))
def sync_reconciled(spark, sf_dir):
    """Module B's cloud count summed over companies; one company's count failed,
    so the stored count is shown instead of a misleading partial sum."""
    per_company = (TB.change_rows(spark, sf_dir).groupBy("CompanyName").agg(F.count(F.lit(1)).alias("n"))
                   .select(F.lit("B").alias("Module"),
                           F.when(F.col("CompanyName") == UNCOUNTED_COMPANY, F.lit(None).cast("long"))
                           .otherwise(F.col("n")).alias("Count"),
                           (F.col("CompanyName") == UNCOUNTED_COMPANY).alias("Failed")))
    local = H.module_count(_stored_subset(spark, sf_dir), "B", "LocalCount")
    return H.reconcile_cloud_count(per_company, local)


EXPORT_COLS = ("EntryNo", "ChangedAt", "UserId", "CompanyName", "TableNo", "TableName", "FieldNo", "FieldName",
               "ChangeType", "PrimaryKey", "OldValue", "NewValue")


@query("export_roundtrip", "S11 P13 P16", sql(f"""
SELECT {", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" if c == "ChangedAt" else f"CAST({c} AS VARCHAR) AS {c}"
                 for c in EXPORT_COLS)}
FROM change_log WHERE lower(TableName) LIKE '%able 1%' AND ChangeType = 'Deletion'
  AND CAST(ChangedAt AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'""", "change_log"))
def export_roundtrip(spark, sf_dir):
    """The whole filtered audit exported as Excel CSV (BOM, ';'), read back as text."""
    path = scratch_path(spark, "export") + "/audit.csv"
    S.export_table(FL.apply_filters(TB.change_log(spark, sf_dir), FILTER_SPEC), path, "csv")
    back = spark.read.option("header", True).option("sep", ";").csv(path)
    return back.withColumnRenamed(back.columns[0], back.columns[0].lstrip(S.BOM))


STORED_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                 "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("storage_inventory", "S13 U3")
def storage_inventory(spark, sf_dir):
    """Rows and MB per driver table (file sizes are engine-specific: rows-only check)."""
    return S.storage_inventory(spark, {n: os.path.join(sf_dir, f"{n}.parquet") for n in STORED_TABLES})


@query("table_row_counts", "S13 U3", sql(" UNION ALL ".join(
    f"SELECT '{n}' AS Dataset, COUNT(*) AS Rows FROM {n}" for n in STORED_TABLES)))
def table_row_counts(spark, sf_dir):
    """The inventory's row counts alone: one scan without columns, no listing of sizes."""
    return S.storage_inventory(spark, {n: os.path.join(sf_dir, f"{n}.parquet") for n in STORED_TABLES}, sizes=False)


extra("stream_deltas", ("page_log",), """
SELECT DISTINCT BatchId, DateKey, UserName, PageId, MAX(PageName) OVER cell AS PageName, CompanyName,
       COUNT(*) OVER cell AS Hits
FROM (SELECT 1 + (SELECT COUNT(*) FROM (VALUES (TIMESTAMP '2024-01-08 12:00:00'), (TIMESTAMP '2024-01-16 12:00:00'),
                                               (TIMESTAMP '2024-01-23 12:00:00')) c(cut) WHERE cut <= p."Timestamp") AS BatchId,
             date_trunc('day', "Timestamp")::DATE AS DateKey, UserName, ifnull(PageId, '?') AS PageId, PageName,
             ifnull(CompanyName, '?') AS CompanyName
      FROM page_log p WHERE UserName IS NOT NULL) r
WINDOW cell AS (PARTITION BY BatchId, DateKey, UserName, PageId, CompanyName)""")


@query("stream_daily_rollup", "I2 I7 I10 D6 S9", sql("""
SELECT m.DateKey, m.UserName, m.PageId, d.PageName, m.CompanyName, CAST(m.Hits AS BIGINT) AS Hits
FROM (SELECT DateKey, UserName, PageId, CompanyName, SUM(Hits) AS Hits, MAX(BatchId) AS NewestBatch
      FROM stream_deltas GROUP BY DateKey, UserName, PageId, CompanyName) m
JOIN stream_deltas d ON d.DateKey = m.DateKey AND d.UserName = m.UserName AND d.PageId = m.PageId
 AND d.CompanyName = m.CompanyName AND d.BatchId = m.NewestBatch""", "stream_deltas"))
def stream_daily_rollup(spark, sf_dir):
    """Four daily runs of the streaming ingest over landed page-view files
    (cut mid-day, so days span runs), compaction after the second run."""
    root = scratch_path(spark, "stream-pages")
    landing, state = f"{root}/landing", ST.State(f"{root}/state")
    feed = X.page_views(spark, sf_dir)
    bounds = [None] + STREAM_CUTS + [None]
    for i in range(len(bounds) - 1):
        part = feed
        if bounds[i] is not None:
            part = part.filter(F.col("Timestamp") >= F.lit(bounds[i]))
        if bounds[i + 1] is not None:
            part = part.filter(F.col("Timestamp") < F.lit(bounds[i + 1]))
        part.write.mode("append").parquet(landing)
        ST.run_page_stream(spark, landing, state, feed.schema, max_files_per_trigger=1000)
        if i == 1:
            ST.compact_daily(spark, state)
    return ST.daily_table(spark, state)


@query("stream_change_log", "I2 I7 S3 D3", sql("SELECT * FROM change_log", "change_log"))
def stream_change_log(spark, sf_dir):
    """Two runs of the change-log stream over landed OData pages; the second
    landing re-delivers the first one's entries, which D3 drops."""
    root = scratch_path(spark, "stream-changes")
    landing, state = f"{root}/landing", ST.State(f"{root}/state")
    feed = X.change_feed(spark, sf_dir)
    ST.land_change_pages(feed.filter(F.col("Date_and_Time") < F.lit(CHANGE_FIRST_LANDING_END)), landing)
    ST.run_change_stream(spark, landing, state)
    ST.land_change_pages(feed, landing)
    ST.run_change_stream(spark, landing, state)
    return ST.stored_change_log(spark, state)


@query("purged_run_log", "I9 R3 I7", sql("""
SELECT * FROM change_log WHERE CompanyName NOT IN ('CO_2', 'CO_4')""", "change_log"))
def purged_run_log(spark, sf_dir):
    """A run that finds an open purge request only purges: the stored log afterwards."""
    root = scratch_path(spark, "purge-run")
    run = DailyRun(spark, f"{root}/state", change_landing=f"{root}/landing")
    ST.land_change_pages(X.change_feed(spark, sf_dir), run.change_landing)
    run.run("ingest")
    run.requests.submit(PURGE_REQUEST + ["CO_4"])
    run.run("ingest")
    failed = [entry for entry in run.log if entry[1]]
    if failed:
        raise RuntimeError(f"steps failed: {failed}")
    return ST.stored_change_log(spark, run.changes)


extra("late_views", ("interactive",), """
SELECT *, "Timestamp" >= TIMESTAMP '2024-01-20 00:00:00' OR Id % 10 = 0 AS second FROM interactive""")
extra("late_first", ("late_views",), """
SELECT Id, "Timestamp", UserId, PageId FROM (
  SELECT *, row_number() OVER (PARTITION BY "Timestamp", UserId, ifnull(PageId, '') ORDER BY Id) AS nth
  FROM late_views WHERE NOT second AND "Timestamp" IS NOT NULL AND length(trim(UserId)) > 0) f WHERE nth = 1""")


@query("late_rows_lookback", "I6 I1 D2", sql("""
SELECT Id, "Timestamp", UserId, PageId, 'stored' AS Place FROM late_first
UNION ALL
SELECT Id, "Timestamp", UserId, PageId, 'stored' FROM (
  SELECT *, row_number() OVER (PARTITION BY "Timestamp", UserId, ifnull(PageId, '') ORDER BY Id) AS nth
  FROM late_views WHERE second AND length(trim(UserId)) > 0
    AND "Timestamp" >= (SELECT MAX("Timestamp") FROM late_first) - INTERVAL 5 DAY) s
WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM late_first f WHERE f."Timestamp" = s."Timestamp" AND f.UserId = s.UserId
                              AND ifnull(f.PageId, '') = ifnull(s.PageId, ''))
UNION ALL
SELECT Id, "Timestamp", UserId, PageId, 'late' FROM late_views
WHERE second AND "Timestamp" < (SELECT MAX("Timestamp") FROM late_first) - INTERVAL 5 DAY""", "late_views", "late_first"))
def late_rows_lookback(spark, sf_dir):
    """Every tenth view of the first weeks is delivered with the second landing: what came within five days of the
    newest stored time is stored, the rest is kept aside."""
    root = scratch_path(spark, "late")
    state, feed = ST.State(f"{root}/state"), X.page_views(spark, sf_dir)
    second = (F.col("Timestamp") >= F.lit(LATE_SPLIT)) | (F.col("Id") % LATE_EVERY == 0)
    for part in (feed.filter(~second), feed.filter(second)):
        part.write.mode("append").parquet(f"{root}/landing")
        ST.run_page_stream(spark, f"{root}/landing", state, feed.schema, lookback=LOOKBACK)
    columns = ["Id", "Timestamp", "UserId", "PageId"]
    return ST.stored_page_log(spark, state).select(*columns, F.lit("stored").alias("Place")).unionByName(
        ST.late_rows(spark, state).select(*columns, F.lit("late").alias("Place")))


@query("last_known_count", "H7", sql("""
SELECT n_regionkey AS TenantId, n_nationkey AS Environment,
       CASE WHEN n_nationkey % 3 <> 0 THEN (SELECT COUNT(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal >= 0)
            WHEN n_nationkey % 2 = 0 THEN (SELECT COUNT(*) FROM customer WHERE c_nationkey = n_nationkey) END AS Companies
FROM nation"""))
def last_known_count(spark, sf_dir):
    """Connections per nation: a run that could not count keeps the count known before for the same scope."""
    nations = read_table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("TenantId"),
                                                         F.col("n_nationkey").alias("Environment"))
    customers = read_table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("Environment")).agg(
        F.count(F.lit(1)).alias("all"), F.count_if(F.col("c_acctbal") >= 0).alias("now"))
    counted = nations.join(customers, "Environment", "left").na.fill(0, ["all", "now"])
    before = counted.filter("Environment % 2 = 0").select("TenantId", "Environment", F.col("all").alias("Companies"))
    now = counted.select("TenantId", "Environment", F.when(F.col("Environment") % 3 != 0, F.col("now")).alias("Companies"))
    return H.carry_last_known(now, before, ["TenantId", "Environment"], "Companies")


@query("capped_changes", "T7 T3", sql("""
SELECT * FROM change_log ORDER BY ChangedAt DESC, CompanyName, EntryNo DESC LIMIT 12000""", "change_log"))
def capped_changes(spark, sf_dir):
    """The newest changes under a row cap given as text, beyond what one task may rank."""
    return V.top_n(TB.change_log(spark, sf_dir), [F.col("ChangedAt").desc(), F.col("CompanyName").asc(), F.col("EntryNo").desc()],
                   V.top_rows("12000"))


@query("snapshot_kpi", "S10 A4 A10 T8", sql("""
SELECT '2024-01-31 12:00:00' AS GeneratedUtc, k.*, (SELECT COUNT(*) FROM change_log) AS AuditRows,
       (SELECT strftime(MAX(ChangedAt), '%Y-%m-%d %H:%M:%S') FROM change_log) AS AuditTo,
       (SELECT COUNT(DISTINCT DateKey) FROM page_daily) AS TrendDays, (SELECT COUNT(*) FROM page_map) AS PageMapCount
FROM kpi_row k""", "kpi_row", "change_log", "page_daily", "page_map"))
def snapshot_kpi(spark, sf_dir):
    """The whole dashboard snapshot published as one version and read back: its key figures."""
    path = scratch_path(spark, "snapshot")
    daily, log = (materialized(d) for d in (TB.page_daily(spark, sf_dir), TB.page_log(spark, sf_dir)))
    sections = snapshot_sections(daily, log, TB.auth_fail_daily(spark, sf_dir), TB.change_log(spark, sf_dir),
                                 TB.users(spark, sf_dir), TB.page_map(spark, sf_dir), TB.AS_OF_PAGES, Settings(),
                                 sync_status(spark, sf_dir), storage_inventory(spark, sf_dir))
    S.write_snapshot(sections, path, HEALTH_AS_OF.strftime("%Y-%m-%d %H:%M:%S"))
    back = S.read_snapshot(spark, path)
    parts = [back["generatedUtc"], back["kpi"],
             back["auditRange"].select(F.col("Rows").alias("AuditRows"), F.col("MaxDate").alias("AuditTo")),
             back["trend"].agg(F.count(F.lit(1)).alias("TrendDays")), back["pageMapCount"]]
    rows = parts[0]
    for p in parts[1:]:   # one row each: folded by union, not joined
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])
