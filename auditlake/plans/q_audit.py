"""Module B (change log) and module C (permission errors) queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from auditlake.functions.joins import bounded_broadcast
from auditlake.operators import dedup as D
from auditlake.operators import identity as ID
from auditlake.operators import increments as I
from auditlake.operators import mining as M
from auditlake.operators import rollup as R
from auditlake.operators import views as V
from auditlake.plans import tables as TB
from auditlake.plans.oracle_ctes import extra, failures_by_day
from auditlake.plans.registry import query, sql
from auditlake.sources import fixtures as X
from auditlake.sources import landing as L

# Fixed scenario parameters.
AUTH_TARGET_END = dt.datetime(2024, 1, 20)
AUTH_REPULL_FROM = dt.datetime(2024, 1, 10)
AUTH_EXISTING_END = dt.datetime(2024, 1, 15, 12, 0, 0)
AUTH_RAW_FROM = dt.datetime(2024, 1, 15)
RIGHTS_NARROWED = dt.date(2024, 1, 20)
SELECTED_COMPANIES = ["CO_1", "CO_3", "CO_5"]
STORED_FROM = dt.datetime(1997, 1, 1)
STORED_TO = dt.datetime(1999, 1, 1)
UNSEEDED_COMPANY = "CO_6"
CURSOR_CAPS = I.Caps(forward=300, backfill=100, seed=200)

CL_COLS = ("EntryNo, ChangedAt, UserId, CompanyName, TableNo, TableName, FieldNo, FieldName, "
           "ChangeType, PrimaryKey, OldValue, NewValue")


# ---------------------------------------------------------------- module C
@query("auth_error_labels", "S2 P3 P4", sql(
    'SELECT Id, "Timestamp", UserId, ObjectId, ObjectName FROM auth_labels', "auth_labels"))
def auth_error_labels(spark, sf_dir):
    """RT0031 traces with the readable 'what is missing' labels."""
    return TB.auth_labels(spark, sf_dir)


def _auth_part(cond: str) -> str:
    return f"""
SELECT "Timestamp", UserId, ObjectId, ObjectName FROM (
  SELECT *, row_number() OVER (PARTITION BY "Timestamp", UserId, COALESCE(ObjectId, '') ORDER BY Id DESC) AS rn
  FROM auth_labels WHERE {cond}) t WHERE rn = 1"""


extra("auth_target", ("auth_labels",), _auth_part("\"Timestamp\" < TIMESTAMP '2024-01-20 00:00:00'"))
extra("auth_repull", ("auth_labels",), _auth_part("\"Timestamp\" >= TIMESTAMP '2024-01-10 00:00:00'"))


@query("auth_error_upsert", "D4 I5", sql("""
SELECT * FROM auth_target t WHERE NOT EXISTS (
  SELECT 1 FROM auth_repull b WHERE b."Timestamp" = t."Timestamp" AND b.UserId = t.UserId
     AND COALESCE(b.ObjectId, '') = COALESCE(t.ObjectId, ''))
UNION ALL SELECT * FROM auth_repull""", "auth_target", "auth_repull"))
def auth_error_upsert(spark, sf_dir):
    """A re-pull from an earlier watermark upserts: matches refresh, new rows insert."""
    labels = TB.auth_labels(spark, sf_dir)
    target = D.dedup_batch(labels.filter(F.col("Timestamp") < F.lit(AUTH_TARGET_END)), D.auth_key(),
                           order=["Id"], last=True).drop("Id")
    batch = labels.filter(F.col("Timestamp") >= F.lit(AUTH_REPULL_FROM))
    return D.upsert_auth_failures(target, batch, order=["Id"])


@query("auth_error_daily", "A3", sql("SELECT * FROM auth_fail_daily", "auth_fail_daily"))
def auth_error_daily(spark, sf_dir):
    return TB.auth_fail_daily(spark, sf_dir)


def _auth_daily_of(cond: str) -> str:
    return failures_by_day(f"(SELECT * FROM auth_fail_raw WHERE {cond})")


extra("auth_daily_existing", ("auth_fail_raw",), _auth_daily_of("\"Timestamp\" < TIMESTAMP '2024-01-15 12:00:00'"))
extra("auth_daily_recomputed", ("auth_fail_raw",), _auth_daily_of("\"Timestamp\" >= TIMESTAMP '2024-01-15 00:00:00'"))


@query("auth_error_daily_merge", "D7 A3", sql("""
SELECT * FROM auth_daily_existing e WHERE NOT EXISTS (
  SELECT 1 FROM auth_daily_recomputed r WHERE r.DateKey = e.DateKey AND r.UserName = e.UserName
     AND r.ObjectId = e.ObjectId)
UNION ALL SELECT * FROM auth_daily_recomputed""", "auth_daily_existing", "auth_daily_recomputed"))
def auth_error_daily_merge(spark, sf_dir):
    """Replacing merge: recomputed days overwrite, days gone from raw stay."""
    raw = TB.auth_fail_raw(spark, sf_dir)
    existing = R.auth_daily_rollup(raw.filter(F.col("Timestamp") < F.lit(AUTH_EXISTING_END)))
    recomputed = R.auth_daily_rollup(raw.filter(F.col("Timestamp") >= F.lit(AUTH_RAW_FROM)))
    return R.merge_auth_daily(existing, recomputed)


extra("table_names", ("change_log", "page_map"), """
SELECT TableNo, MAX(TableName) AS TableName
FROM (SELECT TableNo, TableName FROM change_log UNION ALL SELECT TableNo, TableName FROM page_map) u
GROUP BY TableNo""")


@query("auth_error_classes", "M4 J9", sql(r"""
SELECT c.*, CASE WHEN c.TableNo IS NULL THEN NULL ELSE COALESCE(n.TableName, '(?)') END AS TableName
FROM (SELECT DateKey, UserName, ObjectId, ObjectName, Failures,
             CASE WHEN regexp_matches(COALESCE(ObjectName, ''), '(?i)licenc') THEN 'LICENCE'
                  WHEN regexp_matches(COALESCE(ObjectName, ''), '(?i)(nemáte|oprávnění|práva|missing permission|do not have)')
                  THEN 'MISSING_ROLE' ELSE 'OTHER' END AS ErrorClass,
             TRY_CAST(NULLIF(regexp_extract(COALESCE(ObjectName, ''), 'Table(?:Data)?\s+(\d+)', 1), '') AS INTEGER) AS TableNo
      FROM auth_fail_daily) c
LEFT JOIN table_names n ON n.TableNo = c.TableNo""", "auth_fail_daily", "table_names"))
def auth_error_classes(spark, sf_dir):
    """Why a permission fails: licence vs missing role, and which table."""
    names = M.table_names(TB.change_log(spark, sf_dir), TB.page_map(spark, sf_dir))
    return M.classify_errors(TB.auth_fail_daily(spark, sf_dir), names)


@query("auth_error_top", "T2", sql("""
SELECT DateKey, UserName, left(f.ObjectId, 50) AS ObjectId, left(f.ObjectName, 200) AS ObjectName, Failures
FROM auth_fail_daily f
ORDER BY DateKey DESC, Failures DESC, UserName NULLS FIRST, f.ObjectId NULLS FIRST LIMIT 5000""",
                                   "auth_fail_daily"))
def auth_error_top(spark, sf_dir):
    return V.top_auth_failures(TB.auth_fail_daily(spark, sf_dir), V.TOP_ROWS_DEFAULT)


@query("auth_errors_by_user", "M6 J8", sql("""
SELECT f.UserName, COALESCE(m.Name, f.UserName) AS Name, f.Failures, f.Days, f.LastDay
FROM (SELECT UserName, CAST(SUM(Failures) AS BIGINT) AS Failures, COUNT(DISTINCT DateKey) AS Days,
             MAX(DateKey) AS LastDay
      FROM auth_fail_daily WHERE DateKey >= DATE '2024-01-20' GROUP BY UserName) f
LEFT JOIN (SELECT UserId, MAX(Name) AS Name FROM user_map GROUP BY UserId) m ON m.UserId = f.UserName""",
                                        "auth_fail_daily", "user_map"))
def auth_errors_by_user(spark, sf_dir):
    """Migration check: failures per user after rights were narrowed, with names."""
    f = (TB.auth_fail_daily(spark, sf_dir).filter(F.col("DateKey") >= F.lit(RIGHTS_NARROWED))
         .groupBy("UserName").agg(F.sum("Failures").cast("long").alias("Failures"),
                                  F.count_distinct("DateKey").alias("Days"),
                                  F.max("DateKey").alias("LastDay")))
    named = ID.enrich_with_user_map(f, "UserName", ID.user_map(TB.users(spark, sf_dir)))
    return named.select("UserName", "Name", "Failures", "Days", "LastDay")


# ---------------------------------------------------------------- module B
extra("cl_stored", ("change_log",), """
SELECT * FROM change_log WHERE ChangedAt >= TIMESTAMP '1997-01-01' AND ChangedAt < TIMESTAMP '1999-01-01'
  AND CompanyName <> 'CO_6'""")


@query("change_log_dedup", "S3 P6 D3 W2", sql(f"""
SELECT {CL_COLS} FROM change_log c
WHERE NOT EXISTS (SELECT 1 FROM cl_stored s WHERE s.CompanyName = c.CompanyName AND s.EntryNo = c.EntryNo)""",
                                                  "change_log", "cl_stored"))
def change_log_dedup(spark, sf_dir):
    """The whole feed delivered twice: one row per (company, EntryNo), minus what is stored."""
    rows = TB.change_rows(spark, sf_dir)
    return D.insert_if_absent(rows.unionByName(rows), _stored_subset(spark, sf_dir), D.change_key(),
                              prune_col="EntryNo")


@query("change_log_latest", "T3 P16", sql(f"""
SELECT strftime(ChangedAt, '%Y-%m-%d %H:%M:%S') AS ChangedAt, UserId, CompanyName, ChangeType, TableNo,
       TableName, FieldNo, FieldName, PrimaryKey, OldValue, NewValue
FROM change_log ORDER BY change_log.ChangedAt DESC, CompanyName, EntryNo DESC LIMIT 5000""", "change_log"))
def change_log_latest(spark, sf_dir):
    return V.latest_changes(TB.change_log(spark, sf_dir), V.TOP_ROWS_DEFAULT)


@query("changes_by_company", "A9 T8", sql(
    "SELECT CompanyName, COUNT(*) AS \"Rows\" FROM change_log GROUP BY CompanyName", "change_log"))
def changes_by_company(spark, sf_dir):
    return V.changes_by_company(TB.change_log(spark, sf_dir)).orderBy(F.desc("Rows"), "CompanyName")


@query("changes_by_type", "A16", sql(
    "SELECT ChangeType, COUNT(*) AS \"Rows\" FROM change_log GROUP BY ChangeType", "change_log"))
def changes_by_type(spark, sf_dir):
    return V.changes_by_type(TB.change_log(spark, sf_dir))


@query("audit_range", "A10 P16", sql("""
SELECT 'pages' AS Section, strftime(MIN(DateKey), '%Y-%m-%d') AS MinDate,
       strftime(MAX(DateKey), '%Y-%m-%d') AS MaxDate, COUNT(*) AS "Rows" FROM page_daily
UNION ALL
SELECT 'audit', strftime(MIN(ChangedAt), '%Y-%m-%d %H:%M:%S'), strftime(MAX(ChangedAt), '%Y-%m-%d %H:%M:%S'),
       COUNT(*) FROM change_log""", "page_daily", "change_log"))
def audit_range(spark, sf_dir):
    return V.data_ranges(TB.page_daily(spark, sf_dir), TB.change_log(spark, sf_dir))


@query("change_log_companies", "S4", sql("SELECT DISTINCT CompanyName FROM change_log", "change_log"))
def change_log_companies(spark, sf_dir):
    return L.company_list(TB.change_rows(spark, sf_dir))


@query("change_log_selected", "P12 S7 J7", sql(f"""
SELECT {CL_COLS} FROM change_log WHERE CompanyName IN ('CO_1', 'CO_3', 'CO_5')""", "change_log"))
def change_log_selected(spark, sf_dir):
    """Only enabled companies are synchronised (``None`` selection = all)."""
    sel = L.company_selection(spark, SELECTED_COMPANIES)
    rows = TB.change_log(spark, sf_dir)
    return rows if sel is None else rows.join(bounded_broadcast(sel), "CompanyName", "left_semi")


def _stored_subset(spark, sf_dir):
    """Stored part of the change log: two years, one company never synchronised."""
    return TB.change_log(spark, sf_dir).filter(stored_part())


def stored_part():
    return ((F.col("ChangedAt") >= F.lit(STORED_FROM)) & (F.col("ChangedAt") < F.lit(STORED_TO))
            & (F.col("CompanyName") != UNSEEDED_COMPANY))


@query("change_log_edges", "A14", sql("""
SELECT c.CompanyName, COALESCE(e.MaxEntryNo, 0) AS MaxEntryNo, COALESCE(e.MinEntryNo, 0) AS MinEntryNo,
       COALESCE(e.StoredRows, 0) AS StoredRows
FROM (SELECT DISTINCT CompanyName FROM change_log) c
LEFT JOIN (SELECT CompanyName, MAX(EntryNo) AS MaxEntryNo, MIN(EntryNo) AS MinEntryNo, COUNT(*) AS StoredRows
           FROM cl_stored GROUP BY CompanyName) e ON e.CompanyName = c.CompanyName""", "change_log", "cl_stored"))
def change_log_edges(spark, sf_dir):
    """Cursor edges of every known company (empty company -> 0, 0, 0)."""
    companies = L.company_list(TB.change_rows(spark, sf_dir))
    edges = I.company_edges(_stored_subset(spark, sf_dir))
    j = companies.join(edges, "CompanyName", "left")
    return j.select("CompanyName", *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
                                     for c in ("MaxEntryNo", "MinEntryNo", "StoredRows")])


@query("change_log_next_rows", "I4 W4 T10 P11", sql(f"""
SELECT {CL_COLS}, CASE WHEN rn <= 200 THEN 'seed' ELSE 'backfill' END AS Phase FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.CompanyName ORDER BY c.EntryNo DESC) AS rn
  FROM change_log c WHERE c.CompanyName NOT IN (SELECT CompanyName FROM cl_stored)) s WHERE rn <= 300
UNION ALL
SELECT {CL_COLS}, 'forward' FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.CompanyName ORDER BY c.EntryNo) AS rn
  FROM change_log c JOIN (SELECT CompanyName, MAX(EntryNo) AS mx FROM cl_stored GROUP BY CompanyName) e
    ON e.CompanyName = c.CompanyName WHERE c.EntryNo > e.mx) f WHERE rn <= 300
UNION ALL
SELECT {CL_COLS}, 'backfill' FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.CompanyName ORDER BY c.EntryNo DESC) AS rn
  FROM change_log c JOIN (SELECT CompanyName, MIN(EntryNo) AS mn FROM cl_stored GROUP BY CompanyName) e
    ON e.CompanyName = c.CompanyName WHERE c.EntryNo < e.mn AND e.mn > 1) b WHERE rn <= 100""",
                                           "change_log", "cl_stored"))
def change_log_next_rows(spark, sf_dir):
    """Two-ended cursor: seed empty companies, sync forward, backfill history."""
    return I.next_change_rows(TB.change_log(spark, sf_dir), I.company_edges(_stored_subset(spark, sf_dir)), CURSOR_CAPS)
