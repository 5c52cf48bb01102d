"""Identity and permission-mining queries (users, names, table access, roles)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from auditlake.operators import dedup as D
from auditlake.operators import identity as ID
from auditlake.operators import mining as M
from auditlake.operators import views as V
from auditlake.plans import tables as TB
from auditlake.plans.oracle_ctes import extra
from auditlake.plans.registry import query, sql
from auditlake.session import read_table, scratch_path
from auditlake.sources import fixtures as X
from auditlake.sources import landing as L
from auditlake.streaming.users import UserStore

# Fixed scenario parameters.
DIRECTORY_REFRESH_AT = dt.datetime(2024, 2, 1)
REFRESHED_SEGMENTS = ["BUILDING", "HOUSEHOLD"]
NEW_SEGMENT = "HOUSEHOLD"
ROLE_SEGMENT = "AUTOMOBILE"
ROLE_COMPANY = "CO_1"
ROLE_MIN_OPS = 2
ROLE_NAME = "USAGE-CO_1"

USER_COLS = "UserSecurityId, TelemetryUserId, UserName, FullName, AuthEmail, State, UpdatedAt"


def _directory_sql(cond: str, full_name: str, stamp: str) -> str:
    return f"""
SELECT trim(regexp_replace(CAST(c_custkey AS VARCHAR), '[{{}}]', '', 'g')) AS UserSecurityId,
       NULLIF(trim(regexp_replace(CASE WHEN c_custkey % 11 = 0 THEN NULL
                                       WHEN c_custkey % 29 = 0 THEN '00000000-0000-0000-0000-000000000000'
                                       ELSE CAST(c_custkey AS VARCHAR) END, '[{{}}]', '', 'g')), '') AS TelemetryUserId,
       'U' || CAST(c_custkey AS VARCHAR) AS UserName,
       {full_name} AS FullName,
       'u' || CAST(c_custkey AS VARCHAR) || '@example.invalid' AS AuthEmail,
       CASE WHEN c_acctbal < 0 THEN 'Disabled' ELSE 'Enabled' END AS State,
       TIMESTAMP '{stamp}' AS UpdatedAt
FROM customer WHERE {cond}"""


extra("users_target", (), _directory_sql(
    "c_mktsegment <> 'HOUSEHOLD'", "CASE WHEN c_custkey % 13 = 0 THEN '  ' ELSE c_name END", "2024-01-31 00:00:00"))
extra("users_batch", (), _directory_sql(
    "c_mktsegment IN ('BUILDING', 'HOUSEHOLD')", "upper(CASE WHEN c_custkey % 13 = 0 THEN '  ' ELSE c_name END)",
    "2024-02-01 00:00:00"))


@query("user_upsert", "S5 P7 D5", sql(f"""
SELECT {USER_COLS} FROM users_target t
WHERE NOT EXISTS (SELECT 1 FROM users_batch b WHERE b.UserSecurityId = t.UserSecurityId)
UNION ALL SELECT {USER_COLS} FROM users_batch""", "users_target", "users_batch"))
def user_upsert(spark, sf_dir):
    """Directory refresh: matched users overwritten, new ones inserted, absent ones kept."""
    directory = X.user_directory(spark, sf_dir)
    target = (L.read_user_directory(directory.filter(F.col("Segment") != NEW_SEGMENT))
              .withColumn("UpdatedAt", F.lit(TB.USERS_AS_OF).cast("timestamp_ntz")))
    delivery = (directory.filter(F.col("Segment").isin(REFRESHED_SEGMENTS))
                .withColumn("Full_Name", F.upper("Full_Name")))
    return D.upsert_users(target, L.read_user_directory(delivery), DIRECTORY_REFRESH_AT)


@query("user_map", "P9", sql("SELECT UserId, Name FROM user_map", "user_map"))
def user_map(spark, sf_dir):
    return ID.user_map(TB.users(spark, sf_dir))


# Two deliveries of the directory: in the second every tenth user is missing and every fourth has the other state;
# every ninth comes with it for the first time.
extra("first_directory", ("users",), """
SELECT * EXCLUDE (UpdatedAt) FROM users WHERE CAST(UserSecurityId AS INTEGER) % 9 <> 0""")
extra("second_directory", ("users",), """
SELECT * EXCLUDE (UpdatedAt) REPLACE (CASE WHEN CAST(UserSecurityId AS INTEGER) % 4 = 0 THEN
           CASE State WHEN 'Enabled' THEN 'Disabled' ELSE 'Enabled' END ELSE State END AS State)
FROM users WHERE CAST(UserSecurityId AS INTEGER) % 10 <> 0""")
extra("user_states", ("first_directory", "second_directory"), """
SELECT a.*, TIMESTAMP '2024-01-31 00:00:00' AS ValidFrom,
       CASE WHEN b.State <> a.State THEN TIMESTAMP '2024-02-01 00:00:00' END AS ValidTo,
       CASE WHEN b.State = a.State THEN TIMESTAMP '2024-02-01 00:00:00' ELSE TIMESTAMP '2024-01-31 00:00:00' END AS UpdatedAt,
       CASE WHEN b.UserSecurityId IS NULL THEN TIMESTAMP '2024-02-01 00:00:00' END AS DepartedAt
FROM first_directory a LEFT JOIN second_directory b USING (UserSecurityId)
UNION ALL
SELECT b.*, TIMESTAMP '2024-02-01 00:00:00', NULL, TIMESTAMP '2024-02-01 00:00:00', NULL
FROM second_directory b LEFT JOIN first_directory a USING (UserSecurityId)
WHERE a.UserSecurityId IS NULL OR a.State <> b.State""")


def _two_deliveries(spark, sf_dir):
    directory = X.user_directory(spark, sf_dir)
    key = F.col("User_Security_ID").cast("int")
    other = F.when(F.col("State") == "Enabled", "Disabled").otherwise("Enabled")
    second = directory.withColumn("State", F.when(key % 4 == 0, other).otherwise(F.col("State"))).filter(key % 10 != 0)
    store = UserStore(spark, scratch_path(spark, "users"))
    store.load(L.read_user_directory(directory.filter(key % 9 != 0)), TB.USERS_AS_OF)
    store.load(L.read_user_directory(second), DIRECTORY_REFRESH_AT)
    return store


@query("user_history", "D5", sql("SELECT * FROM user_states", "user_states"))
def user_history(spark, sf_dir):
    """The stored users after two deliveries: changed states closed, departed users kept with the day they left."""
    return _two_deliveries(spark, sf_dir).history()


@query("user_map_written", "S12 P9 D5", sql("""
SELECT id AS UserId, CASE WHEN length(full_name) > 0 THEN full_name WHEN length(login) > 0 THEN login ELSE id END AS Name
FROM (SELECT TelemetryUserId AS id, trim(FullName) AS full_name, trim(UserName) AS login FROM user_states WHERE ValidTo IS NULL) u
WHERE length(trim(id)) > 0 AND id <> '00000000-0000-0000-0000-000000000000'""", "user_states"))
def user_map_written(spark, sf_dir):
    """The user map as written after the second delivery, departed users included."""
    return _two_deliveries(spark, sf_dir).user_map()


extra("manual_map", ("page_log",), """
SELECT DISTINCT UserId, left(trim('Manual ' || UserId), 120) AS Name FROM page_log""")


@query("user_map_overlay", "J5 S12 S14", sql("""
SELECT UserId, Name FROM (
  SELECT *, row_number() OVER (PARTITION BY UserId ORDER BY prio DESC, Name DESC) AS rn
  FROM (SELECT UserId, Name, 0 AS prio FROM manual_map UNION ALL SELECT UserId, Name, 1 FROM user_map) u) t
WHERE rn = 1""", "manual_map", "user_map"))
def user_map_overlay(spark, sf_dir):
    """Manually edited map entries, overlaid by the directory; the directory wins."""
    raw = TB.page_log(spark, sf_dir)
    manual = L.clean_user_map(raw.select("UserId", F.concat(F.lit("Manual "), F.col("UserId")).alias("Name"))
                              .distinct())
    return ID.overlay_user_map(manual, ID.user_map(TB.users(spark, sf_dir)))


@query("user_cards", "A19 A17", sql("""
SELECT u.UserName, u.Companies, u.Opens, u.LastUsed, t.TopPage
FROM (SELECT UserName, array_to_string(list_sort(list_distinct(list(CompanyName))), ', ') AS Companies,
             CAST(SUM(Hits) AS BIGINT) AS Opens, MAX(DateKey) AS LastUsed
      FROM page_daily GROUP BY UserName) u
JOIN (SELECT UserName, PageId AS TopPage FROM (
        SELECT UserName, PageId, row_number() OVER (PARTITION BY UserName ORDER BY h DESC, PageId) AS rn
        FROM (SELECT UserName, PageId, SUM(Hits) AS h FROM page_daily GROUP BY UserName, PageId) p) r
      WHERE rn = 1) t ON t.UserName = u.UserName""", "page_daily"))
def user_cards(spark, sf_dir):
    """Hint card per telemetry user: companies, top page, opens, last day."""
    return ID.user_cards(TB.page_daily(spark, sf_dir))


@query("named_activity", "J8 J4 A5", sql("""
SELECT a.UserName, COALESCE(m.Name, a.UserName) AS Name, a.PageId, a.PageName, a.CompanyName, a.TotalHits, a.LastUsed
FROM (SELECT UserName, PageId, PageName, CompanyName, CAST(SUM(Hits) AS BIGINT) AS TotalHits, MAX(DateKey) AS LastUsed
      FROM page_daily GROUP BY UserName, PageId, PageName, CompanyName) a
LEFT JOIN (SELECT UserId, MAX(Name) AS Name FROM user_map GROUP BY UserId) m ON m.UserId = a.UserName""",
                                   "page_daily", "user_map"))
def named_activity(spark, sf_dir):
    """Page activity with real names instead of pseudonymous GUIDs."""
    act = V.user_activity(TB.page_daily(spark, sf_dir))
    named = ID.enrich_with_user_map(act, "UserName", ID.user_map(TB.users(spark, sf_dir)))
    return named.select("UserName", "Name", "PageId", "PageName", "CompanyName", "TotalHits", "LastUsed")


extra("table_writes", ("change_log",), """
SELECT UserId, TableNo, CompanyName, MAX(TableName) AS TableName, COUNT(*) AS Changes,
       COUNT(*) FILTER (WHERE ChangeType = 'Insertion') AS Ins,
       COUNT(*) FILTER (WHERE ChangeType = 'Modification') AS "Mod",
       COUNT(*) FILTER (WHERE ChangeType = 'Deletion') AS Del,
       strftime(MAX(ChangedAt), '%Y-%m-%d %H:%M:%S') AS LastAt
FROM change_log GROUP BY UserId, TableNo, CompanyName""")

extra("table_reads", ("page_daily", "page_map", "by_guid"), """
SELECT COALESCE(NULLIF(g.FullName, ''), m.UserName) AS UserName, m.TableNo, m.CompanyName,
       MAX(m.MapName) AS TableName, CAST(SUM(m.Hits) AS BIGINT) AS Reads, COUNT(*) AS Pages,
       strftime(MAX(m.LastDay), '%Y-%m-%d') AS LastRead
FROM (SELECT p.*, pm.TableNo, pm.TableName AS MapName
      FROM (SELECT UserName, PageId, CompanyName, SUM(Hits) AS Hits, MAX(DateKey) AS LastDay
            FROM page_daily GROUP BY UserName, PageId, CompanyName) p
      JOIN page_map pm ON pm.PageId = trim(p.PageId) WHERE trim(p.PageId) <> '') m
LEFT JOIN by_guid g ON g.GuidKey = m.UserName
GROUP BY COALESCE(NULLIF(g.FullName, ''), m.UserName), m.TableNo, m.CompanyName""")

extra("table_access", ("table_writes", "table_reads", "by_login"), """
SELECT UserName, TableNo, COALESCE(NULLIF(MAX(WName), ''), MAX(RName), MAX(WName)) AS TableName, CompanyName,
       CAST(SUM(Changes) AS BIGINT) AS Changes, CAST(SUM(Ins) AS BIGINT) AS Ins, CAST(SUM("Mod") AS BIGINT) AS "Mod",
       CAST(SUM(Del) AS BIGINT) AS Del, CAST(SUM(Reads) AS BIGINT) AS Reads, CAST(SUM(Pages) AS BIGINT) AS Pages,
       CASE WHEN SUM(Changes) > 0 AND SUM(Reads) > 0 THEN 'RW' WHEN SUM(Changes) > 0 THEN 'W' ELSE 'R' END AS Access,
       greatest(COALESCE(MAX(LastW), ''), COALESCE(MAX(LastR), '')) AS LastUsed
FROM (
  SELECT COALESCE(NULLIF(l.FullName, ''), w.UserId) AS UserName, w.TableNo, w.CompanyName,
         w.TableName AS WName, CAST(NULL AS VARCHAR) AS RName, w.Changes, w.Ins, w."Mod", w.Del,
         0 AS Reads, 0 AS Pages, w.LastAt AS LastW, CAST(NULL AS VARCHAR) AS LastR
  FROM table_writes w LEFT JOIN by_login l ON l.LoginKey = w.UserId
  UNION ALL
  SELECT UserName, TableNo, CompanyName, CAST(NULL AS VARCHAR), TableName, 0, 0, 0, 0, Reads, Pages,
         CAST(NULL AS VARCHAR), LastRead
  FROM table_reads) u
GROUP BY UserName, TableNo, CompanyName""")


@query("table_writes", "A11", sql("SELECT * FROM table_writes", "table_writes"))
def table_writes(spark, sf_dir):
    return M.table_writes(TB.change_log(spark, sf_dir))


@query("table_reads", "A12 J3 J4", sql("SELECT * FROM table_reads", "table_reads"))
def table_reads(spark, sf_dir):
    return M.table_reads(TB.page_daily(spark, sf_dir), TB.page_map(spark, sf_dir), TB.users(spark, sf_dir))


def _access(spark, sf_dir):
    return M.table_access(TB.change_log(spark, sf_dir), TB.page_daily(spark, sf_dir),
                          TB.page_map(spark, sf_dir), TB.users(spark, sf_dir))


@query("table_access", "M1 J6 J4 J3", sql("SELECT * FROM table_access", "table_access"))
def table_access(spark, sf_dir):
    """Who reads and writes which table: W / R / RW per person x table x company."""
    return _access(spark, sf_dir)


@query("table_access_top", "T4 M1", sql("""
SELECT * FROM table_access
ORDER BY Changes + Reads DESC, UserName NULLS FIRST, TableNo NULLS FIRST, CompanyName NULLS FIRST LIMIT 1000""",
                                        "table_access"))
def table_access_top(spark, sf_dir):
    return M.top_table_access(_access(spark, sf_dir), 1000)


extra("role_people", (), "SELECT DISTINCT c_name AS Person FROM customer WHERE c_mktsegment = 'AUTOMOBILE'")
extra("role_objects", ("table_access", "page_daily", "by_guid", "role_people"), """
SELECT 'TableData' AS ObjectType, CAST(TableNo AS VARCHAR) AS ObjectId, MAX(TableName) AS ObjectName,
       CASE WHEN SUM(Reads) > 0 OR SUM(Changes) > 0 THEN 'R' ELSE '' END
       || CASE WHEN SUM(Ins) > 0 THEN 'I' ELSE '' END || CASE WHEN SUM("Mod") > 0 THEN 'M' ELSE '' END
       || CASE WHEN SUM(Del) > 0 THEN 'D' ELSE '' END AS Rights,
       CAST(SUM(Changes) + SUM(Reads) AS BIGINT) AS Operations
FROM table_access WHERE UserName IN (SELECT Person FROM role_people) AND CompanyName = 'CO_1'
GROUP BY TableNo HAVING SUM(Changes) + SUM(Reads) >= 2
UNION ALL
SELECT 'Page', d.PageId, MAX(d.PageName), 'X', CAST(SUM(d.Hits) AS BIGINT)
FROM page_daily d LEFT JOIN by_guid g ON g.GuidKey = d.UserName
WHERE COALESCE(NULLIF(g.FullName, ''), d.UserName) IN (SELECT Person FROM role_people)
  AND d.CompanyName = 'CO_1' AND d.PageId <> '-1'
GROUP BY d.PageId HAVING SUM(d.Hits) >= 2""")


def _people(spark, sf_dir):
    return (read_table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == ROLE_SEGMENT)
            .select(F.col("c_name").alias("Person")))


def _role(spark, sf_dir):
    return M.role_proposal(TB.change_log(spark, sf_dir), TB.page_daily(spark, sf_dir), TB.page_map(spark, sf_dir),
                           _people(spark, sf_dir), TB.users(spark, sf_dir), company=ROLE_COMPANY, min_ops=ROLE_MIN_OPS)


@query("role_proposal", "M2 P14 M5", sql("SELECT * FROM role_objects", "role_objects"))
def role_proposal(spark, sf_dir):
    """Least-privilege permission set from what the chosen people really use."""
    return _role(spark, sf_dir)


@query("role_text", "M3", sql("""
SELECT 'USAGE-CO_1' AS RoleName, COUNT(*) AS Objects,
       string_agg(ObjectType || ' ' || ObjectId || ' = ' || Rights, chr(10)
                  ORDER BY ObjectType, TRY_CAST(ObjectId AS BIGINT) NULLS FIRST, ObjectId) AS PermissionSet
FROM role_objects""", "role_objects"))
def role_text(spark, sf_dir):
    return M.role_text(_role(spark, sf_dir), ROLE_NAME)


@query("page_map_parse", "S6", sql(r"""
SELECT CAST(pid AS VARCHAR) AS PageId, CAST(tno AS INTEGER) AS TableNo, name AS TableName FROM (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY LineNo DESC) AS rn FROM (
    SELECT LineNo,
           TRY_CAST(NULLIF(regexp_extract(regexp_replace(c[1], '^\s+|\s+$', '', 'g'), '^[+-]?\d+', 0), '') AS BIGINT) AS pid,
           TRY_CAST(NULLIF(regexp_extract(regexp_replace(c[2], '^\s+|\s+$', '', 'g'), '^[+-]?\d+', 0), '') AS BIGINT) AS tno,
           left(COALESCE(regexp_replace(c[3], '^\s+|\s+$', '', 'g'), ''), 200) AS name
    FROM (SELECT LineNo, string_split_regex(regexp_replace(value, '^\s+|\s+$', '', 'g'), '[\t;,]') AS c
          FROM (SELECT p_partkey AS LineNo,
                       CASE WHEN p_partkey % 13 = 0 THEN 'PageID' || sep || 'SourceTable' || sep || 'Name'
                            ELSE pid || sep || CAST(p_partkey % 50 AS VARCHAR) || sep || p_name END AS value
                FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN chr(9) WHEN 1 THEN ';' ELSE ',' END AS sep,
                             CASE WHEN p_partkey % 11 = 0 THEN ' ' || CAST(p_partkey % 100 AS VARCHAR) || 'x'
                                  ELSE CAST(p_partkey % 100 AS VARCHAR) END AS pid FROM part) p) l
          WHERE regexp_replace(value, '^\s+|\s+$', '', 'g') <> '') s) v
  WHERE pid IS NOT NULL AND tno IS NOT NULL) r
WHERE rn = 1"""))
def page_map_parse(spark, sf_dir):
    """Pasted page metadata -> page map: numeric prefixes, header skipped, last line wins."""
    return L.parse_page_map(X.page_map_lines(spark, sf_dir))
