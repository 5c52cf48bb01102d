"""DuckDB formulations of the fixtures and stored tables, used by the oracles.

Written directly in SQL from FIXTURES.md and the reference's table rules,
independently of the DataFrame code.
"""

from __future__ import annotations

INTERACTIVE = "('WebClient', 'Web', 'Desktop', 'Tablet', 'Phone')"
K = "json_extract_string(props, '$.k')"



def failures_by_day(rows: str) -> str:
    """A3 by its definition: every error shows the number of errors in its cell (day, user, object)."""
    return f"""
SELECT DISTINCT DateKey, UserName, ObjectId, MAX(ObjectName) OVER cell AS ObjectName, COUNT(*) OVER cell AS Failures
FROM (SELECT date_trunc('day', "Timestamp")::DATE AS DateKey, UserId AS UserName, ifnull(ObjectId, '?') AS ObjectId, ObjectName
      FROM {rows} e) d
WINDOW cell AS (PARTITION BY DateKey, UserName, ObjectId)"""


# name -> (dependencies, definition)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "page_views": ((), f"""
SELECT event_id AS Id, date_trunc('millisecond', ts) AS "Timestamp",
       CAST(user_id AS VARCHAR) AS UserId, CAST(user_id AS VARCHAR) AS UserName,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE {K} END AS PageId,
       CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_type END AS PageName,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE 'CO_' || CAST(user_id % 7 AS VARCHAR) END AS CompanyName,
       CASE event_id % 6 WHEN 0 THEN 'WebClient' WHEN 1 THEN 'Desktop' WHEN 2 THEN 'Tablet'
                         WHEN 3 THEN 'Phone' WHEN 4 THEN 'Background' ELSE 'WebService' END AS ClientType
FROM events"""),
    "interactive": (("page_views",), f"""
SELECT Id, "Timestamp", UserId, NULLIF(UserName, '') AS UserName, NULLIF(PageId, '') AS PageId,
       NULLIF(PageName, '') AS PageName, NULLIF(CompanyName, '') AS CompanyName
FROM page_views WHERE ClientType IN {INTERACTIVE}"""),
    "page_log": (("interactive",), """
SELECT Id, "Timestamp", UserId, UserName, PageId, PageName, CompanyName FROM (
  SELECT *, row_number() OVER (PARTITION BY "Timestamp", UserId, COALESCE(PageId, '') ORDER BY Id) AS rn
  FROM interactive WHERE "Timestamp" IS NOT NULL AND UserId IS NOT NULL AND trim(UserId) <> '') t
WHERE rn = 1"""),
    "page_daily": (("page_log",), """
SELECT DISTINCT DateKey, UserName, PageId, MAX(PageName) OVER day_page AS PageName, CompanyName,
       COUNT(*) OVER day_page AS Hits
FROM (SELECT date_trunc('day', "Timestamp")::DATE AS DateKey, UserName, ifnull(PageId, '?') AS PageId, PageName,
             ifnull(CompanyName, '?') AS CompanyName
      FROM page_log WHERE UserName IS NOT NULL) k
WINDOW day_page AS (PARTITION BY DateKey, UserName, PageId, CompanyName)"""),
    "trace_feed": ((), f"""
SELECT event_id AS Id, date_trunc('millisecond', ts) AS "Timestamp", CAST(user_id AS VARCHAR) AS UserId,
       CASE WHEN event_type = 'error' THEN 'RT0031' ELSE upper(event_type) END AS EventId,
       CASE event_id % 4 WHEN 0 THEN 'Execute' WHEN 1 THEN 'Read' WHEN 2 THEN 'Insert' ELSE '' END AS PermissionType,
       CASE event_id % 3 WHEN 0 THEN 'TableData' WHEN 1 THEN 'System' ELSE '' END AS ObjectType,
       CASE WHEN event_id % 5 = 0 THEN '0' ELSE {K} END AS ObjectNo,
       CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS ObjectName,
       CASE WHEN event_id % 23 = 0 THEN '' ELSE 'CO_' || CAST(user_id % 7 AS VARCHAR) END AS CompanyName,
       CASE event_id % 3 WHEN 0 THEN 'The licence does not include TableData ' || {K}
                         WHEN 1 THEN 'Missing permission: TableData ' || {K} ELSE '' END AS ErrorMessage
FROM events"""),
    "auth_labels": (("trace_feed",), """
SELECT Id, "Timestamp", UserId,
       NULLIF(COALESCE(NULLIF(PermissionType, ''), '?') || ' · ' || COALESCE(NULLIF(ObjectType, ''), '?')
         || CASE WHEN COALESCE(ObjectNo, '') IN ('0', '') THEN '' ELSE ' ' || ObjectNo END
         || CASE WHEN COALESCE(ObjectName, '') = '' THEN '' ELSE ' ' || ObjectName END, '') AS ObjectId,
       NULLIF(CASE WHEN COALESCE(CompanyName, '') = '' THEN '' ELSE CompanyName || ' · ' END
         || COALESCE(NULLIF(ErrorMessage, ''), NULLIF(ObjectName, ''), ''), '') AS ObjectName
FROM trace_feed WHERE EventId = 'RT0031'"""),
    "auth_fail_raw": (("auth_labels",), """
SELECT "Timestamp", UserId, ObjectId, ObjectName FROM (
  SELECT *, row_number() OVER (PARTITION BY "Timestamp", UserId, COALESCE(ObjectId, '') ORDER BY Id DESC) AS rn
  FROM auth_labels WHERE "Timestamp" IS NOT NULL AND UserId IS NOT NULL AND trim(UserId) <> '') t
WHERE rn = 1"""),
    "auth_fail_daily": (("auth_fail_raw",), failures_by_day("auth_fail_raw")),
    "kpi_row": (("page_daily", "auth_fail_daily"), """
SELECT COUNT(DISTINCT who) AS ActiveUsers30d, COUNT(DISTINCT page) AS DistinctPages30d,
       CAST(COALESCE(SUM(opens), 0) AS BIGINT) AS Hits30d, CAST(COALESCE(SUM(fails), 0) AS BIGINT) AS AuthFails14d
FROM (SELECT UserName AS who, PageId AS page, Hits AS opens, 0 AS fails, 30 AS days, DateKey FROM page_daily
      UNION ALL SELECT NULL, NULL, 0, Failures, 14, DateKey FROM auth_fail_daily) facts
WHERE date_diff('day', DateKey, DATE '2024-01-31') <= days"""),
    "change_log": ((), """
SELECT o_orderkey AS EntryNo, o_orderdate AS ChangedAt,
       COALESCE('U' || CAST(o_custkey % 150 AS VARCHAR), '') AS UserId,
       COALESCE('CO_' || CAST(o_orderkey % 7 AS VARCHAR), '') AS CompanyName,
       COALESCE(CAST(o_custkey % 50 AS INTEGER), 0) AS TableNo,
       COALESCE('Table ' || CAST(o_custkey % 50 AS VARCHAR), '') AS TableName,
       COALESCE(CAST(o_orderkey % 20 AS INTEGER), 0) AS FieldNo,
       COALESCE('Field ' || CAST(o_orderkey % 20 AS VARCHAR), '') AS FieldName,
       CASE o_orderstatus WHEN 'F' THEN 'Insertion' WHEN 'O' THEN 'Modification' ELSE 'Deletion' END AS ChangeType,
       COALESCE(CAST(o_orderkey AS VARCHAR), '') AS PrimaryKey,
       COALESCE(CAST(o_custkey AS VARCHAR), '') AS OldValue, COALESCE(o_orderpriority, '') AS NewValue
FROM orders"""),
    "users": ((), """
SELECT trim(regexp_replace(CAST(c_custkey AS VARCHAR), '[{}]', '', 'g')) AS UserSecurityId,
       NULLIF(trim(regexp_replace(CASE WHEN c_custkey % 11 = 0 THEN NULL
                                       WHEN c_custkey % 29 = 0 THEN '00000000-0000-0000-0000-000000000000'
                                       ELSE CAST(c_custkey AS VARCHAR) END, '[{}]', '', 'g')), '') AS TelemetryUserId,
       'U' || CAST(c_custkey AS VARCHAR) AS UserName,
       CASE WHEN c_custkey % 13 = 0 THEN '  ' ELSE c_name END AS FullName,
       'u' || CAST(c_custkey AS VARCHAR) || '@example.invalid' AS AuthEmail,
       CASE WHEN c_acctbal < 0 THEN 'Disabled' ELSE 'Enabled' END AS State,
       TIMESTAMP '2024-01-31 00:00:00' AS UpdatedAt
FROM customer"""),
    "page_map": ((), """
SELECT CAST(p_partkey AS VARCHAR) AS PageId, CAST(p_partkey % 50 AS INTEGER) AS TableNo,
       'Table ' || CAST(p_partkey % 50 AS VARCHAR) AS TableName
FROM part WHERE p_partkey % 7 <> 3"""),
    "user_map": (("users",), """
SELECT id AS UserId, CASE WHEN length(full_name) > 0 THEN full_name WHEN length(login) > 0 THEN login ELSE id END AS Name
FROM (SELECT TelemetryUserId AS id, trim(FullName) AS full_name, trim(UserName) AS login FROM users) u
WHERE length(trim(id)) > 0 AND id <> '00000000-0000-0000-0000-000000000000'"""),
    # J4 lookups: one name per login / per GUID (last = greatest UserSecurityId wins)
    "by_login": (("users",), """
SELECT UserName AS LoginKey, COALESCE(FullName, '') AS FullName FROM (
  SELECT *, row_number() OVER (PARTITION BY UserName ORDER BY UserSecurityId DESC) AS rn
  FROM users WHERE COALESCE(UserName, '') <> '') t WHERE rn = 1"""),
    "by_guid": (("users",), """
SELECT TelemetryUserId AS GuidKey, COALESCE(FullName, '') AS FullName FROM (
  SELECT *, row_number() OVER (PARTITION BY TelemetryUserId ORDER BY UserSecurityId DESC) AS rn
  FROM users WHERE COALESCE(TelemetryUserId, '') <> '') t WHERE rn = 1"""),
}


def extra(name: str, deps: tuple[str, ...], body: str) -> None:
    """Register a query-specific CTE (dependencies resolved like the built-ins)."""
    CTES[name] = (deps, body)


def _order(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in CTES[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_ctes(body: str, *names: str) -> str:
    order = _order(names)
    if not order:
        return body.strip()
    parts = ",\n".join(f"{n} AS ({CTES[n][1].strip()})" for n in order)
    return f"WITH {parts}\n{body.strip()}"
