"""Projections of the driver's synthetic tables onto the feed shapes.

The reference ships no data, so its feeds are modelled over the driver
tables (see FIXTURES.md): ``events`` -> page views and permission errors,
``orders`` -> change log, ``customer`` -> user directory, ``part`` -> page
map. Each projection is a narrow, codegen-only ``select`` over one scan, so
Catalyst prunes unused columns and pushes later filters into the Parquet
reader.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.columns import AUTH_FAILED_EVENT, ZERO_GUID
from auditlake.session import read_table

# Client types of the fixture feed, by event_id % 6.
FIXTURE_CLIENT_TYPES = ["WebClient", "Desktop", "Tablet", "Phone", "Background", "WebService"]


K = "get_json_object(props, '$.k')"


def _ms(c: str) -> str:
    # millisecond precision (DATETIME2(3)); cast back so the column stays timestamp_ntz
    return f"CAST(date_trunc('MILLISECOND', {c}) AS TIMESTAMP_NTZ)"


def _str(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def page_views(spark: SparkSession, sf_dir: str, after=None) -> DataFrame:
    """Page-view feed: every 17th PageId, 19th PageName, 23rd CompanyName NULL.

    Written as SQL expressions (``selectExpr``): one JVM-side parse instead of
    hundreds of Python-to-JVM calls per projection. ``after`` (a watermark)
    pre-filters the raw scan with ``ts >= trunc_ms(after) + 1 ms`` -- exactly
    the rows whose millisecond-truncated time is ``> after`` -- so the
    watermark reaches the Parquet reader.
    """
    clients = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(FIXTURE_CLIENT_TYPES))
    events = read_table(spark, sf_dir, "events")
    if after is not None:
        floor_ms = after.replace(microsecond=after.microsecond // 1000 * 1000)
        events = events.filter(F.col("ts") >= F.lit(floor_ms + dt.timedelta(milliseconds=1)))
    return events.selectExpr(
        "event_id AS Id",
        f"{_ms('ts')} AS `Timestamp`",
        "CAST(user_id AS STRING) AS UserId",
        "CAST(user_id AS STRING) AS UserName",
        f"CASE WHEN event_id % 17 = 0 THEN NULL ELSE {K} END AS PageId",
        "CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_type END AS PageName",
        "CASE WHEN event_id % 23 = 0 THEN NULL ELSE concat('CO_', CAST(user_id % 7 AS STRING)) END AS CompanyName",
        f"CASE event_id % 6 {clients} END AS ClientType",
    )


def trace_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error-trace feed: every event becomes a trace; ``error`` events are RT0031.

    Optional properties are empty strings where the feed has no value, the
    way telemetry ``tostring()`` renders a missing property.
    """
    return read_table(spark, sf_dir, "events").selectExpr(
        "event_id AS Id",
        f"{_ms('ts')} AS `Timestamp`",
        "CAST(user_id AS STRING) AS UserId",
        f"CASE WHEN event_type = 'error' THEN '{AUTH_FAILED_EVENT}' ELSE upper(event_type) END AS EventId",
        "CASE event_id % 4 WHEN 0 THEN 'Execute' WHEN 1 THEN 'Read' WHEN 2 THEN 'Insert' ELSE '' END AS PermissionType",
        "CASE event_id % 3 WHEN 0 THEN 'TableData' WHEN 1 THEN 'System' ELSE '' END AS ObjectType",
        f"CASE WHEN event_id % 5 = 0 THEN '0' ELSE {K} END AS ObjectNo",
        "CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS ObjectName",
        "CASE WHEN event_id % 23 = 0 THEN '' ELSE concat('CO_', CAST(user_id % 7 AS STRING)) END AS CompanyName",
        f"CASE event_id % 3 WHEN 0 THEN concat('The licence does not include TableData ', {K}) "
        f"WHEN 1 THEN concat('Missing permission: TableData ', {K}) ELSE '' END AS ErrorMessage",
    )


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change-log entries as the ERP serves them (OData field names)."""
    return read_table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS Entry_No",
        "o_orderdate AS Date_and_Time",
        "concat('U', CAST(o_custkey % 150 AS STRING)) AS User_ID",
        "concat('CO_', CAST(o_orderkey % 7 AS STRING)) AS Company",
        "CAST(o_custkey % 50 AS INT) AS Table_No",
        "concat('Table ', CAST(o_custkey % 50 AS STRING)) AS Table_Caption",
        "CAST(o_orderkey % 20 AS INT) AS Field_No",
        "concat('Field ', CAST(o_orderkey % 20 AS STRING)) AS Field_Caption",
        "CASE o_orderstatus WHEN 'F' THEN 'Insertion' WHEN 'O' THEN 'Modification' ELSE 'Deletion' END "
        "AS Type_of_Change",
        "CAST(o_orderkey AS STRING) AS Primary_Key",
        "CAST(o_custkey AS STRING) AS Old_Value",
        "o_orderpriority AS New_Value",
    )


def user_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User directory with the ERP's own field names (auto-detected by S5)."""
    ck = F.col("c_custkey")
    return read_table(spark, sf_dir, "customer").select(
        _str(ck).alias("User_Security_ID"),
        F.when(ck % 11 == 0, F.lit(None).cast("string"))
         .when(ck % 29 == 0, F.lit(ZERO_GUID)).otherwise(_str(ck)).alias("Telemetry_User_ID"),
        F.concat(F.lit("U"), _str(ck)).alias("User_Name"),
        F.when(ck % 13 == 0, F.lit("  ")).otherwise(F.col("c_name")).alias("Full_Name"),
        F.concat(F.lit("u"), _str(ck), F.lit("@example.invalid")).alias("Authentication_Email"),
        F.when(F.col("c_acctbal") < 0, "Disabled").otherwise("Enabled").alias("State"),
        F.col("c_mktsegment").alias("Segment"),
    )


def page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageId -> source table: all parts but every seventh, mapped onto 50 tables."""
    pk = F.col("p_partkey")
    return (read_table(spark, sf_dir, "part")
            .filter(pk % 7 != 3)
            .select(_str(pk).alias("PageId"),
                    (pk % 50).cast("int").alias("TableNo"),
                    F.concat(F.lit("Table "), _str(pk % 50)).alias("TableName")))


def page_map_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-map text as pasted from the ERP's page metadata, one line per part.

    Separators rotate over TAB / ';' / ','; every 13th line is a header-like
    non-numeric line; page ids repeat (``p_partkey % 100``) so the last
    duplicate must win; some ids carry blanks or a numeric prefix.
    """
    pk = F.col("p_partkey")
    sep = F.when(pk % 3 == 0, "\t").when(pk % 3 == 1, ";").otherwise(",")
    pid = F.when(pk % 11 == 0, F.concat(F.lit(" "), _str(pk % 100), F.lit("x")))\
           .otherwise(_str(pk % 100))
    line = F.when(pk % 13 == 0, F.concat(F.lit("PageID"), sep, F.lit("SourceTable"), sep, F.lit("Name")))\
            .otherwise(F.concat(pid, sep, _str(pk % 50), sep, F.col("p_name")))
    return read_table(spark, sf_dir, "part").select(pk.alias("LineNo"), line.alias("value"))


# Which run step each event type stands for in the run-log fixture
# ("snapshot" never appears, so it reads as "did not run").
RUN_LOG_STEPS = {"view": "modul A", "click": "modul C", "purchase": "modul B",
                 "signup": "uzivatele", "error": "sync-status"}


def run_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily run logs: one file per day, one line per event, in event order.

    A line reports ``<time> <step> exit=<code>`` (code 2 for every 7th whole
    value, else 0); some error events log an ``Import ROLLBACK`` instead.
    """
    ev = read_table(spark, sf_dir, "events")
    whole = F.floor(F.col("value")).cast("long")
    step = F.lit(None).cast("string")
    for et, label in RUN_LOG_STEPS.items():
        step = F.when(F.col("event_type") == et, F.lit(label)).otherwise(step)
    hhmmss = F.date_format("ts", "HH:mm:ss")
    exit_code = F.when(whole % 7 == 0, F.lit("2")).otherwise(F.lit("0"))
    line = F.when((F.col("event_type") == "error") & (whole % 11 == 0),
                  F.concat(hhmmss, F.lit(" Import ROLLBACK")))\
            .otherwise(F.concat(hhmmss, F.lit(" "), step, F.lit(" exit="), exit_code))
    return ev.select(F.concat(F.lit("run-"), F.date_format("ts", "yyyyMMdd")).alias("File"),
                     F.col("event_id").alias("LineNo"), line.alias("value"))
