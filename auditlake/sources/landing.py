"""Feed sources: landed telemetry, change-log pages, user directory, page map, run logs.

The ingestion tool lands what the ERP / telemetry service returns as files;
these readers turn them into typed DataFrames with explicit schemas (no
inference), so the scan reads only the columns a query needs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions import columns as C
from auditlake.functions.joins import keep_one

# ---------------------------------------------------------------- schemas
TELEMETRY_SCHEMA = T.StructType([
    T.StructField("TimeGenerated", T.TimestampNTZType()),
    T.StructField("UserId", T.StringType()),
    T.StructField("ClientType", T.StringType()),
    T.StructField("Properties", T.StringType()),   # dynamic bag, kept as JSON text
])

CHANGE_ENTRY = T.StructType([
    T.StructField("Entry_No", T.LongType()),
    T.StructField("Date_and_Time", T.TimestampNTZType()),
    T.StructField("User_ID", T.StringType()),
    T.StructField("Table_No", T.StringType()),
    T.StructField("Table_Caption", T.StringType()),
    T.StructField("Field_No", T.StringType()),
    T.StructField("Field_Caption", T.StringType()),
    T.StructField("Type_of_Change", T.StringType()),
    T.StructField("Primary_Key", T.StringType()),
    T.StructField("Old_Value", T.StringType()),
    T.StructField("New_Value", T.StringType()),
])
CHANGE_PAGE_SCHEMA = T.StructType([T.StructField("value", T.ArrayType(CHANGE_ENTRY))])


def _prop(name: str) -> Column:
    return F.get_json_object(F.col("Properties"), f"$.{name}")


# ---------------------------------------------------------------- S1 / S2
def read_telemetry(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Landed telemetry rows ``TimeGenerated, UserId, ClientType, Properties``."""
    return spark.read.schema(TELEMETRY_SCHEMA).format(fmt).load(path)


def page_view_rows(telemetry: DataFrame) -> DataFrame:
    """Flatten the page-view bag to the feed columns."""
    return telemetry.select(
        F.col("TimeGenerated").alias("Timestamp"),
        F.col("UserId"),
        F.col("UserId").alias("UserName"),
        _prop("alObjectId").alias("PageId"),
        _prop("alObjectName").alias("PageName"),
        _prop("companyName").alias("CompanyName"),
        F.coalesce(F.col("ClientType"), _prop("clientType")).alias("ClientType"),
    )


def trace_rows(telemetry: DataFrame) -> DataFrame:
    """Flatten the trace bag to the error-feed columns (before P3/P4)."""
    return telemetry.select(
        F.col("TimeGenerated").alias("Timestamp"),
        F.col("UserId"),
        _prop("eventId").alias("EventId"),
        _prop("permissionType").alias("PermissionType"),
        _prop("alObjectType").alias("ObjectType"),
        _prop("alObjectId").alias("ObjectNo"),
        _prop("alObjectName").alias("ObjectName"),
        _prop("companyName").alias("CompanyName"),
        _prop("errorMessage").alias("ErrorMessage"),
    )


def scan_page_views(feed: DataFrame, since=None, lookback=None) -> DataFrame:
    """S1 + P2 + P1 + P5: new interactive page views after the watermark.

    ``since`` is the high watermark (strict ``>``, as the reference); with
    ``lookback`` (a ``datetime.timedelta``) the scan re-reads an overlap so late
    rows are not lost -- the insert-if-absent step makes the overlap safe.
    The filters are literals, so they reach the Parquet reader as pushed
    filters (row-group skipping on ``Timestamp``).
    """
    df = feed
    if since is not None:
        lower = since - lookback if lookback is not None else since
        df = df.filter(F.col("Timestamp") > F.lit(lower))
    df = df.filter(C.is_interactive("ClientType"))
    return df.select(
        *([F.col("Id")] if "Id" in feed.columns else []),
        F.col("Timestamp"),
        F.col("UserId"),
        C.empty_to_null("UserName").alias("UserName"),
        C.empty_to_null("PageId").alias("PageId"),
        C.empty_to_null("PageName").alias("PageName"),
        C.empty_to_null("CompanyName").alias("CompanyName"),
    )


# NOT NULL columns of the three stored tables: a row without one of them goes to quarantine.
PAGE_REQUIRED = ["Timestamp", "UserId"]
CHANGE_REQUIRED = ["EntryNo", "ChangedAt"]
AUTH_REQUIRED = ["Timestamp", "UserId"]


def split_quarantine(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """P5: rows with a NULL / blank required column go to quarantine instead of
    failing the whole batch (the reference rolled back on a NOT NULL violation)."""
    text = {c for c, t in df.dtypes if t == "string"}
    ok = None
    for c in required:
        cond = F.col(c).isNotNull()
        if c in text:
            cond = cond & (F.trim(F.col(c)) != "")
        ok = cond if ok is None else ok & cond
    good = df.filter(ok)
    bad = df.filter(~ok | ok.isNull()).withColumn(
        "QuarantineReason", F.lit("missing " + "/".join(required)))
    return good, bad


def scan_auth_failures(feed: DataFrame, since=None) -> DataFrame:
    """S2 + P2 + P3 + P4: RT0031 traces after the watermark, labelled."""
    df = feed
    if since is not None:
        df = df.filter(F.col("Timestamp") > F.lit(since))
    df = df.filter(F.col("EventId") == F.lit(C.AUTH_FAILED_EVENT))
    return df.select(
        *([F.col("Id")] if "Id" in feed.columns else []),
        F.col("Timestamp"),
        F.col("UserId"),
        C.auth_object_id("PermissionType", "ObjectType", "ObjectNo", "ObjectName").alias("ObjectId"),
        C.auth_object_name("CompanyName", "ErrorMessage", "ObjectName").alias("ObjectName"),
    )


# ---------------------------------------------------------------- S3 / S4 / P6
def read_change_pages(spark: SparkSession, path: str) -> DataFrame:
    """S3: landed OData pages ``{value:[...]}``, one directory per company
    (``Company=<name>``, a partition column)."""
    pages = spark.read.schema(CHANGE_PAGE_SCHEMA).json(path)
    company = "Company" if "Company" in pages.columns else None
    rows = pages.select(*([F.col(company)] if company else []),
                        F.explode("value").alias("e")).select(
        *([F.col(company)] if company else [F.lit(None).cast("string").alias("Company")]),
        "e.*")
    return rows


def shape_change_log(feed: DataFrame) -> DataFrame:
    """ERP change-log entries -> stored row shape.

    Text columns render NULL as '' and are kept in full (the company is part of
    the key), missing TableNo / FieldNo become 0, the company comes from the scan.
    """

    def text(c, name):
        return C.text_or_empty(c).alias(name)

    return feed.select(
        F.col("Entry_No").cast("long").alias("EntryNo"),
        F.col("Date_and_Time").alias("ChangedAt"),
        text("User_ID", "UserId"),
        text("Company", "CompanyName"),
        C.int_or_zero("Table_No").alias("TableNo"),
        text("Table_Caption", "TableName"),
        C.int_or_zero("Field_No").alias("FieldNo"),
        text("Field_Caption", "FieldName"),
        text("Type_of_Change", "ChangeType"),
        text("Primary_Key", "PrimaryKey"),
        C.text_or_empty("Old_Value").alias("OldValue"),
        C.text_or_empty("New_Value").alias("NewValue"),
    )


# The ERP's field names of the stored columns.
CHANGE_FIELDS = {"EntryNo": "Entry_No", "ChangedAt": "Date_and_Time", "UserId": "User_ID", "CompanyName": "Company",
                 "TableNo": "Table_No", "TableName": "Table_Caption", "FieldNo": "Field_No", "FieldName": "Field_Caption",
                 "ChangeType": "Type_of_Change", "PrimaryKey": "Primary_Key", "OldValue": "Old_Value", "NewValue": "New_Value"}


def unshape_change_log(rows: DataFrame) -> DataFrame:
    """Stored-shape rows under the ERP's field names again, to be landed as pages."""
    return rows.select(*[F.col(c).alias(f) for c, f in CHANGE_FIELDS.items()])


def company_list(change_rows: DataFrame, company_col: str = "CompanyName") -> DataFrame:
    """The companies present in the landed feed."""
    return change_rows.select(F.col(company_col).alias("CompanyName")).distinct()


# ---------------------------------------------------------------- S5 / P7
# Field-name patterns of the user directory, tried in order.
USER_FIELD_PATTERNS = {
    "UserSecurityId": [r"(?i)security"],
    "TelemetryUserId": [r"(?i)telemetr"],
    "UserName": [r"(?i)^user.?name", r"(?i)\buser_?name"],
    "FullName": [r"(?i)^full", r"(?i)full.?name"],
    "AuthEmail": [r"(?i)auth.*mail", r"(?i)authentication"],
    "State": [r"(?i)^state", r"(?i)\bstate"],
}
USER_FIELDS_REQUIRED = ("UserSecurityId", "TelemetryUserId")


def detect_user_fields(columns: list[str]) -> dict[str, str | None]:
    """Resolve directory field names by pattern on the schema (plan time)."""
    found: dict[str, str | None] = {}
    for target, patterns in USER_FIELD_PATTERNS.items():
        hit = None
        for p in patterns:
            hit = next((c for c in columns if re.search(p, c)), None)
            if hit:
                break
        found[target] = hit
    missing = [t for t in USER_FIELDS_REQUIRED if not found[t]]
    if missing:
        raise ValueError(f"user directory lacks field(s) {missing}; available: {columns}")
    return found


def read_user_directory(directory: DataFrame) -> DataFrame:
    """S5 + P7: directory rows in the stored user shape.

    Security ids are brace-stripped and trimmed; rows without one are skipped;
    an empty telemetry id becomes NULL. A detected optional field renders a
    missing value as '' (text conversion of a null), an undetected field is
    NULL.
    """
    f = detect_user_fields(directory.columns)

    def opt(target):
        if not f[target]:
            return F.lit(None).cast("string").alias(target)
        return F.coalesce(F.col(f[target]).cast("string"), F.lit("")).alias(target)

    tel = C.clean_guid(F.col(f["TelemetryUserId"]).cast("string"))
    return (directory
            .select(C.clean_guid(F.col(f["UserSecurityId"]).cast("string")).alias("UserSecurityId"),
                    F.nullif(tel, F.lit("")).alias("TelemetryUserId"),
                    opt("UserName"), opt("FullName"), opt("AuthEmail"), opt("State"))
            .filter(F.col("UserSecurityId").isNotNull() & (F.col("UserSecurityId") != "")))


# ---------------------------------------------------------------- S6
def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as ``(File, LineNo, value)``; ``LineNo`` keeps file order.

    ``monotonically_increasing_id`` grows with the partition index and the row
    position inside it, and a file's splits are numbered in offset order, so
    ``(File, LineNo)`` is the order of lines in the file.
    """
    return (spark.read.text(path)
            .select(F.col("_metadata.file_path").alias("File"),
                    F.monotonically_increasing_id().alias("LineNo"), "value"))


def js_trim(c: Column) -> Column:
    """JavaScript ``String.trim``: strip leading/trailing whitespace (tabs too)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _js_parse_int(c: Column) -> Column:
    """JavaScript ``parseInt(x, 10)``: the leading signed digits, else NULL."""
    digits = F.regexp_extract(js_trim(c), r"^[+-]?\d+", 0)
    return F.nullif(digits, F.lit("")).try_cast("long")


def parse_page_map(lines: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Page-map text -> ``(PageId, TableNo, TableName)``.

    Lines split on TAB / ';' / ','; the first two fields are parsed like JS
    ``parseInt`` (numeric prefix), non-numeric lines (headers) are skipped,
    the name is the third field cut to 200 characters, and the last line for
    a page id wins.
    """
    order = order or [c for c in ("File", "LineNo") if c in lines.columns]
    cols = F.split(js_trim(F.col("value")), r"[\t;,]")
    pid = _js_parse_int(F.get(cols, 0))
    tno = _js_parse_int(F.get(cols, 1))
    name = F.left(F.coalesce(js_trim(F.get(cols, 2)), F.lit("")), F.lit(200))
    parsed = (lines.filter(js_trim(F.col("value")) != "")
              .select(*[F.col(o) for o in order],
                      pid.cast("string").alias("PageId"), tno.cast("int").alias("TableNo"),
                      name.alias("TableName"))
              .filter(F.col("PageId").isNotNull() & F.col("TableNo").isNotNull()))
    last = keep_one(parsed, [F.col("PageId")], [F.col(o) for o in order], last=True)
    return last.select("PageId", "TableNo", "TableName")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail like the reference when a parsed source yields no row."""
    if df.limit(1).count() == 0:
        raise ValueError(f"no {what} row could be read")
    return df


# ---------------------------------------------------------------- S7 / S14
def company_selection(spark: SparkSession, enabled: list[str] | None) -> DataFrame | None:
    """The enabled companies as a one-column DataFrame; ``None`` = all."""
    if enabled is None:
        return None
    names = sorted({e.strip() for e in enabled if e and e.strip()})
    return spark.createDataFrame([(n,) for n in names], "CompanyName string")


def clean_user_map(entries: DataFrame) -> DataFrame:
    """Manual user-map entries ``(UserId, Name)``: trimmed, non-empty, <= 120 chars."""
    return (entries.select(C.clean_text("UserId").alias("UserId"), C.clean_text("Name").alias("Name"))
            .filter(F.col("UserId").isNotNull() & F.col("Name").isNotNull()))


# ---------------------------------------------------------------- S8
# Run-log patterns.
EXIT_PATTERN = r"(?i)\bexit=(\d+)"
ROLLBACK_PATTERN = r"(?i)Import ROLLBACK"
STEP_LABELS = ["modul A", "modul C", "modul B", "uzivatele", "sync-status", "snapshot"]


def parse_run_log(lines: DataFrame) -> DataFrame:
    """Per log line the step it reports, its exit code and the rollback flag."""
    step = F.lit(None).cast("string")
    for label in reversed(STEP_LABELS):
        step = F.when(F.col("value").rlike(r"(?i)" + re.escape(label) + r"\s+exit=\d+"), F.lit(label)) \
                .otherwise(step)
    return lines.select(
        *[c for c in lines.columns if c != "value"],
        step.alias("Step"),
        F.nullif(F.regexp_extract("value", EXIT_PATTERN, 1), F.lit("")).cast("int").alias("ExitCode"),
        F.col("value").rlike(ROLLBACK_PATTERN).alias("Rollback"),
    )
