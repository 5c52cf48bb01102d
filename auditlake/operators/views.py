"""Dashboard views over the stored tables: activity, KPI, trends, top-N, ranges.

Views are lazy DataFrames (no ordering inside a view, as SQL Server ignores
it too); sorting happens only in the top-N / ordered outputs, and every sort
carries the key columns so ties are broken the same way on every run.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import columns as C
from auditlake.functions.joins import materialized

# Default and bounds of the snapshot row cap.
TOP_ROWS_DEFAULT = 5000
TOP_ROWS_MIN = 100
TOP_ROWS_MAX = 1_000_000


def top_rows(value) -> int:
    """A row cap in 100..1,000,000; None is the default, anything else an error
    (a report asked for 2,000,000 rows must not come back with 5,000)."""
    if value is None:
        return TOP_ROWS_DEFAULT
    text = str(value).strip()
    if not text.isdecimal() or not TOP_ROWS_MIN <= int(text) <= TOP_ROWS_MAX:
        raise ValueError(f"row cap {value!r} is not a whole number in {TOP_ROWS_MIN}..{TOP_ROWS_MAX}")
    return int(text)


# Largest cap served by Spark's TakeOrderedAndProject (every task keeps n rows,
# one task merges them); larger caps use the range-partitioned top-N below.
TOPK_LOCAL_MAX = 10_000


def ranked_top(df: DataFrame, order: list[Column], n: int, local_max: int = TOPK_LOCAL_MAX) -> DataFrame:
    """The first ``n`` rows in ``order`` (a total order) with their 1-based ``_rank``.

    Small ``n``: ``orderBy().limit()`` (a bounded heap per task), ranked in a
    window over those ``n`` rows. Large ``n`` (the report cap goes up to
    1,000,000): range-partition and sort by ``order``, store the rows ONCE
    (checkpoint) with partition number and position, count rows per partition,
    turn the counts (one row per partition) into rank offsets, and keep rows
    whose global rank is <= n. Counts and rows read the same stored rows: planned
    twice, the two sides would sample their own range bounds and disagree.
    No task holds more than its own range partition.
    """
    if n <= local_max:
        top = df.orderBy(*order).limit(n)
        return top.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    s = (df.repartitionByRange(*order).sortWithinPartitions(*order)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_pos", F.monotonically_increasing_id()
                     - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    s = materialized(s)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    ranked = s.join(F.broadcast(offsets), "_pid")   # one row per partition
    ranked = ranked.withColumn("_rank", F.col("_off") + F.col("_pos") + 1)
    return ranked.filter(F.col("_rank") <= n).drop("_pid", "_pos", "_off")


def top_n(df: DataFrame, order: list[Column], n: int, local_max: int = TOPK_LOCAL_MAX) -> DataFrame:
    """The first ``n`` rows in ``order``, exact at any ``n`` (see ``ranked_top``)."""
    if n <= local_max:
        return df.orderBy(*order).limit(n)
    return ranked_top(df, order, n, local_max).drop("_rank")


def _d(x) -> dt.date:
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x))


def asc(c: str) -> Column:
    return F.col(c).asc_nulls_first()


def desc(c: str) -> Column:
    return F.col(c).desc_nulls_last()


# ---------------------------------------------------------------- A1
def page_activity(raw: DataFrame) -> DataFrame:
    """A1: opens, first and last open per user x page x name x company (raw grain)."""
    return (raw.groupBy("UserName", "PageId", "PageName", "CompanyName")
            .agg(F.count(F.lit(1)).alias("Opens"),
                 F.min("Timestamp").alias("FirstOpen"),
                 F.max("Timestamp").alias("LastOpen")))


# ---------------------------------------------------------------- A4 / P10
def kpi(daily: DataFrame, auth_daily: DataFrame, as_of, page_days: int = 30,
        fail_days: int = 14, approx_rsd: float | None = None) -> DataFrame:
    """A4: the KPI row.

    ``DateKey >= as_of - 30`` covers 31 calendar days, like the reference.
    The two sources are aggregated separately to one row each and combined
    by ``union`` + a global ``max`` -- no join, no cartesian product. Empty
    windows give 0, and ``'?'`` counts as a page. ``approx_rsd`` switches the
    two distinct counts to HyperLogLog++ sketches (one pass, no distinct
    shuffle) for very large windows; the default is exact.
    """
    as_of = _d(as_of)

    def distinct(c):
        return F.count_distinct(c) if approx_rsd is None else F.approx_count_distinct(c, approx_rsd)

    pages = (daily.filter(F.col("DateKey") >= F.lit(as_of - dt.timedelta(days=page_days)))
             .agg(distinct("UserName").alias("ActiveUsers30d"),
                  distinct("PageId").alias("DistinctPages30d"),
                  F.coalesce(F.sum("Hits"), F.lit(0)).cast("long").alias("Hits30d"))
             .withColumn("AuthFails14d", F.lit(None).cast("long")))
    fails = (auth_daily.filter(F.col("DateKey") >= F.lit(as_of - dt.timedelta(days=fail_days)))
             .agg(F.coalesce(F.sum("Failures"), F.lit(0)).cast("long").alias("AuthFails14d")))
    both = pages.unionByName(fails, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in
                      ("ActiveUsers30d", "DistinctPages30d", "Hits30d", "AuthFails14d")])


# ---------------------------------------------------------------- A5 / A6 / M5
def user_activity(daily: DataFrame) -> DataFrame:
    """A5: total hits and last day per user x page x name x company."""
    return (daily.groupBy("UserName", "PageId", "PageName", "CompanyName")
            .agg(F.sum("Hits").cast("long").alias("TotalHits"), F.max("DateKey").alias("LastUsed")))


def trim_candidates(daily: DataFrame, max_hits: int = 2) -> DataFrame:
    """Pages opened at most ``max_hits`` times (``HAVING SUM(Hits) <= 2``)."""
    return user_activity(daily).filter(F.col("TotalHits") <= max_hits)


# ---------------------------------------------------------------- A7 / A8 / W3 / T6
def trend(daily: DataFrame) -> DataFrame:
    """Hits and distinct users per day."""
    return daily.groupBy("DateKey").agg(F.sum("Hits").cast("long").alias("Hits"),
                                        F.count_distinct("UserName").alias("Users"))


def trend_by_company(daily: DataFrame) -> DataFrame:
    """Hits and distinct users per day x company."""
    return daily.groupBy("DateKey", "CompanyName").agg(
        F.sum("Hits").cast("long").alias("Hits"), F.count_distinct("UserName").alias("Users"))


def trend_cumulative(daily: DataFrame, by_company: bool = False) -> DataFrame:
    """Running total of hits over dates.

    The window runs over the per-day aggregate only (one row per day, a few
    thousand rows for a decade), so its single ordered partition is bounded;
    the raw rows never enter a window. Per company the window is partitioned.
    """
    base = trend_by_company(daily) if by_company else trend(daily)
    w = Window.orderBy("DateKey")
    if by_company:
        w = Window.partitionBy("CompanyName").orderBy("DateKey")
    w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return base.withColumn("CumHits", F.sum("Hits").over(w).cast("long"))


def trend_last(daily: DataFrame, days: int = 10) -> DataFrame:
    """The newest ``days`` days, cumulation computed over the whole series first."""
    return trend_cumulative(daily).orderBy(F.col("DateKey").desc()).limit(days)


# ---------------------------------------------------------------- A13 / J1 / T1
def last_seen(raw: DataFrame) -> DataFrame:
    """Newest raw timestamp per user x ('?'-filled) page x company."""
    return (raw.groupBy("UserName", C.fill_missing("PageId").alias("PageId"),
                        C.fill_missing("CompanyName").alias("CompanyName"))
            .agg(F.max("Timestamp").alias("LastSeen")))


def activity_with_last_seen(daily: DataFrame, raw: DataFrame) -> DataFrame:
    """User activity with the time of the last open.

    Raw (kept 6 months) gives the exact time; rows older than raw retention
    fall back to midnight of the last day. A renamed page yields two activity
    rows that share one LastSeen, as in the reference.
    """
    keys = ["UserName", "PageId", "CompanyName"]
    act = user_activity(daily)
    joined = act.join(last_seen(raw), keys, "left")
    last = F.coalesce(F.date_trunc("second", F.col("LastSeen")).cast("timestamp_ntz"),
                      F.col("LastUsed").cast("timestamp_ntz"))
    return joined.select("UserName", "PageId", "PageName", "CompanyName", "TotalHits",
                         C.ts_text(last).alias("LastUsed"))


def top_activity(daily: DataFrame, raw: DataFrame, n: int = TOP_ROWS_DEFAULT) -> DataFrame:
    """The busiest activity rows (``TakeOrderedAndProject``: a bounded top-k
    per task, merged -- no global sort of the whole table)."""
    return top_n(activity_with_last_seen(daily, raw),
                 [desc("TotalHits"), asc("UserName"), asc("PageId"), asc("PageName"), asc("CompanyName")],
                 top_rows(n))


# ---------------------------------------------------------------- T2 / T3
def top_auth_failures(auth_daily: DataFrame, n: int = TOP_ROWS_DEFAULT) -> DataFrame:
    """Newest days first, most failures first; labels are ranked in full and cut for display."""
    top = top_n(auth_daily.select("DateKey", "UserName", "ObjectId", "ObjectName", "Failures"),
                [desc("DateKey"), desc("Failures"), asc("UserName"), asc("ObjectId")], top_rows(n))
    return (top.withColumn("ObjectId", F.left("ObjectId", F.lit(C.OBJECT_ID_LEN)))
            .withColumn("ObjectName", F.left("ObjectName", F.lit(C.OBJECT_NAME_LEN))))


def latest_changes(change_log: DataFrame, n: int = TOP_ROWS_DEFAULT) -> DataFrame:
    """T3 + P16: the newest changes, sorted on the base table."""
    return (top_n(change_log, [desc("ChangedAt"), asc("CompanyName"), desc("EntryNo")], top_rows(n))
            .select(C.ts_text("ChangedAt").alias("ChangedAt"), "UserId", "CompanyName", "ChangeType",
                    "TableNo", "TableName", "FieldNo", "FieldName", "PrimaryKey", "OldValue",
                    "NewValue"))


# ---------------------------------------------------------------- A9 / A16 / A10 / A17
def changes_by_company(change_log: DataFrame) -> DataFrame:
    """Change rows per company."""
    return change_log.groupBy("CompanyName").agg(F.count(F.lit(1)).alias("Rows"))


def changes_by_type(change_log: DataFrame) -> DataFrame:
    """Change rows per change type."""
    return change_log.groupBy("ChangeType").agg(F.count(F.lit(1)).alias("Rows"))


def data_ranges(daily: DataFrame, change_log: DataFrame) -> DataFrame:
    """A10: min/max/count of the daily pages and of the audit, one row each."""
    pages = daily.agg(F.lit("pages").alias("Section"),
                      C.date_text(F.min("DateKey")).alias("MinDate"),
                      C.date_text(F.max("DateKey")).alias("MaxDate"),
                      F.count(F.lit(1)).alias("Rows"))
    audit = change_log.agg(F.lit("audit").alias("Section"),
                           C.ts_text(F.min("ChangedAt")).alias("MinDate"),
                           C.ts_text(F.max("ChangedAt")).alias("MaxDate"),
                           F.count(F.lit(1)).alias("Rows"))
    return pages.unionByName(audit)


def active_companies(daily: DataFrame) -> DataFrame:
    """Distinct companies seen in page activity."""
    return daily.select("CompanyName").distinct()


# ---------------------------------------------------------------- A16 / T5 / W5
def top_groups(df: DataFrame, group: str, value: str, n: int,
               distinct_of: str | None = None) -> DataFrame:
    """A16 + T5 + W5: top ``n`` groups by summed ``value`` with bar widths.

    ``Bar`` = ``round(100 * v / max shown)``, at least 1 % for a non-zero
    value, at most 100 %; rounding is half-to-even, as .NET ``Math.Round``. The bar's window runs over the ``n`` shown rows only.
    """
    aggs = [F.sum(value).cast("long").alias("Value")]
    if distinct_of:
        aggs.append(F.count_distinct(distinct_of).alias("Distinct"))
    shown = (df.groupBy(F.col(group).alias("Label")).agg(*aggs)
             .orderBy(desc("Value"), asc("Label")).limit(n))
    mx = F.max("Value").over(Window.partitionBy(F.lit(1)))
    width = F.when(mx > 0, F.bround(F.lit(100.0) * F.col("Value") / mx, 0)).otherwise(F.lit(0.0))
    width = F.when((width < 1) & (F.col("Value") > 0), F.lit(1.0)).otherwise(width)
    return shown.withColumn("Bar", F.least(width, F.lit(100.0)).cast("int"))


# ---------------------------------------------------------------- T8 / T9
def page_of_rows(df: DataFrame, order: list[Column], page: int, page_size: int | None,
                 local_max: int = TOPK_LOCAL_MAX) -> DataFrame:
    """One page of a totally ordered table (``page_size=None`` = all rows,
    a range-partitioned sort). Deep pages use the distributed ranking, so
    ``offset`` never makes one task hold every row before the page."""
    if page_size is None:
        return df.orderBy(*order)
    first = page * page_size
    top = ranked_top(df, order, first + page_size, local_max)
    return top.filter(F.col("_rank") > first).drop("_rank")


# ---------------------------------------------------------------- A18
def newest(df: DataFrame, col: str, section: str) -> DataFrame:
    """Newest parsable timestamp of a section (bad values skipped)."""
    ts = F.coalesce(F.col(col).cast("timestamp_ntz"), F.try_to_timestamp(F.col(col).cast("string")).cast("timestamp_ntz"))
    return df.agg(F.max(ts).alias("Newest")).select(F.lit(section).alias("Section"), "Newest")
