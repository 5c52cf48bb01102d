"""Health and completeness: sync counts, freshness, run steps, expiry, alerts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import columns as C

# Thresholds.
STALE_HOURS = 24          # H1 freshness alert
STATUS_STALE_HOURS = 26   # H2 feed status age
EXPIRY_PROBLEM_DAYS = 7   # H4: at most 7 days left is a problem, else a warning


def module_count(df: DataFrame, module: str, column: str) -> DataFrame:
    """One ``(Module, <column>)`` row: the count of ``df``."""
    return df.agg(F.count(F.lit(1)).alias(column)).select(F.lit(module).alias("Module"), column)


def module_counts(feed: DataFrame, module: str, **counts) -> DataFrame:
    """One row with several counts of a feed, all of one scan: ``<column>=<aggregate>``."""
    return feed.agg(*[c.alias(n) for n, c in counts.items()]).select(F.lit(module).alias("Module"), *counts)


def stored_keys(keep: Column, *key: Column) -> Column:
    """How many rows of a feed its table holds: the distinct keys of those that can be stored."""
    return F.count_distinct(F.when(keep, F.struct(*key)))


def sync_status(cloud: list[DataFrame], local: list[DataFrame], as_of) -> DataFrame:
    """Feed count vs stored count per module, with completeness %.

    Inputs are one-row-per-module count frames (``module_counts`` gives several counts of a feed by one
    scan); they are unioned and folded per module. ``Pct`` rounds half to even; ``cloud = 0`` with
    ``local > 0`` reads 100.
    """
    rows = None
    for df in cloud + local:
        rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    s = rows.groupBy("Module").agg(*[F.max(c).alias(c) for c in rows.columns if c != "Module"])
    return s.select("*", C.pct_half_even("LocalCount", "CloudCount").alias("Pct"),
                    F.lit(as_of).cast("timestamp_ntz").alias("UpdatedAt"))


def sync_total(status: DataFrame) -> DataFrame:
    """SQL / cloud grand total over modules."""
    t = status.agg(F.sum("LocalCount").cast("long").alias("LocalCount"),
                   F.sum("CloudCount").cast("long").alias("CloudCount"))
    return t.select("LocalCount", "CloudCount", C.pct_half_even("LocalCount", "CloudCount").alias("Pct"))


def freshness(newest: DataFrame, as_of: dt.datetime, stale_hours: float = STALE_HOURS) -> DataFrame:
    """H1: hours since the newest row per section (UTC only), stale when over the limit.

    ``newest`` has ``Section, Newest``; a section without rows has NULL lag
    and is never stale.
    """
    lag = F.timestamp_diff("MICROSECOND", F.col("Newest"), F.lit(as_of).cast("timestamp_ntz")) / F.lit(3.6e9)
    lag_h = F.bround(lag, 1)
    return newest.select("Section", "Newest", lag_h.alias("LagHours"),
                         F.coalesce(lag_h > F.lit(float(stale_hours)), F.lit(False)).alias("Stale"))


def feed_status_age(status: DataFrame, as_of: dt.datetime, stale_hours: float = STATUS_STALE_HOURS) -> DataFrame:
    """H2: minutes since the last feed check, ``max(0, Math.round(...))`` (JS
    rounds half up), and ``stale = ok is true and age known and age > 26 h``.
    An unknown check time keeps the age NULL (never 0) and is not stale."""
    mins = F.timestamp_diff("MICROSECOND", F.col("CheckedAt"), F.lit(as_of).cast("timestamp_ntz")) / F.lit(6.0e7)
    rounded = F.floor(mins + F.lit(0.5))
    age = F.when(rounded.isNotNull(), F.greatest(F.lit(0), rounded)).cast("long")
    stale = (F.coalesce(F.col("Ok"), F.lit(False)) & age.isNotNull()
             & F.coalesce(age > F.lit(int(stale_hours * 60)), F.lit(False)))
    return status.select("*", age.alias("AgeMinutes"), stale.alias("Stale"))


def step_status(log_lines: DataFrame, steps: list[str]) -> DataFrame:
    """H3: per log file and known step the exit code of its first report,
    failed if non-zero, NULL when the step never ran.

    Per file the first match is ``min_by(ExitCode, LineNo)`` (partial
    aggregation); the file x step grid is an ``explode`` of the step list
    per file, not a cross join.
    """
    per_file = "File" in log_lines.columns
    keys = ["File"] if per_file else []
    hits = log_lines.filter(F.col("Step").isNotNull())
    first = hits.groupBy(*keys, "Step").agg(F.min_by("ExitCode", F.col("LineNo")).alias("ExitCode"))
    step_list = F.array(*[F.lit(s) for s in steps])
    if per_file:
        grid = log_lines.select("File").distinct().select("File", F.explode(step_list).alias("Step"))
    else:
        grid = log_lines.limit(1).select(F.explode(step_list).alias("Step"))
    out = grid.join(first, [*keys, "Step"], "left")
    return out.select(*keys, "Step", "ExitCode", (F.col("ExitCode") != 0).alias("Failed"))


def rollback_seen(log_lines: DataFrame) -> DataFrame:
    """H3: did a log (per file, when present) report an import rollback."""
    keys = ["File"] if "File" in log_lines.columns else []
    return log_lines.groupBy(*keys).agg(F.coalesce(F.bool_or("Rollback"), F.lit(False)).alias("Rollback"))


def expiry(secrets: DataFrame, as_of: dt.datetime, warn_days: int) -> DataFrame:
    """H4: whole days left (floor), warning within ``warn_days``, problem within 7."""
    us = F.timestamp_diff("MICROSECOND", F.lit(as_of).cast("timestamp_ntz"), F.col("ExpiresAt").cast("timestamp_ntz"))
    days = F.floor(us / F.lit(8.64e10)).cast("long")
    level = (F.when(days <= EXPIRY_PROBLEM_DAYS, "problem").when(days <= warn_days, "warning"))
    return secrets.select("*", days.alias("DaysLeft"), level.alias("Level"))


def overall_status(problems: DataFrame) -> DataFrame:
    """H5: ERROR when any problem flag is set, else OK."""
    agg = problems.agg(F.coalesce(F.bool_or("Problem"), F.lit(False)).alias("_p"),
                       F.count_if(F.col("Problem")).alias("Problems"))
    return agg.select(F.when(F.col("_p"), "ERROR").otherwise("OK").alias("Status"), "Problems")


def reconcile_cloud_count(per_company: DataFrame, local_count: DataFrame) -> DataFrame:
    """H6: show the local count when any company count failed, or when the
    cloud sum is 0 while local rows exist; else the cloud sum."""
    s = per_company.groupBy("Module").agg(F.sum("Count").cast("long").alias("CloudSum"),
                                          F.bool_or("Failed").alias("AnyFailed"))
    # one row per module on each side: fold them by union + group, not a join
    both = s.unionByName(local_count.select("Module", "LocalCount"), allowMissingColumns=True)
    j = both.groupBy("Module").agg(F.max("CloudSum").alias("CloudSum"), F.max("LocalCount").alias("LocalCount"),
                                   F.bool_or("AnyFailed").alias("AnyFailed"))
    shown = (F.when(F.col("AnyFailed") | ((F.coalesce(F.col("CloudSum"), F.lit(0)) == 0) & (F.col("LocalCount") > 0)),
                    F.col("LocalCount")).otherwise(F.col("CloudSum")))
    return j.select("Module", "CloudSum", "LocalCount", "AnyFailed", shown.alias("CloudShown"))


def carry_last_known(new: DataFrame, previous: DataFrame, keys: list[str], value: str) -> DataFrame:
    """H7: keep the previous value when the new one is unknown and the scope is the same."""
    prev = previous.select(*keys, F.col(value).alias("_prev"))
    return new.join(prev, keys, "left").withColumn(value, F.coalesce(F.col(value), F.col("_prev"))).drop("_prev")
