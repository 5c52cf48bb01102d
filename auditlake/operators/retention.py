"""Retention, company purge and company-selection set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.joins import bounded_broadcast

# Retention defaults and bounds (months).
PAGE_RETENTION_MONTHS = 6
AUDIT_RETENTION_MONTHS = 24
RETENTION_MIN, RETENTION_MAX = 1, 1200


def retention_months(value, default: int) -> int:
    """A whole number of months in 1..1200; None means ``default``, anything else is an error:
    a mistyped retention must not delete by another rule than the one asked for."""
    if value is None:
        return default
    text = "" if isinstance(value, bool) else str(value).strip()
    if not text.isdecimal() or not RETENTION_MIN <= int(text) <= RETENTION_MAX:
        raise ValueError(f"retention {value!r} is not a whole number of months in {RETENTION_MIN}..{RETENTION_MAX}")
    return int(text)


def months_back(as_of: dt.datetime, months: int) -> dt.datetime:
    """``DATEADD(MONTH, -n, as_of)``: same day, clamped to the month's end."""
    y, m = divmod(as_of.year * 12 + (as_of.month - 1) - months, 12)
    m += 1
    nxt = dt.date(y + (m == 12), m % 12 + 1, 1)
    last_day = (nxt - dt.timedelta(days=1)).day
    return as_of.replace(year=y, month=m, day=min(as_of.day, last_day))


def retain(df: DataFrame, ts_col: str, as_of: dt.datetime, months: int) -> DataFrame:
    """Drop rows with ``ts_col < as_of - months`` (a literal, pushed to Parquet).

    Like ``DELETE ... WHERE ts < cutoff``, a row whose time is unknown is kept.
    """
    ts = F.col(ts_col)
    return df.filter(ts.isNull() | (ts >= F.lit(months_back(as_of, months))))


def normalize_names(spark: SparkSession, names: list[str]) -> DataFrame:
    """Trim, drop blanks, unique."""
    clean = sorted({n.strip() for n in names if n is not None and n.strip()})
    return spark.createDataFrame([(n,) for n in clean], "CompanyName string")


def validate_known(requested: DataFrame, known: DataFrame) -> DataFrame:
    """Reject names that are not known companies (raises, lists them)."""
    unknown = requested.join(known, "CompanyName", "left_anti").limit(20).collect()
    if unknown:
        raise ValueError(f"unknown companies: {[r.CompanyName for r in unknown]}")
    return requested


def purge_companies(change_log: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The change log without the listed companies, and deleted rows per company.

    The company list is tiny (a request) and size-checked before broadcast;
    the anti/semi joins then run map-side with no shuffle of the log.
    """
    lst = bounded_broadcast(companies.select("CompanyName").distinct())
    remaining = change_log.join(lst, "CompanyName", "left_anti")
    deleted = (change_log.join(lst, "CompanyName", "left_semi")
               .groupBy("CompanyName").agg(F.count(F.lit(1)).alias("DeletedRows")))
    return remaining, deleted


def removed_companies(previous: DataFrame | None, known: DataFrame, now_enabled: DataFrame) -> DataFrame:
    """Companies that were enabled (and still exist) but are not any more.

    ``previous = None`` means "all known were enabled".
    """
    prev = known if previous is None else previous.select("CompanyName").intersect(known)
    return prev.subtract(now_enabled.select("CompanyName"))


def queue_purge(pending: DataFrame, new: DataFrame) -> DataFrame:
    """Merge a new purge request into the pending one (union distinct)."""
    return pending.select("CompanyName").union(new.select("CompanyName")).distinct()
