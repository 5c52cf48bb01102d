"""Stored tables of the warehouse, derived by Spark from the driver tables.

``page_log`` (raw page views), ``page_daily``, ``auth_fail_raw``,
``auth_fail_daily``, ``change_log``, ``users`` and ``page_map`` are what the
ingest jobs (``auditlake.streaming``) keep on storage; here they are
recomputed from the feeds in one batch, which is what a first full load
produces.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import dedup as D
from auditlake.operators import rollup as R
from auditlake.sources import fixtures as X
from auditlake.sources import landing as L

# Fixed parameters of the fixture scenario (FIXTURES.md): pinned "today".
AS_OF_PAGES = dt.date(2024, 1, 31)
AS_OF_CHANGES = dt.date(2001, 8, 2)
USERS_AS_OF = dt.datetime(2024, 1, 31, 0, 0, 0)


def interactive_views(spark: SparkSession, sf_dir: str, since=None) -> DataFrame:
    """S1 + P1 + P2 + P5 over the page-view feed."""
    return L.scan_page_views(X.page_views(spark, sf_dir), since=since)


def page_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw page log: interactive, cleaned, quarantine removed, deduplicated."""
    good, _bad = L.split_quarantine(interactive_views(spark, sf_dir), L.PAGE_REQUIRED)
    return D.dedup_batch(good, D.page_key(), order=["Id"])


def page_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.daily_page_rollup(page_log(spark, sf_dir))


def auth_labels(spark: SparkSession, sf_dir: str, since=None) -> DataFrame:
    """S2 + P3 + P4 over the trace feed."""
    return L.scan_auth_failures(X.trace_feed(spark, sf_dir), since=since)


def auth_fail_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw permission errors: one row per key, the last delivered row wins."""
    good, _bad = L.split_quarantine(auth_labels(spark, sf_dir), L.AUTH_REQUIRED)
    return D.dedup_batch(good, D.auth_key(), order=["Id"], last=True) \
        .select("Timestamp", "UserId", "ObjectId", "ObjectName")


def auth_fail_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.auth_daily_rollup(auth_fail_raw(spark, sf_dir))


def change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6-shaped change-log rows as delivered (before dedup)."""
    return L.shape_change_log(X.change_feed(spark, sf_dir))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored change log: one row per ``(CompanyName, EntryNo)``.

    The fixture's entry numbers are unique (FIXTURES.md), so the stored table
    is the shaped projection itself -- the state D3 leaves behind. Reading it
    without a dedup aggregate in between lets filters on ``ChangedAt`` reach
    the Parquet scan, as they do on the real stored table; D3 itself is
    exercised by ``change_log_dedup`` and ``stream_change_log``.
    """
    return change_rows(spark, sf_dir)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users: the directory loaded once (S5 + P7), stamped ``UpdatedAt``."""
    return (L.read_user_directory(X.user_directory(spark, sf_dir))
            .withColumn("UpdatedAt", F.lit(USERS_AS_OF).cast("timestamp_ntz")))


def page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.page_map(spark, sf_dir)
