"""Daily rollups and their merges (page usage A2/D6, permission errors A3/D7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import columns as C
from auditlake.operators.dedup import keyed_replace

DAILY_KEY = ["DateKey", "UserName", "PageId", "CompanyName"]
AUTH_DAILY_KEY = ["DateKey", "UserName", "ObjectId"]


def daily_page_rollup(raw: DataFrame) -> DataFrame:
    """A2 + P8 + I3: hits per UTC day x user x page x company.

    ``PageName`` is descriptive, so it is ``MAX``-ed instead of grouped (a
    renamed page would otherwise break the key). NULL keys become ``'?'``.
    The grouping runs as partial + final ``HashAggregate``: hot users or pages
    are pre-combined in every map task.
    """
    return (raw.filter(F.col("UserName").isNotNull())
            .groupBy(F.to_date("Timestamp").alias("DateKey"),
                     F.col("UserName"),
                     C.fill_missing("PageId").alias("PageId"),
                     C.fill_missing("CompanyName").alias("CompanyName"))
            .agg(F.max("PageName").alias("PageName"), F.count(F.lit(1)).alias("Hits"))
            .select(*DAILY_KEY[:3], "PageName", "CompanyName", "Hits"))


def daily_delta(raw_batch: DataFrame, batch_id) -> DataFrame:
    """Per-batch delta of the daily rollup, tagged with its (ordered) batch id."""
    return daily_page_rollup(raw_batch).withColumn("BatchId", F.lit(batch_id).cast("long"))


def merge_daily(deltas: DataFrame) -> DataFrame:
    """``Hits = Hits + src.Hits``; ``PageName`` from the newest batch.

    Deltas are appended per batch and folded here: sums add, and
    ``max_by(PageName, BatchId)`` takes the newest batch's name even when it
    is NULL -- the MERGE's ``SET PageName = src.PageName``. Re-running a batch
    overwrites its own delta, so the fold is idempotent (no double count).
    """
    return (deltas.groupBy(*DAILY_KEY)
            .agg(F.max_by("PageName", "BatchId").alias("PageName"),
                 F.sum("Hits").alias("Hits"))
            .select(*DAILY_KEY[:3], "PageName", "CompanyName", "Hits"))


def compact_daily(deltas: DataFrame, base_batch_id) -> DataFrame:
    """Fold many deltas into one base delta carrying ``base_batch_id``."""
    return merge_daily(deltas).withColumn("BatchId", F.lit(base_batch_id).cast("long"))


def auth_daily_rollup(raw: DataFrame) -> DataFrame:
    """A3: failures per UTC day x user x object (full recompute of raw)."""
    return (raw.groupBy(F.to_date("Timestamp").alias("DateKey"),
                        F.col("UserId").alias("UserName"),
                        C.fill_missing("ObjectId").alias("ObjectId"))
            .agg(F.max("ObjectName").alias("ObjectName"), F.count(F.lit(1)).alias("Failures")))


def merge_auth_daily(existing: DataFrame, recomputed: DataFrame) -> DataFrame:
    """``Failures = src.Failures``; existing rows not in the source stay."""
    return keyed_replace(existing.select(*recomputed.columns), recomputed,
                         [F.col(c) for c in AUTH_DAILY_KEY])
