"""Deduplication and keyed upserts (the reference's MERGE statements).

Parquet has no MERGE/DELETE, so every upsert is a set-based rewrite:
``target anti-join updates`` plus ``updates`` -- a single shuffle on the key.
Deduplication is an aggregation (``keep_one``) so a hot key is combined
map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import columns as C
from auditlake.functions.joins import keep_one


def page_key() -> list[Column]:
    """Page views are unique by time, user and page (no page counts as '')."""
    return [F.col("Timestamp"), F.col("UserId"), C.blank_key("PageId")]


def auth_key() -> list[Column]:
    """Permission errors are unique by time, user and object (none counts as '')."""
    return [F.col("Timestamp"), F.col("UserId"), C.blank_key("ObjectId")]


def change_key() -> list[Column]:
    """Change entries are unique by ``(CompanyName, EntryNo)`` (per-company sequence)."""
    return [F.col("CompanyName"), F.col("EntryNo")]


def dedup_batch(df: DataFrame, key: list[Column], order: list[str] | None = None,
                last: bool = False) -> DataFrame:
    """One row per key inside a batch.

    The reference keeps an arbitrary row (``ORDER BY (SELECT 1)``); here the
    survivor is the first (``last``: last) row in ``order`` followed by all
    remaining columns, a total order, so reruns are deterministic.
    """
    return keep_one(df, key, [F.col(c) for c in (order or []) if c in df.columns], last=last)


def _with_keys(df: DataFrame, key: list[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"_key{i}" for i in range(len(key))]
    return df.select("*", *[k.alias(n) for k, n in zip(key, names)]), names


def anti_join(batch: DataFrame, history: DataFrame, key: list[Column]) -> DataFrame:
    """Rows of ``batch`` whose key is absent from ``history`` (``NOT EXISTS``).

    Keys are materialised as columns so NULL-vs-'' rules are applied before
    the equi join; the join stays a hash/sort-merge equi join on the key.
    """
    b, names = _with_keys(batch, key)
    h, _ = _with_keys(history, key)
    return b.join(h.select(*names), names, "left_anti").drop(*names)


def prune_to_range(history: DataFrame, batch: DataFrame, col: str) -> DataFrame:
    """Restrict ``history`` to the ``[min, max]`` of ``batch.col``.

    The bounds are two scalars, so the filter is a literal range that Parquet
    (and date-partition pruning) can skip on -- an insert-if-absent touches
    only the partitions the batch can collide with.
    """
    lo, hi = batch.agg(F.min(col), F.max(col)).first()
    if lo is None:
        return history.limit(0)
    return history.filter(F.col(col).between(F.lit(lo), F.lit(hi)))


def insert_if_absent(batch: DataFrame, history: DataFrame, key: list[Column],
                     order: list[str] | None = None, prune_col: str | None = None) -> DataFrame:
    """D1 + D2 (D3 with the change-log key): the rows to append.

    History is pruned to the batch's range on ``prune_col`` first. The
    column is part of the key, so deduplication cannot change its min/max:
    the bounds come from a narrow scan of the raw batch, not from running
    the deduplication an extra time.
    """
    deduped = dedup_batch(batch, key, order)
    hist = prune_to_range(history, batch, prune_col) if prune_col else history
    return anti_join(deduped, hist, key)


def keyed_replace(target: DataFrame, updates: DataFrame, key: list[Column]) -> DataFrame:
    """Matched keys take the update row, unmatched target rows stay.

    ``union(target anti updates, updates)`` -- one shuffle, no full outer join.
    """
    kept = anti_join(target, updates, key)
    return kept.unionByName(updates.select(*target.columns))


def upsert_auth_failures(target: DataFrame, batch: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Permission-error upsert; within the batch the last delivered row wins."""
    cols = ["Timestamp", "UserId", "ObjectId", "ObjectName"]
    latest = dedup_batch(batch, auth_key(), order, last=True).select(*cols)
    return keyed_replace(target.select(*cols), latest, auth_key())


USER_COLUMNS = ["UserSecurityId", "TelemetryUserId", "UserName", "FullName", "AuthEmail", "State"]


def upsert_users(target: DataFrame, batch: DataFrame, as_of) -> DataFrame:
    """User upsert on ``UserSecurityId``, full overwrite incl. NULLs.

    Users absent from the batch are kept with their old ``UpdatedAt``;
    matched and new users get ``UpdatedAt = as_of``. Duplicate ids inside the
    batch (a MERGE error in the reference) resolve to the last in total order.
    """
    b = dedup_batch(batch.select(*USER_COLUMNS), [F.col("UserSecurityId")], last=True) \
        .withColumn("UpdatedAt", F.lit(as_of).cast("timestamp_ntz"))
    return keyed_replace(target.select(*USER_COLUMNS, "UpdatedAt"), b, [F.col("UserSecurityId")])
