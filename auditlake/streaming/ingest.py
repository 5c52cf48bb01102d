"""Incremental ingest with Structured Streaming.

Landed feed files are read by a file-stream source and every micro-batch
goes through ``foreachBatch``:

* page views: P1/P5 + quarantine -> D1 in-batch dedup -> D2 insert-if-absent
  against the stored raw log -> raw rows written to ``BatchId=<id>`` ->
  the daily *delta* of exactly those rows written to ``BatchId=<id>``;
* change log: explode OData pages -> P6 -> D3 dedup + insert-if-absent, stored and
  committed as one version of ``change_store``.

Every write of page views replaces only its own ``BatchId`` partition (dynamic partition
overwrite), so a micro-batch retried after a failure or a lost executor
rewrites itself instead of duplicating rows; the streaming checkpoint (under
``spark.checkpoint.dir``) records which files were committed. The daily
table is the fold of all deltas (``sum(Hits)``, newest batch's name), never
an in-place ``Hits + src`` update, so re-pulls and retention cannot double
count (SURVEY §5 #3). Compaction folds old deltas into a base written to a
new version directory, then switches a pointer file.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.operators import dedup as D
from auditlake.operators import rollup as R
from auditlake.operators.increments import DEFAULT_WATERMARK, newest_first
from auditlake.sources import landing as L
from auditlake.streaming.change_store import ChangeStore
from auditlake.streaming.versions import GRACE, exists, markers, mkdirs, names, remove, rename

# A stored batch id combines an ordered run id with the micro-batch number,
# because micro-batch numbers restart at 0 with a new checkpoint.
BATCH_SPAN = 1_000_000_000


@dataclass(frozen=True)
class State:
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def checkpoint(self) -> str:
        return self.path("_checkpoint")


def run_id(spark: SparkSession, state: State) -> int:
    """The ordered run id bound to this state's checkpoint.

    Runs are marker directories ``_runs/run=<n>`` (created with an atomic
    ``mkdirs``, never deleted or renamed): a resumed checkpoint keeps the
    newest run id, a new checkpoint takes the next one.
    """
    runs = markers(spark, state.path("_runs"), "run")
    if runs and exists(spark, state.checkpoint):
        return max(runs)
    rid = max(runs, default=0) + 1
    mkdirs(spark, state.path(f"_runs/run={rid}"))
    return rid


def _overwrite_batch(df: DataFrame, path: str, parts: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


# ---------------------------------------------------------------- page views
PAGE_RAW = "page_log"
PAGE_DELTAS = "page_daily_deltas"
PAGE_CUTOFFS = "page_cutoffs"
PAGE_QUARANTINE = "page_quarantine"
PAGE_LATE = "page_late"
CHANGE_QUARANTINE = "change_quarantine"
AUTH_QUARANTINE = "auth_quarantine"


def keep_quarantine(bad: DataFrame, path: str, batch_id: int) -> None:
    """Rows that can't be stored, kept aside per batch; a retried batch replaces its own."""
    if bad.limit(1).count() > 0:      # a cheap check saves an empty write job
        _overwrite_batch(bad.withColumn("BatchId", F.lit(batch_id).cast("long")), path, ["BatchId"])


def ingest_page_batch(spark: SparkSession, state: State, feed_batch: DataFrame, batch_id: int,
                      lookback: dt.timedelta | None = None) -> None:
    """One micro-batch of page views: clean, dedup, insert-if-absent, delta.

    ``lookback`` (I6): rows more than that behind the newest stored time are too late; they are
    kept aside per batch (``late_rows``) and change neither the log nor the rollup. None: no row is too late."""
    raw_path, delta_path = state.path(PAGE_RAW), state.path(PAGE_DELTAS)
    if {"TimeGenerated", "Properties"} <= set(feed_batch.columns):
        feed_batch = L.page_view_rows(feed_batch)          # raw telemetry landing (S1)
    # the micro-batch is read several times (bounds, anti join, quarantine):
    # keep it for the duration of this call; a lost executor recomputes it
    # from the replayable file source
    views = L.scan_page_views(feed_batch).persist()
    try:
        _ingest_views(spark, state, _in_time(spark, state, views, batch_id, lookback), batch_id, raw_path, delta_path)
    finally:
        views.unpersist()


def _in_time(spark: SparkSession, state: State, views: DataFrame, batch_id: int,
             lookback: dt.timedelta | None) -> DataFrame:
    if lookback is None or not exists(spark, state.path(PAGE_RAW)):
        return views
    # the batch's own rows don't count: a retried batch must judge its rows as it did before
    oldest = newest_in_days(spark, state.path(PAGE_RAW), but_batch=batch_id) - lookback
    late = views.filter(F.col("Timestamp") < F.lit(oldest))
    if late.limit(1).count() > 0:
        _overwrite_batch(late.withColumn("BatchId", F.lit(batch_id).cast("long")), state.path(PAGE_LATE), ["BatchId"])
    return views.filter(F.col("Timestamp").isNull() | (F.col("Timestamp") >= F.lit(oldest)))


def late_rows(spark: SparkSession, state: State) -> DataFrame | None:
    """Page views that came too late, with the batch that delivered them; None if there were none."""
    path = state.path(PAGE_LATE)
    return spark.read.parquet(path) if exists(spark, path) else None


def _ingest_views(spark: SparkSession, state: State, views: DataFrame, batch_id: int,
                  raw_path: str, delta_path: str) -> None:
    good, bad = L.split_quarantine(views, L.PAGE_REQUIRED)
    keep_quarantine(bad, state.path(PAGE_QUARANTINE), batch_id)
    order = ["Id"] if "Id" in views.columns else None
    deduped = D.dedup_batch(good, D.page_key(), order=order)
    if exists(spark, raw_path):
        # Timestamp is a key column: the bounds of the cleaned batch are the
        # bounds of the deduplicated one, without running the dedup for them
        lo, hi = good.agg(F.min("Timestamp"), F.max("Timestamp")).first()
        if lo is None:
            return
        # history excludes this batch's own partition: a retried batch must not
        # find its own rows; date + time bounds prune partitions and row groups
        hist = (spark.read.parquet(raw_path)
                .filter(F.col("BatchId") != batch_id)
                .filter(F.col("DateKey").between(F.lit(lo.date()), F.lit(hi.date())))
                .filter(F.col("Timestamp").between(F.lit(lo), F.lit(hi))))
        new = D.anti_join(deduped, hist, D.page_key())
    elif good.isEmpty():      # nothing to store yet: don't leave a table without a file
        return
    else:
        new = deduped
    tagged = new.withColumn("DateKey", F.to_date("Timestamp")).withColumn("BatchId", F.lit(batch_id).cast("long"))
    _overwrite_batch(tagged, raw_path, ["DateKey", "BatchId"])
    # the delta is computed from exactly what was stored for this batch
    stored = spark.read.parquet(raw_path).filter(F.col("BatchId") == batch_id)
    _overwrite_batch(R.daily_delta(stored.drop("DateKey", "BatchId"), batch_id), delta_path, ["BatchId"])


DAILY_BASE = "page_daily_base"


def _base(spark: SparkSession, state: State) -> tuple[DataFrame | None, int]:
    """The newest *committed* compacted base and the last batch it folds.

    A version ``v=<n>`` counts only once its commit marker ``_upto=<batch>``
    exists; the marker is created after the data is fully written.
    """
    best = None
    for ver in sorted(markers(spark, state.path(DAILY_BASE), "v"), reverse=True):
        upto = markers(spark, state.path(f"{DAILY_BASE}/v={ver}"), "_upto")
        if upto:
            best = (ver, upto[0])
            break
    if best is None:
        return None, -1
    ver, upto = best
    return spark.read.parquet(state.path(f"{DAILY_BASE}/v={ver}/data")), upto


def daily_table(spark: SparkSession, state: State) -> DataFrame:
    """The cumulative daily rollup = base (compacted) + newer deltas, folded."""
    base, upto = _base(spark, state)
    parts = []
    if base is not None:
        parts.append(base)
    if any(b > upto for b in markers(spark, state.path(PAGE_DELTAS), "BatchId")):
        parts.append(spark.read.parquet(state.path(PAGE_DELTAS)).filter(F.col("BatchId") > upto))
    cols = ["DateKey", "UserName", "PageId", "PageName", "CompanyName", "Hits", "BatchId"]
    allp = parts[0].select(*cols)
    for p in parts[1:]:
        allp = allp.unionByName(p.select(*cols))
    return R.merge_daily(allp)


def compact_daily(spark: SparkSession, state: State) -> int:
    """Fold the base and newer deltas into a new base version; returns the version.

    The new base carries the newest folded batch id, so later deltas still
    win the page name. Data is written first and the commit marker last, so
    a crash leaves the previous base + deltas valid (the half-written
    version is ignored). ``vacuum_daily`` removes old versions and folded deltas later.
    """
    base, upto = _base(spark, state)
    newest = max(markers(spark, state.path(PAGE_DELTAS), "BatchId"), default=-1)
    if newest <= upto:
        return -1
    deltas = spark.read.parquet(state.path(PAGE_DELTAS)).filter(F.col("BatchId") > upto)
    ver = max(markers(spark, state.path(DAILY_BASE), "v"), default=0) + 1
    cols = ["DateKey", "UserName", "PageId", "PageName", "CompanyName", "Hits", "BatchId"]
    allp = deltas.select(*cols) if base is None else base.select(*cols).unionByName(deltas.select(*cols))
    R.compact_daily(allp, newest).write.mode("overwrite").parquet(state.path(f"{DAILY_BASE}/v={ver}/data"))
    mkdirs(spark, state.path(f"{DAILY_BASE}/v={ver}/_upto={newest}"))
    return ver


def vacuum_daily(spark: SparkSession, state: State, grace: int = GRACE) -> int:
    """Remove bases older than the newest ``grace`` and the deltas that the oldest base kept has folded, so a
    reader that began before the newest compaction still finds its files. Returns the folders removed."""
    path = state.path(DAILY_BASE)
    done = {v: upto[0] for v in markers(spark, path, "v") if (upto := markers(spark, f"{path}/v={v}", "_upto"))}
    kept = sorted(done)[-max(1, grace):]
    gone = [f"{path}/v={v}" for v in markers(spark, path, "v") if kept and v < kept[0]]
    if len(kept) >= grace:
        deltas = state.path(PAGE_DELTAS)
        gone += [f"{deltas}/BatchId={b}" for b in markers(spark, deltas, "BatchId") if b <= done[kept[0]]]
    for folder in gone:
        remove(spark, folder)
    return len(gone)


def _start(src: DataFrame, fn, state: State, processing_time: str | None):
    w = src.writeStream.foreachBatch(fn).option("checkpointLocation", state.checkpoint)
    if processing_time:
        # I8: a long-running query that wakes up every ``processing_time``
        return w.trigger(processingTime=processing_time).start()
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_page_stream(spark: SparkSession, landing: str, state: State, schema: T.StructType,
                    max_files_per_trigger: int = 1000, fmt: str = "parquet",
                    processing_time: str | None = None, lookback: dt.timedelta | None = None):
    """Commit every landed file not yet seen; ``lookback`` as in ``ingest_page_batch``.

    Default ``trigger(availableNow=True)``: process the backlog and stop (run
    it from a scheduler); with ``processing_time`` the query keeps running
    and the caller owns the returned ``StreamingQuery``.
    """
    rid = run_id(spark, state)
    src = (spark.readStream.schema(schema).format(fmt)
           .option("maxFilesPerTrigger", max_files_per_trigger).load(landing))

    def fn(df, micro_batch_id):
        ingest_page_batch(df.sparkSession, state, df, rid * BATCH_SPAN + micro_batch_id, lookback)

    return _start(src, fn, state, processing_time)


def stored_page_log(spark: SparkSession, state: State) -> DataFrame:
    return _page_rows(spark, state).drop("DateKey", "BatchId")


# ---------------------------------------------------------------- change log
CHANGE_STORE = "change_log"


def change_store(spark: SparkSession, state: State) -> ChangeStore:
    return ChangeStore(spark, state.path(CHANGE_STORE))


def ingest_change_batch(spark: SparkSession, state: State, pages_batch: DataFrame, batch_id: int) -> None:
    """One micro-batch of change-log pages: explode, shape, quarantine, D3, append.

    Entries without a number or a time, and pages that are no ``{value:[...]}``
    document, go to quarantine; a malformed page leaves one row with its company."""
    entries = pages_batch.select("Company", F.explode("value").alias("e")).select("Company", "e.*")
    shaped = L.shape_change_log(entries).persist()
    good, bad = L.split_quarantine(shaped, L.CHANGE_REQUIRED)
    broken = pages_batch.filter(F.col("value").isNull()).select(
        F.col("Company").alias("CompanyName"), F.lit("malformed page").alias("QuarantineReason"))
    try:
        keep_quarantine(bad.unionByName(broken, allowMissingColumns=True), state.path(CHANGE_QUARANTINE), batch_id)
        if not good.isEmpty():
            change_store(spark, state).add(good, batch_id)
    finally:
        shaped.unpersist()


def compact_change_log(spark: SparkSession, state: State) -> int:
    """Rewrite the months and companies that lie in several units or have deleted rows; returns how many did."""
    return change_store(spark, state).compact()


def stored_change_log(spark: SparkSession, state: State) -> DataFrame:
    """The stored entries, each once: those of the newest committed version."""
    return change_store(spark, state).rows()


# ---------------------------------------------------------------- page-log compaction
# Batch ids are run_id * 10^9 + n > 0. A compacted day is the partition ``BatchId=-<newest folded batch>``: it
# appears with one rename, and that name alone tells which other partitions of the day it replaces.
def _folded(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Per day with such leftovers: batches that the day's compacted partition has folded already."""
    out = {}
    for name in names(spark, path):
        if name.startswith("DateKey="):
            batches = markers(spark, f"{path}/{name}", "BatchId")
            base = min((b for b in batches if b <= 0), default=0)
            left = [b for b in batches if b != base and b <= -base]
            if left:
                out[name.split("=", 1)[1]] = left
    return out


def compact_page_log(spark: SparkSession, state: State, before=None) -> list:
    """Fold each day's ``BatchId`` sub-partitions of the raw page log into one; ``before`` limits it to closed days.

    The rows of all days are staged by one job; then each day's compacted partition appears with one
    rename, and what it folded is removed. Readers (``stored_page_log``) skip what a day's compacted
    partition has folded, so each row is seen once at any moment; an interrupted compaction is
    finished by the next. Returns the compacted days.
    """
    path = state.path(PAGE_RAW)
    newest = {}
    for name in names(spark, path):
        day = name.split("=", 1)[-1]
        if name.startswith("DateKey=") and (before is None or day < str(before)):
            batches = markers(spark, f"{path}/{name}", "BatchId")
            live = [b for b in batches if b > -min(batches) or b == min(batches)]
            if len(live) > 1:
                newest[day] = max(batches)
    if newest:
        day = F.col("DateKey").cast("string")
        rows = _page_rows(spark, state).filter(day.isin(list(newest)))
        order = ["Id"] if "Id" in rows.columns else None
        staging = state.path(f"_staging/compact-days-{uuid_hex()}")
        D.dedup_batch(rows.drop("BatchId"), D.page_key(), order=order) \
            .write.partitionBy("DateKey").parquet(staging)
        for d, n in newest.items():
            rename(spark, f"{staging}/DateKey={d}", f"{path}/DateKey={d}/BatchId={-n}")
        remove(spark, staging)
    for d, batches in _folded(spark, path).items():
        for b in batches:
            remove(spark, f"{path}/DateKey={d}/BatchId={b}")
    return sorted(newest)


def retain_page_log(spark: SparkSession, state: State, cutoff: dt.datetime) -> list[str]:
    """Views before ``cutoff`` are gone for readers with one marker; whole days before it are then
    removed. No day is rewritten: the rest of the cutoff's own day is filtered off by the scan."""
    mkdirs(spark, state.path(f"{PAGE_CUTOFFS}/us={_micros(cutoff)}"))
    path = state.path(PAGE_RAW)
    gone = [n for n in names(spark, path) if n.startswith("DateKey=") and n.split("=", 1)[1] < cutoff.date().isoformat()]
    for name in gone:
        remove(spark, f"{path}/{name}")
    return gone


def _micros(at: dt.datetime) -> int:
    return int((at - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


def page_cutoff(spark: SparkSession, state: State) -> dt.datetime | None:
    us = markers(spark, state.path(PAGE_CUTOFFS), "us")
    return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=max(us)) if us else None


def _page_rows(spark: SparkSession, state: State) -> DataFrame:
    """Stored page views with their partition columns, each once, from the retention cutoff on."""
    path = state.path(PAGE_RAW)
    rows = spark.read.parquet(path)
    for day, batches in _folded(spark, path).items():
        rows = rows.filter(~((F.col("DateKey").cast("string") == day) & F.col("BatchId").isin(batches)))
    cutoff = page_cutoff(spark, state)
    return rows if cutoff is None else rows.filter((F.col("DateKey") >= F.lit(cutoff.date())) & (F.col("Timestamp") >= F.lit(cutoff)))


def newest_in_days(spark: SparkSession, path: str, column: str = "Timestamp", but_batch: int | None = None) -> dt.datetime:
    """I1 on a table stored by ``DateKey``: the newest time lies in the newest day, which its folder name
    tells. One day is read, its largest time kept per task (no exchange). ``but_batch`` is left out."""
    days = [n.split("=", 1)[1] for n in names(spark, path) if n.startswith("DateKey=")]
    for day in sorted(days, reverse=True):   # a day may hold folders without a row
        rows = spark.read.option("basePath", path).parquet(f"{path}/DateKey={day}")
        if but_batch is not None:
            rows = rows.filter(F.col("BatchId") != but_batch)
        newest = newest_first(rows, column).collect()
        if newest:
            return newest[0][0]
    return DEFAULT_WATERMARK


def uuid_hex() -> str:
    import uuid
    return uuid.uuid4().hex[:12]


CHANGE_PAGE_STREAM_SCHEMA = T.StructType(L.CHANGE_PAGE_SCHEMA.fields + [T.StructField("Company", T.StringType())])


def run_change_stream(spark: SparkSession, landing: str, state: State, max_files_per_trigger: int = 1000,
                      processing_time: str | None = None, companies: list[str] | None = None):
    """I2 / I7 for the change log: commit every landed page file not yet seen; pages of companies that are not
    selected (P12; None: all are) are passed over.

    ``max_files_per_trigger`` bounds one micro-batch (a catch-up backlog is
    split into several); each micro-batch is one dedup + one anti join.
    """
    rid = run_id(spark, state)
    src = (spark.readStream.schema(CHANGE_PAGE_STREAM_SCHEMA)
           .option("maxFilesPerTrigger", max_files_per_trigger).json(landing))
    if companies is not None:
        src = src.filter(F.col("Company").isin(companies))

    def fn(df, micro_batch_id):
        ingest_change_batch(df.sparkSession, state, df, rid * BATCH_SPAN + micro_batch_id)

    return _start(src, fn, state, processing_time)


def land_change_pages(entries: DataFrame, landing: str, page_rows: int = 5000) -> None:
    """Land change-log entries the way the ERP serves them: ``{value:[...]}``
    pages, one directory per company.

    Pages are ranges of ``page_rows`` consecutive entry numbers, so no window
    is needed however skewed the companies are; the input split is part of
    the page key as well, so even a feed holding many copies of the same
    entries never gathers more than one split's rows into a page.
    """
    fields = [c for c in entries.columns if c != "Company"]
    pages = (entries.groupBy("Company", F.floor(F.col("Entry_No") / page_rows).alias("_page"),
                             F.spark_partition_id().alias("_split"))
             .agg(F.collect_list(F.struct(*fields)).alias("value")).drop("_page", "_split"))
    pages.write.mode("append").partitionBy("Company").json(landing)
