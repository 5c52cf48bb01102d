"""The daily run with modes ``ingest`` / ``repull`` / ``purge``.

State lives under one shared root (on a cluster: below ``spark.checkpoint.dir``):

* ``pages`` -- ``page_log``, ``page_daily_deltas``, ``page_daily_base``: module A (streamed);
* ``changes`` -- ``change_log``: module B (streamed), see ``change_store``;
* ``errors`` -- ``auth_fail_raw``, ``auth_fail_daily``: module C, partitioned by ``DateKey``;
  an upsert rewrites only the date partitions the batch touches;
* ``directory`` -- users with their history, and the user map;
* ``control`` -- status per module, purge requests, company selection, connection, run logs;
* ``snapshot`` -- published versions of the dashboard.

Every rewrite goes through a staging folder or a new version first, so a job that dies half
way (lost executor, killed driver) can simply be run again.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.operators import dedup as D
from auditlake.operators import health as H
from auditlake.operators import increments as I
from auditlake.operators import mining as M
from auditlake.operators import retention as RT
from auditlake.operators import rollup as R
from auditlake.plans.snapshot import Settings, snapshot_sections
from auditlake.sources import landing as L
from auditlake.sources import sinks as S
from auditlake.sources.sinks import recover_table, swap_partitions
from auditlake.streaming import ingest as ST
from auditlake.streaming.requests import PurgeRequests
from auditlake.streaming.users import UserStore
from auditlake.streaming.versions import GRACE, Versions, exists, markers, mkdirs, names

AUTH_RAW = "auth_fail_raw"
AUTH_DAILY = "auth_fail_daily"
STATUS = "sync_status"
SELECTION = "selection"
CONNECTION = "connection"
TABLE_NAMES = "table_names"


def _staging(state: ST.State, what: str) -> str:
    return state.path(f"_staging/{what}-{uuid.uuid4().hex[:12]}")


def upsert_date_partitions(spark: SparkSession, path: str, updates: DataFrame, key: list,
                           staging: str, part_col: str = "DateKey") -> list:
    """Keyed upsert that rewrites only the partitions ``updates`` touches.

    The touched partition values are a handful of dates (collected: bounded
    by the batch's time span); existing rows of those partitions are read
    with partition pruning, merged (updates win), staged, then written back
    with dynamic partition overwrite.
    """
    touched = [r[0] for r in updates.select(part_col).distinct().collect()]
    if not touched:
        return []
    recover_table(spark, path)
    merged = updates
    if exists(spark, path):
        existing = spark.read.parquet(path).filter(F.col(part_col).isin(touched))
        merged = D.keyed_replace(existing.select(*updates.columns), updates, key)
    merged.write.mode("overwrite").partitionBy(part_col).parquet(staging)
    swap_partitions(spark, path, staging, [f"{part_col}={v}" for v in touched])
    return touched


def ingest_auth_failures(spark: SparkSession, state: ST.State, traces: DataFrame, repull: bool = False) -> int:
    """Module C: watermark scan (or a full re-pull, I5) -> D4 upsert -> A3/D7.

    Returns the number of labelled rows read from the feed.
    """
    raw_path = state.path(AUTH_RAW)
    since = None
    if not repull and exists(spark, raw_path):
        since = ST.newest_in_days(spark, raw_path)
    labels = L.scan_auth_failures(traces, since=since)
    # a row without a time passes no watermark filter: only those are looked for beside the scan
    untimed = L.scan_auth_failures(traces.filter(F.col("Timestamp").isNull())) if since is not None else None
    good, bad = L.split_quarantine(labels, L.AUTH_REQUIRED)
    if untimed is not None:
        bad = bad.unionByName(L.split_quarantine(untimed, L.AUTH_REQUIRED)[1])
    # the feed is read again on every run: the table holds each unusable row once
    bad = bad.distinct()
    kept = state.path(ST.AUTH_QUARANTINE)
    if exists(spark, kept):
        seen = spark.read.parquet(kept)
        same = [bad[c].eqNullSafe(seen[c]) for c in bad.columns]
        bad = bad.join(seen, same, "left_anti")
    ST.keep_quarantine(bad, kept, max(markers(spark, kept, "BatchId"), default=0) + 1)
    order = ["Id"] if "Id" in labels.columns else None
    batch = D.dedup_batch(good, D.auth_key(), order=order, last=True) \
        .select("Timestamp", "UserId", "ObjectId", "ObjectName") \
        .withColumn("DateKey", F.to_date("Timestamp"))
    n = batch.count()
    if n == 0:
        return 0
    touched = upsert_date_partitions(spark, raw_path, batch, D.auth_key(), _staging(state, "auth-raw"))
    # Recompute the touched days from raw and replace them in the daily table
    raw_days = spark.read.parquet(raw_path).filter(F.col("DateKey").isin(touched)).drop("DateKey")
    daily = R.auth_daily_rollup(raw_days)
    upsert_date_partitions(spark, state.path(AUTH_DAILY), daily,
                           [F.col(c) for c in R.AUTH_DAILY_KEY], _staging(state, "auth-daily"))
    return n


def purge_companies(spark: SparkSession, state: ST.State, companies: list[str]) -> int:
    """R3 on the stored change log; names are normalised (P15). Returns the deleted rows."""
    return ST.change_store(spark, state).purge(sorted({c.strip() for c in companies if c and c.strip()}))


def apply_change_retention(spark: SparkSession, state: ST.State, as_of: dt.datetime, months: int) -> int:
    """R2 on the stored change log. Returns the deleted rows."""
    months = RT.retention_months(months, RT.AUDIT_RETENTION_MONTHS)
    return ST.change_store(spark, state).retain(RT.months_back(as_of, months))


def apply_page_retention(spark: SparkSession, state: ST.State, as_of: dt.datetime, months: int) -> list[str]:
    """R1 on the raw page log. The daily deltas are untouched, so the rollup survives raw retention."""
    months = RT.retention_months(months, RT.PAGE_RETENTION_MONTHS)
    return ST.retain_page_log(spark, state, RT.months_back(as_of, months))


# ---------------------------------------------------------------- small versioned tables of the control state
def read_version(spark: SparkSession, path: str) -> DataFrame | None:
    versions = Versions(spark, path)
    version = versions.newest()
    return None if version is None else spark.read.parquet(versions.folder(version) + "/data")


def write_version(rows: DataFrame, path: str) -> DataFrame:
    """A small table as a new version; older ones go after the grace of ``Versions.vacuum``."""
    spark = rows.sparkSession
    versions = Versions(spark, path)
    version = versions.next()
    rows.coalesce(1).write.mode("overwrite").parquet(versions.folder(version) + "/data")
    versions.commit(version)
    versions.vacuum()
    return spark.read.parquet(versions.folder(version) + "/data")


def read_status(spark: SparkSession, state: ST.State) -> DataFrame | None:
    return read_version(spark, state.path(STATUS))


def upsert_status(spark: SparkSession, state: ST.State, rows: DataFrame) -> DataFrame:
    """Keyed replace of the per-module status, written as a new version."""
    cur = read_status(spark, state)
    merged = rows if cur is None else D.keyed_replace(cur.select(*rows.columns), rows, [F.col("Module")])
    return write_version(merged, state.path(STATUS))


def record_connection(spark: SparkSession, state: ST.State, tenant: str, environment: str,
                      companies: int | None, as_of: dt.datetime) -> DataFrame:
    """H7: the state of the connection; a run that didn't count the companies keeps the last known count of
    the same tenant and environment."""
    new = spark.createDataFrame([(tenant, environment, companies, as_of)],
                                "TenantId string, Environment string, Companies long, CheckedAt timestamp_ntz")
    known = read_version(spark, state.path(CONNECTION))
    if known is not None:
        new = H.carry_last_known(new, known, ["TenantId", "Environment"], "Companies")
    return write_version(new, state.path(CONNECTION))


@dataclass
class DailyRun:
    """One scheduled run over landed feeds.

    ``page_landing`` / ``change_landing`` are landing folders read by streaming file sources. ``changes_feed``
    (callable to a DataFrame of the ERP's entries) is read through the two-ended cursor: the rows it picks
    are landed as pages and taken up by the stream. ``traces``, ``directory`` (users), ``manual_map``, ``page_map`` and
    ``cloud`` (counts of the feeds per module) are callables too; what is not given is left out. Each
    module keeps its own state folder (and streaming checkpoint) under ``root``.
    """
    spark: SparkSession
    root: str
    page_landing: str | None = None
    page_schema: T.StructType | None = None
    page_format: str = "parquet"
    change_landing: str | None = None
    changes_feed: object = None
    traces: object = None
    directory: object = None
    manual_map: object = None
    page_map: object = None
    cloud: object = None
    settings: Settings = field(default_factory=Settings)
    log: list = field(default_factory=list)      # (step, exit code, detail) of this object's runs

    def _state(self, name: str) -> ST.State:
        return ST.State(f"{self.root.rstrip('/')}/{name}")

    @property
    def pages(self) -> ST.State:
        return self._state("pages")

    @property
    def changes(self) -> ST.State:
        return self._state("changes")

    @property
    def errors(self) -> ST.State:
        return self._state("errors")

    @property
    def control(self) -> ST.State:
        return self._state("control")

    @property
    def requests(self) -> PurgeRequests:
        return PurgeRequests(self.spark, self.control.path("requests"))

    @property
    def users(self) -> UserStore:
        return UserStore(self.spark, self._state("directory").root)

    @property
    def snapshot_path(self) -> str:
        return self._state("snapshot").root

    def run(self, mode: str = "ingest", as_of: dt.datetime | None = None,
            purge: list[str] | None = None) -> list:
        """``ingest``: A, C, B with retention, users, status, snapshot. ``repull``: the same, with module C
        re-read from the start (nothing deleted, the upsert fills gaps). ``purge`` queues a purge of ``purge``.
        While a purge request is open, a run of any mode only purges and publishes a snapshot (I9): an
        ingest would fetch the purged companies again.

        A step that fails is logged with exit code 1 and does not stop the others (a failed purge stays
        claimed and is taken up by the next run). ``as_of`` is the run's time; without one there is
        no retention. Returns ``log``; the same lines go to ``control/logs`` (S8, H3).
        """
        if mode not in ("ingest", "repull", "purge"):
            raise ValueError(f"unknown mode {mode!r}")
        settings = self.settings.validated()
        now = as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        first = len(self.log)
        if mode == "purge" and purge:
            self.requests.submit(purge)
        self._step("selection", lambda: self._apply_selection(settings))
        if self.requests.pending():
            self._step("purge", self._purge)
        elif mode != "purge":
            self._step("modul A", lambda: self._pages(settings, as_of), self.page_landing)
            self._step("modul C", lambda: ingest_auth_failures(self.spark, self.errors, self.traces(), repull=mode == "repull"),
                       self.traces)
            self._step("modul B", lambda: self._changes(settings, as_of), self.change_landing)
            self._step("uzivatele", lambda: self.users.load(
                L.read_user_directory(self.directory()), now, self.manual_map() if self.manual_map else None), self.directory)
            self._step("sync-status", lambda: self.status(now, self.cloud()).count(), self.cloud)
        self._step("snapshot", lambda: self.publish(now), self.page_map)
        self._write_log(now, self.log[first:])
        return self.log

    def _step(self, name: str, work, given: object = True) -> None:
        if given is None:
            return
        try:
            self.log.append((name, 0, work()))
        except Exception as e:  # noqa: BLE001 -- one failing step must not stop the rest
            self.log.append((name, 1, f"{type(e).__name__}: {str(e)[:300]}"))

    def _write_log(self, now: dt.datetime, entries: list) -> None:
        lines = [(i, f"{now:%H:%M:%S} {name} exit={code}" + (f" {detail}" if code else "")) for i, (name, code, detail) in
                 enumerate(entries)]
        self.spark.createDataFrame(lines, "LineNo long, value string").coalesce(1) \
            .write.parquet(f"{self.control.path('logs')}/File=run-{now:%Y%m%d-%H%M%S}-{uuid.uuid4().hex[:6]}")

    def run_log(self) -> DataFrame:
        """All log lines, parsed (S8): File, LineNo, Step, ExitCode, Rollback."""
        rows = self.spark.read.schema("LineNo long, value string, File string").parquet(self.control.path("logs"))
        return L.parse_run_log(rows)

    def _purge(self) -> int:
        """The effect is committed before the request is acknowledged; in between, a run that dies repeats it."""
        claimed = self.requests.claim()
        n = purge_companies(self.spark, self.changes, [c for names_ in claimed.values() for c in names_])
        self.requests.acknowledge(claimed)
        return n

    def _apply_selection(self, settings: Settings) -> int:
        """Companies that were selected and are not any more are queued for a purge, if the settings say so."""
        path = self.control.path(SELECTION)
        enabled = settings.enabled_companies
        rows = [(None,)] if enabled is None else [(c,) for c in enabled]   # one NULL row: all companies
        now = self.spark.createDataFrame(rows, "CompanyName string")
        was = read_version(self.spark, path)
        before = None if was is None else {r.CompanyName for r in was.collect()}
        if before == {r[0] for r in rows}:
            return 0
        removed = []
        if before is not None and enabled is not None and settings.auto_purge_on_remove:
            known = ST.change_store(self.spark, self.changes).edges().select("CompanyName")
            previous = None if before == {None} else was
            removed = [r.CompanyName for r in RT.removed_companies(previous, known, now).collect()]   # company names
            if removed:
                self.requests.submit(removed)
        write_version(now, path)
        return len(removed)

    def _pages(self, settings: Settings, as_of: dt.datetime | None) -> int:
        ST.run_page_stream(self.spark, self.page_landing, self.pages, self.page_schema, fmt=self.page_format,
                           lookback=settings.lookback)
        if as_of is not None and exists(self.spark, self.pages.path(ST.PAGE_RAW)):
            return len(apply_page_retention(self.spark, self.pages, as_of, settings.page_retention_months))
        return 0

    def _changes(self, settings: Settings, as_of: dt.datetime | None) -> int:
        store = ST.change_store(self.spark, self.changes)
        cutoff = None if as_of is None else RT.months_back(as_of, settings.audit_retention_months)
        if self.changes_feed is not None:
            feed = L.shape_change_log(self.changes_feed())
            if settings.enabled_companies is not None:
                feed = feed.filter(F.col("CompanyName").isin(settings.enabled_companies))
            rows = I.next_change_rows(feed, store.edges(), settings.caps, not_before=cutoff)
            ST.land_change_pages(L.unshape_change_log(rows), self.change_landing)
        ST.run_change_stream(self.spark, self.change_landing, self.changes, companies=settings.enabled_companies)
        self._table_names(store)
        return 0 if cutoff is None else store.retain(cutoff)

    def _table_names(self, store) -> None:
        """The names of tables, kept up to date from the batches stored since; the log is not read again for them."""
        known, upto = self.table_names(), 0
        if known is not None:
            upto = known.agg(F.max("UptoBatch")).first()[0]
        newest = store.files().agg(F.max("BatchId")).first()[0]
        if newest is None or newest <= upto:
            return
        new = store.rows(where=F.col("BatchId") > upto)
        names_ = M.merge_table_names(known if known is not None else new.limit(0), new)
        write_version(names_.withColumn("UptoBatch", F.lit(newest)), self.control.path(TABLE_NAMES))

    def table_names(self) -> DataFrame | None:
        """The stored table names (TableNo, TableName), for ``mining.classify_errors``; None before the first changes."""
        return read_version(self.spark, self.control.path(TABLE_NAMES))

    def publish(self, now: dt.datetime) -> int:
        """All sections from the stored tables of one moment, published as one version."""
        spark, store = self.spark, ST.change_store(self.spark, self.changes)
        stored = {"page_log": self.pages.path(ST.PAGE_RAW), "page_daily_deltas": self.pages.path(ST.PAGE_DELTAS),
                  "auth_fail_raw": self.errors.path(AUTH_RAW), "auth_fail_daily": self.errors.path(AUTH_DAILY),
                  "change_log": self.changes.path(ST.CHANGE_STORE)}
        inventory = S.storage_inventory(spark, {n: p for n, p in stored.items() if exists(spark, p)})
        with store.pinned() as change_log:
            sections = snapshot_sections(
                ST.daily_table(spark, self.pages), ST.stored_page_log(spark, self.pages),
                spark.read.parquet(self.errors.path(AUTH_DAILY)), change_log, self.users.users(), self.page_map(),
                now.date(), self.settings, read_status(spark, self.control), inventory)
            version = S.write_snapshot(sections, self.snapshot_path, now.strftime("%Y-%m-%d %H:%M:%S"))
        Versions(spark, self.snapshot_path).vacuum()
        return version

    def compact(self) -> dict:
        """Fold small partitions: daily deltas into a new base, page-log days, months and companies of the change
        log (all crash-safe, re-runnable); then remove what no reader can refer to any more (``vacuum``)."""
        out = {}
        if exists(self.spark, self.pages.path(ST.PAGE_DELTAS)):
            out["page_daily_base_version"] = ST.compact_daily(self.spark, self.pages)
        out["change_log_folders_folded"] = ST.compact_change_log(self.spark, self.changes)
        out["page_log_days_folded"] = len(ST.compact_page_log(self.spark, self.pages))
        out["removed"] = self.vacuum()
        return out

    def vacuum(self, grace: int = GRACE) -> int:
        """Remove old versions, folded deltas and files of attempts that died, except what a reader may still use."""
        self.users.vacuum()
        return ST.change_store(self.spark, self.changes).vacuum(grace) + ST.vacuum_daily(self.spark, self.pages, grace)

    def status(self, as_of: dt.datetime, cloud: list[DataFrame]) -> DataFrame:
        """A15 + D8: stored counts vs the given feed counts, upserted per module. The change log's count
        comes from its manifest."""
        spark, local = self.spark, []
        if exists(spark, self.pages.path(ST.PAGE_RAW)):
            local.append(H.module_count(ST.stored_page_log(spark, self.pages), "A", "LocalCount"))
        store = ST.change_store(spark, self.changes)
        if store.versions.newest() is not None:
            local.append(spark.createDataFrame([("B", store.count())], "Module string, LocalCount long"))
        if exists(spark, self.errors.path(AUTH_RAW)):
            local.append(H.module_count(spark.read.parquet(self.errors.path(AUTH_RAW)), "C", "LocalCount"))
        rows = H.sync_status(cloud, local, as_of).select("Module", "CloudCount", "LocalCount", "Pct", "UpdatedAt")
        return upsert_status(spark, self.control, rows)
