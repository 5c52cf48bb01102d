"""The stored change log: files by month and company under a versioned manifest.

* ``entries/Unit=<batch>-<id>/Month=<yyyy-MM>/Company=c<name>/`` -- what one batch or one compaction wrote. A
  unit's folder is new for every attempt, so an attempt that died leaves only files nothing refers to.
* ``manifest/v=<n>`` -- a row per live file: company, month, smallest and largest entry number and time,
  rows, deleted rows, and the delete folders that apply. The version is the commit: readers see it whole.
* ``deletes/<id>`` -- deletion vectors: keys of single deleted rows per unit, taken off when read and gone after
  the next compaction of that month and company.

Insert-if-absent reads the keys of only those files whose entry ranges the batch meets. A purge and the
retention of whole months drop manifest rows and write no entry; the month of the cutoff gets a deletion
vector. The manifest is read by the driver to choose folders: it has a row per file, as Spark's own file
listing has, and the rows of the files never pass it.
"""

from __future__ import annotations

import datetime as dt
import uuid
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import dedup as D
from auditlake.streaming.versions import GRACE, Versions, names, remove

ENTRIES, MANIFEST, DELETES = "entries", "manifest", "deletes"
COLUMNS = ("EntryNo long, ChangedAt timestamp_ntz, UserId string, CompanyName string, TableNo int, TableName string, "
           "FieldNo int, FieldName string, ChangeType string, PrimaryKey string, OldValue string, NewValue string")
PARTITIONS = "Unit string, Month string, Company string"
FILES = ("CompanyName string, Unit string, Month string, Company string, File string, BatchId long, FirstEntry long, "
         "LastEntry long, FirstAt timestamp_ntz, LastAt timestamp_ntz, Rows long, Deleted long, DeletedIn array<string>")
SPAN = 1_000_000   # entry numbers that share a task, and rows of a file at most: file ranges stay narrow


class ChangeStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, f"{self.path}/{MANIFEST}")

    # ------------------------------------------------------------ manifest
    def files(self, version: int | None = None) -> DataFrame:
        """The manifest: a row per live file of the version (the newest, unless named)."""
        version = self.versions.newest() if version is None else version
        if version is None:
            return self.spark.createDataFrame([], FILES)
        return self.spark.read.schema(FILES).parquet(self.versions.folder(version) + "/files")

    def _commit(self, files: DataFrame) -> int:
        version = self.versions.next()
        files.select(*[c.split()[0] for c in FILES.split(", ")]).coalesce(1) \
            .write.mode("overwrite").parquet(self.versions.folder(version) + "/files")
        self.versions.commit(version)
        return version

    # ------------------------------------------------------------ reading
    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], f"{COLUMNS}, {PARTITIONS}")
        return self.spark.read.schema(f"{COLUMNS}, {PARTITIONS}").option("basePath", f"{self.path}/{ENTRIES}").parquet(*paths)

    def _without_deleted(self, rows: DataFrame, folders: set[str]) -> DataFrame:
        if not folders:
            return rows
        keys = ["Unit", "CompanyName", "EntryNo"]
        gone = self.spark.read.parquet(*[f"{self.path}/{DELETES}/{f}" for f in sorted(folders)]).select(*keys)
        return rows.join(gone, keys, "left_anti")

    def _rows_of(self, files: DataFrame, whole_folders: bool = True) -> DataFrame:
        """Live rows of manifest rows, by folder (all files of a folder live and die together) or by file."""
        place = F.regexp_extract("File", "^(.*)/[^/]*$", 1) if whole_folders else F.col("File")
        found = files.groupBy(place.alias("p")).agg(F.flatten(F.collect_set("DeletedIn")).alias("d")).collect()
        parts = []
        for touched in (False, True):
            some = [r for r in found if bool(r["d"]) == touched]
            if some:
                rows = self._read([f"{self.path}/{ENTRIES}/{unquote(r['p'])}" for r in some])
                parts.append(self._without_deleted(rows, {d for r in some for d in r["d"]}))
        return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else self._read([])

    def rows(self, version: int | None = None, where: Column | None = None) -> DataFrame:
        """The stored entries, each once; ``where`` is a condition on manifest columns that prunes files."""
        files = self.files(version)
        return self._rows_of(files if where is None else files.where(where)).select(*[c.split()[0] for c in COLUMNS.split(", ")])

    @contextmanager
    def pinned(self):
        """``rows()`` of one version that vacuum leaves alone meanwhile."""
        with self.versions.lease() as version:
            yield self.rows(version)

    def count(self) -> int:
        """Stored rows, from the manifest alone."""
        return self.files().agg(F.coalesce(F.sum(F.col("Rows") - F.col("Deleted")), F.lit(0))).first()[0]

    def edges(self) -> DataFrame:
        """Largest and smallest entry number and rows per company; only files with deleted rows are read."""
        files, cut = self.files(), F.size("DeletedIn") > 0
        whole = files.where(~cut).select("CompanyName", "FirstEntry", "LastEntry", "Rows")
        parts = self._rows_of(files.where(cut)).select("CompanyName", F.col("EntryNo").alias("FirstEntry"),
                                                       F.col("EntryNo").alias("LastEntry"), F.lit(1).cast("long").alias("Rows"))
        return whole.unionByName(parts).groupBy("CompanyName").agg(
            F.max("LastEntry").alias("MaxEntryNo"), F.min("FirstEntry").alias("MinEntryNo"), F.sum("Rows").alias("StoredRows"))

    # ------------------------------------------------------------ writing
    def _write(self, rows: DataFrame, batch_id: int) -> DataFrame | None:
        """Store rows as a new unit; returns its manifest rows, None if there were no rows."""
        unit = f"{batch_id}-{uuid.uuid4().hex[:8]}"
        path = f"{self.path}/{ENTRIES}/Unit={unit}"
        spans = [F.col("Month"), F.col("Company"), F.floor(F.col("EntryNo") / SPAN)]
        # a fixed number of tasks: a batch of many small folders would else be coalesced into one task that writes them all
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.withColumns({"Month": F.date_format("ChangedAt", "yyyy-MM"), "Company": F.concat(F.lit("c"), "CompanyName")}) \
            .repartition(tasks, *spans).sortWithinPartitions("Month", "Company", "EntryNo") \
            .write.option("maxRecordsPerFile", SPAN).partitionBy("Month", "Company").parquet(path)
        if not any(n.startswith("Month=") for n in names(self.spark, path)):
            return None
        return self._read([path]).groupBy("CompanyName", "Unit", "Month", "Company",
                              F.substring_index("_metadata.file_path", f"/{ENTRIES}/", -1).alias("File")).agg(
            F.lit(batch_id).cast("long").alias("BatchId"), F.min("EntryNo").alias("FirstEntry"), F.max("EntryNo").alias("LastEntry"),
            F.min("ChangedAt").alias("FirstAt"), F.max("ChangedAt").alias("LastAt"), F.count(F.lit(1)).alias("Rows"),
            F.lit(0).cast("long").alias("Deleted"), F.array().cast("array<string>").alias("DeletedIn"))

    def met_files(self, batch: DataFrame) -> DataFrame:
        """Manifest rows of the files whose entry range meets an entry of the batch."""
        ranges = batch.groupBy("CompanyName", F.floor(F.col("EntryNo") / SPAN).alias("span")) \
            .agg(F.min("EntryNo").alias("lo"), F.max("EntryNo").alias("hi")).withColumnRenamed("CompanyName", "c")
        met = (F.col("CompanyName") == F.col("c")) & (F.col("FirstEntry") <= F.col("hi")) & (F.col("LastEntry") >= F.col("lo"))
        return self.files().join(ranges, met, "left_semi")

    def add(self, batch: DataFrame, batch_id: int) -> int | None:
        """D3 + I7: append the entries of a batch that aren't stored yet; a batch that is committed already is left
        alone. Returns the new version, None if there was nothing to add."""
        files = self.files()
        if files.where(F.col("BatchId") == batch_id).limit(1).count():
            return None
        rows = D.dedup_batch(batch, D.change_key())
        stored = self._rows_of(self.met_files(batch), whole_folders=False)
        if stored.inputFiles():
            rows = D.anti_join(rows, stored.select("CompanyName", "EntryNo"), D.change_key())
        new = self._write(rows, batch_id)
        return None if new is None else self._commit(files.unionByName(new))

    def compact(self) -> int:
        """Rewrite every month and company that lies in several units or has deleted rows as one; returns how many did."""
        files = self.files()
        groups = files.groupBy("Month", "Company").agg(F.count_distinct("Unit").alias("units"), F.sum("Deleted").alias("gone"),
                                                       F.max(F.abs("BatchId")).alias("newest")) \
            .where((F.col("units") > 1) | (F.col("gone") > 0)).cache()
        try:
            n = groups.count()
            if n == 0:
                return 0
            keys = ["Month", "Company"]
            new = self._write(self._rows_of(files.join(groups, keys, "left_semi")),
                              -groups.agg(F.max("newest")).first()[0])
            rest = files.join(groups, keys, "left_anti")
            self._commit(rest if new is None else rest.unionByName(new))
            return n
        finally:
            groups.unpersist()

    # ------------------------------------------------------------ deleting
    def _drop(self, gone: Column) -> int:
        files = self.files()
        n = files.where(gone).agg(F.coalesce(F.sum(F.col("Rows") - F.col("Deleted")), F.lit(0))).first()[0]
        if files.where(gone).limit(1).count():
            self._commit(files.where(~gone))
        return n

    def purge(self, companies: list[str]) -> int:
        """Drop all files of the companies; returns the rows they held. No entry is written."""
        return self._drop(F.col("CompanyName").isin(companies)) if companies else 0

    def retain(self, cutoff: dt.datetime) -> int:
        """R2: drop entries before ``cutoff``: whole folders by the manifest, rows of the month the cutoff lies in
        by a deletion vector. Returns the deleted rows."""
        files, folder = self.files(), ["Unit", "Month", "Company"]
        newest = files.groupBy(*folder).agg(F.max("LastAt").alias("last"))
        old = newest.where(F.col("last") < F.lit(cutoff))
        gone = files.join(old, folder, "left_semi")
        n = gone.agg(F.coalesce(F.sum(F.col("Rows") - F.col("Deleted")), F.lit(0))).first()[0]
        stay = files.join(old, folder, "left_anti")
        edge = stay.where(F.col("FirstAt") < F.lit(cutoff))
        name = uuid.uuid4().hex
        path = f"{self.path}/{DELETES}/{name}"
        places = [r["File"] for r in edge.select("File").collect()]
        marked = 0
        if places:
            rows = self._read([f"{self.path}/{ENTRIES}/{unquote(p)}" for p in places]).where(F.col("ChangedAt") < F.lit(cutoff)) \
                .select("Unit", "CompanyName", "EntryNo",
                        F.substring_index("_metadata.file_path", f"/{ENTRIES}/", -1).alias("File"))
            before = edge.select(F.explode("DeletedIn").alias("d")).distinct().collect()
            self._without_deleted(rows, {r["d"] for r in before}).write.parquet(path)
            counts = self.spark.read.parquet(path).groupBy("File").agg(F.count(F.lit(1)).alias("more"))
            marked = counts.agg(F.coalesce(F.sum("more"), F.lit(0))).first()[0]
            touched = stay.join(counts, "File", "left")
            # a folder is read as a whole: the vector applies to all files of a folder that has deleted rows
            seen = F.max("more").over(_by(folder)).isNotNull()
            stay = touched.withColumns({
                "Deleted": F.col("Deleted") + F.coalesce("more", F.lit(0)),
                "DeletedIn": F.when(seen, F.array_append("DeletedIn", F.lit(name))).otherwise(F.col("DeletedIn"))})
        if n or marked:
            self._commit(stay)
        return n + marked

    def vacuum(self, grace: int = GRACE) -> int:
        """Remove folders that no kept or leased version refers to; returns how many. Not while a writer is at work."""
        kept = self.versions.vacuum(grace)
        if not kept:
            return 0
        live, vectors = set(), set()
        for v in kept:
            for r in self.files(v).select("Unit", F.regexp_extract("File", "^(.*)/[^/]*$", 1).alias("p"), "DeletedIn").distinct().collect():
                live.update([unquote(r["p"]), f"Unit={r['Unit']}"])
                vectors.update(r["DeletedIn"])
        removed = [f"{self.path}/{DELETES}/{d}" for d in names(self.spark, f"{self.path}/{DELETES}") if d not in vectors]
        base = f"{self.path}/{ENTRIES}"
        for unit in names(self.spark, base):
            if unit not in live:
                removed.append(f"{base}/{unit}")
                continue
            for month in (m for m in names(self.spark, f"{base}/{unit}") if m.startswith("Month=")):
                folders = names(self.spark, f"{base}/{unit}/{month}")
                removed += [f"{base}/{unit}/{month}/{c}" for c in folders if f"{unit}/{month}/{c}" not in live]
        for path in removed:
            remove(self.spark, path)
        return len(removed)


def _by(columns: list[str]):
    from pyspark.sql import Window
    return Window.partitionBy(*columns)
