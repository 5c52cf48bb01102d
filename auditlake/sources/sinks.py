"""Sinks: stored tables, the dashboard snapshot, table exports, storage inventory."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions import columns as C

# Export formats (Excel-friendly CSV: BOM + ';'; TXT: tab).
BOM = "\ufeff"
CSV_SEP = ";"
TXT_SEP = "\t"


def _texty(df: DataFrame) -> DataFrame:
    """Render dates and timestamps like the snapshot (P16) -- at the sink only."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        if t in ("timestamp", "timestamp_ntz"):
            out.append(C.ts_text(f.name).alias(f.name))
        elif t == "date":
            out.append(C.date_text(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def export_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Export the whole filtered set -- CSV (BOM, ';') or TXT (tab).

    The BOM is prefixed to the first header name so Excel detects UTF-8;
    every task writes its own part file (nothing is gathered on the driver).
    """
    sep = CSV_SEP if fmt == "csv" else TXT_SEP
    out = _texty(df)
    first = out.columns[0]
    out = out.withColumnRenamed(first, BOM + first)
    (out.write.mode("overwrite").option("header", True).option("sep", sep)
     .option("encoding", "UTF-8").csv(path))


def write_snapshot(sections: dict[str, DataFrame], path: str, generated_utc: str) -> int:
    """Publish all sections as one new version ``v=<n>`` of the dashboard snapshot; returns its number.

    A section is a folder of JSON lines written by the executors; a small manifest has the time and every
    section's columns. The version counts once its commit marker exists, which is made last: readers see all
    sections of one moment or the version before.
    """
    from auditlake.streaming.versions import Versions
    spark = next(iter(sections.values())).sparkSession
    versions = Versions(spark, path.rstrip("/"))
    version = versions.next()
    folder = versions.folder(version)
    columns = {}
    for name, df in sections.items():
        texts = _texty(df)
        columns[name] = texts.schema.jsonValue()
        texts.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/{name}")
    manifest = json.dumps({"generatedUtc": generated_utc, "sections": columns})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    versions.commit(version)
    return version


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The sections of one published version (the newest, unless named); ``generatedUtc`` among them."""
    from auditlake.streaming.versions import Versions
    versions = Versions(spark, path.rstrip("/"))
    version = versions.newest() if version is None else version
    if version is None:
        return {}
    folder = versions.folder(version)
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    out = {n: spark.read.schema(T.StructType.fromJson(columns)).json(f"{folder}/{n}") for n, columns in manifest["sections"].items()}
    return {**out, "generatedUtc": spark.createDataFrame([(manifest["generatedUtc"],)], "GeneratedUtc string")}


def storage_inventory(spark: SparkSession, datasets: dict[str, str], sizes: bool = True) -> DataFrame:
    """Rows and size (MB, one decimal) per dataset, largest first.

    One scan without columns counts the rows of all datasets by file, one listing (``binaryFile`` without its
    content reads no file) gives the lengths of the files; what folder a file lies in names its dataset.
    """
    places = {name: _fs(spark, path) for name, path in datasets.items()}
    roots = {name: fs.makeQualified(p).toUri() for name, (fs, p) in places.items()}

    def dataset(uri: Column, raw: bool) -> Column:
        path = F.regexp_replace(uri, "^[A-Za-z0-9+.-]+:(//[^/]*)?", "")
        out = None
        for name, root in roots.items():
            base = root.getRawPath() if raw else root.getPath()
            inside = (path == base) | path.startswith(base.rstrip("/") + "/")
            out = F.when(inside, F.lit(name)) if out is None else out.when(inside, F.lit(name))
        return out

    paths = list(datasets.values())
    counts = spark.read.schema("_none int").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(*paths) \
        .groupBy(dataset(F.col("_metadata.file_path"), True).alias("Dataset")).agg(F.count(F.lit(1)).alias("Rows"))
    names = spark.createDataFrame([(n,) for n in datasets], "Dataset string").withColumn("Rows", F.lit(0).cast("long"))
    rows = names.unionByName(counts)
    if not sizes:
        return rows.groupBy("Dataset").agg(F.sum("Rows").alias("Rows")).orderBy("Dataset")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(paths) \
        .groupBy(dataset(F.col("path"), False).alias("Dataset")).agg(F.sum("length").alias("Bytes"))
    both = rows.unionByName(files, allowMissingColumns=True).groupBy("Dataset") \
        .agg(F.sum("Rows").alias("Rows"), F.coalesce(F.sum("Bytes"), F.lit(0)).alias("Bytes"))
    return (both.select("Dataset", "Rows", (F.col("Bytes") / F.lit(1024.0 * 1024.0)).cast("decimal(18,1)").alias("SizeMB"))
            .orderBy(F.col("SizeMB").desc(), F.col("Dataset")))


# ---------------------------------------------------------------- partition swaps
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


REPLACED = ".replaced_"   # hidden prefix: Spark's file listing always skips names starting with "."


def recover_table(spark: SparkSession, table_path: str) -> list[str]:
    """Finish or undo interrupted swaps: a ``.replaced_<part>`` whose ``<part>``
    is missing is put back; one whose ``<part>`` exists is deleted."""
    fs, root = _fs(spark, table_path)
    fixed = []
    if not fs.exists(root):
        return fixed
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if not name.startswith(REPLACED):
            continue
        target = _fs(spark, f"{table_path.rstrip('/')}/{name[len(REPLACED):]}")[1]
        if fs.exists(target):
            fs.delete(st.getPath(), True)
        else:
            _rename(fs, st.getPath(), target)
            fixed.append(name[len(REPLACED):])
    return fixed


def _rename(fs, source, target) -> None:
    """A rename that did not happen is an error: what would follow deletes the other copy."""
    if not fs.rename(source, target):
        raise OSError(f"rename failed: {source} to {target}")


def swap_partitions(spark: SparkSession, table_path: str, staging_path: str, parts: list[str]) -> None:
    """Replace partition folders ``parts`` (e.g. ``DateKey=2024-01-02``) of a table
    by their staged copies; a part missing from staging is removed.

    Every step is a rename or a delete of one folder, ordered so that at any
    crash point each partition is either the old or the new version, or the
    old one sits under ``.replaced_<part>`` for ``recover_table`` to restore.
    """
    base = table_path.rstrip("/")
    for part in parts:
        fs, target = _fs(spark, f"{base}/{part}")
        staged = _fs(spark, f"{staging_path.rstrip('/')}/{part}")[1]
        old = _fs(spark, f"{base}/{REPLACED}{part}")[1]
        if fs.exists(old):
            fs.delete(old, True)
        if fs.exists(target):
            _rename(fs, target, old)
        if fs.exists(staged):
            parent = target.getParent()
            if not fs.exists(parent):
                fs.mkdirs(parent)
            _rename(fs, staged, target)
        fs.delete(old, True)
