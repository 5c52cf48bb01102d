"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.session import scratch_path

# the six ASCII separators of the word pattern [^\x20\x09-\x0D]+
SEPARATORS = " \t\n\u000b\f\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"

# Python stages work through a record batch in pieces of about this many bytes of
# text; a longer single text is a piece of its own.
PIECE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored once in the shared folder and read back: the lineage ends there,
    so a lost executor costs a re-read and not a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``: whatever else the input carries cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def with_row_struct(df: DataFrame) -> DataFrame:
    """All input columns under one struct ``row``, so computed columns never clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpack(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def pieces(batch) -> Iterator:
    """Slices of a record batch whose ``text`` column holds about PIECE_BYTES each."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(size) - size) // PIECE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def text_bytes(batch) -> list:
    """The ``text`` column as UTF-8 bytes objects (None for null), without decoding."""
    import pyarrow as pa

    col = batch.column("text")
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` (long, u != v) to ``(node, root)``: root = smallest node reachable.

    Alternating large-star and small-star rounds: every round is two partial aggregates
    and two shuffle joins (a hub with a third of the edges is split by AQE), the number of
    rounds is logarithmic in the longest chain. Each round is written to the shared folder. The
    rounds end when the edges are stars: no node points to two others, and none that is pointed to points on.
    """
    def stars(e: DataFrame) -> bool:
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")) \
            .unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
        return nodes.where("out > 1 or (out > 0 and into > 0)").limit(1).count() == 0

    cur = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                  .where("u <> v").distinct(), "cc")
    while not stars(cur):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        cur = written(small, "cc")
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
