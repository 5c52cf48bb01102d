"""Incremental-load operators: watermarks, per-company edges, the two-ended cursor."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.joins import bounded_broadcast, materialized

# Fixed value: watermark when the target is empty.
DEFAULT_WATERMARK = dt.datetime(2000, 1, 1)
# What the settings hold for caps per company and run (forward, backfill, seed block) unless changed.
FORWARD_CAP = 150_000
BACKFILL_CAP = 50_000
SEED_ROWS = 5_000


def newest_first(target: DataFrame, col: str) -> DataFrame:
    """The row of the largest ``col``: every task keeps its largest, nothing is exchanged."""
    return target.select(col).where(F.col(col).isNotNull()).orderBy(F.desc(col)).limit(1)


def high_watermark(target: DataFrame, col: str = "Timestamp", default=DEFAULT_WATERMARK):
    """``MAX(col)`` of the stored table, ``default`` when empty.

    One scalar, used as a literal so the next scan's ``col > wm`` is a pushed-down filter. Pass rows
    before deduplication where ``col`` is part of the key: that cannot change its maximum. A table
    stored by day answers from its newest day alone (``streaming.ingest.newest_in_days``).
    """
    v = newest_first(target, col).collect()
    return v[0][0] if v else default


def company_edges(stored: DataFrame) -> DataFrame:
    """``MAX``, ``MIN`` and count of ``EntryNo`` per company, all companies in one job."""
    return stored.groupBy("CompanyName").agg(
        F.max("EntryNo").alias("MaxEntryNo"), F.min("EntryNo").alias("MinEntryNo"),
        F.count(F.lit(1)).alias("StoredRows"))


# Entry numbers of one histogram row (one bit each), and histogram rows of one coarse bucket.
FINE = 64
COARSE = 1 << 16


@dataclass(frozen=True)
class Caps:
    """Entries per company and run: above the stored ones, below them, and for a company without any."""
    forward: int
    backfill: int
    seed: int


def key_histogram(df: DataFrame, groups: list[str], descending: Column) -> DataFrame:
    """One row per group and FINE consecutive entry numbers: ``Slot`` in rank order, ``Bits`` of those that occur.

    The partial aggregate ORs the bits in every map task, so a hot company (or an entry delivered many
    times) shrinks before the shuffle; with numbers that mostly follow each other the result has 1/64 of the rows.
    """
    e = F.col("EntryNo")
    bucket = F.floor(e / F.lit(FINE)).cast("long")
    return (df.withColumn("Slot", F.when(descending, -bucket).otherwise(bucket))
            .withColumn("Down", descending)
            .groupBy(*groups, "Down", "Slot")
            .agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(EntryNo, {FINE}) AS INT))")).alias("Bits")))


def kth_keys(histogram: DataFrame, groups: list[str], ranks: Column, coarse_slots: int = COARSE) -> DataFrame:
    """The exact ``k``-th entry number per group, for every ``k`` in the array ``ranks``.

    The stored histogram is refined, no row of the feed is read: sums per coarse bucket give the coarse bucket
    that holds rank ``k``; inside it (at most ``coarse_slots`` rows) running sums give the fine one; its bits give the
    number. Windows see a group's coarse buckets, or one coarse bucket's rows. A group of fewer than
    ``k`` entries has no row.
    """
    h = histogram.withColumns({"Coarse": F.floor(F.col("Slot") / F.lit(coarse_slots)).cast("long"), "n": F.bit_count("Bits")})

    coarse = h.groupBy(*groups, "Coarse").agg(F.sum("n").alias("n"))
    run = Window.partitionBy(*groups).orderBy("Coarse").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = (coarse.withColumn("_before", F.sum("n").over(run) - F.col("n")).withColumn("k", F.explode(ranks))
          .where((F.col("_before") < F.col("k")) & (F.col("k") <= F.col("_before") + F.col("n")))
          .select(*groups, "Coarse", "k", (F.col("k") - F.col("_before")).alias("_need")))
    inside = h.join(bounded_broadcast(at, materialize=True), [*groups, "Coarse"])
    run = Window.partitionBy(*groups, "k").orderBy("Slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fine = (inside.withColumn("_before", F.sum("n").over(run) - F.col("n"))
            .where((F.col("_before") < F.col("_need")) & (F.col("_need") <= F.col("_before") + F.col("n"))))
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(FINE - 1)), lambda i: F.getbit("Bits", i) == 1)
    nth = (F.col("_need") - F.col("_before")).cast("int")
    bit = F.element_at(set_bits, F.when(F.col("Down"), -nth).otherwise(nth))
    bucket = F.when(F.col("Down"), -F.col("Slot")).otherwise(F.col("Slot"))
    return fine.select(*groups, "k", (bucket * FINE + bit).alias("Key"))


def first_n_per_company(df: DataFrame, n: int, descending: bool = False, coarse_slots: int = COARSE) -> DataFrame:
    """The rows of the first ``n`` entry numbers per company, in ``EntryNo`` order."""
    hist = materialized(key_histogram(df, ["CompanyName"], F.lit(descending)))
    cut = kth_keys(hist, ["CompanyName"], F.array(F.lit(n).cast("long")), coarse_slots).select("CompanyName", "Key")
    j = df.join(bounded_broadcast(cut, materialize=True), "CompanyName", "left")
    inside = F.col("EntryNo") >= F.col("Key") if descending else F.col("EntryNo") <= F.col("Key")
    return j.where(F.col("Key").isNull() | inside).drop("Key")


def next_change_rows(feed: DataFrame, edges: DataFrame, caps: Caps, not_before=None) -> DataFrame:
    """The change-log rows the next run fetches, per company; ``edges`` as of ``company_edges``.

    * seed (company with nothing stored): the newest ``caps.seed`` entries,
      then -- in the same run, as the reference re-reads its edges after the
      seed -- backfill below them;
    * forward: ``EntryNo > max`` ascending, at most ``caps.forward``;
    * backfill: ``EntryNo < min`` descending, at most ``caps.backfill``; off when
      the cap is 0 or ``min <= 1``. ``not_before`` (the audit retention cutoff)
      stops backfill from re-fetching what retention deleted (SURVEY §5 #4).

    The feed is read twice: once into a histogram of its entry numbers, which is stored and refined to the exact
    cutoff per company and phase, and once with the cutoffs (a row per company, broadcast after a size check) as a
    filter. No row is sorted or joined by shuffle. Caps count entry numbers: an entry that
    the feed delivers twice counts once and comes twice.
    """
    edges = bounded_broadcast(edges.select("CompanyName", "MaxEntryNo", "MinEntryNo"), materialize=True)
    mx, mn, e = F.col("MaxEntryNo"), F.col("MinEntryNo"), F.col("EntryNo")
    wanted = {"forward": caps.forward, "backfill": caps.backfill, "seedfill": caps.seed + max(caps.backfill, 0)}
    on = [p for p, n in wanted.items() if n > 0]
    phase = (F.when(mx.isNull(), "seedfill").when(e > mx, "forward").when((e < mn) & (mn > 1), "backfill"))

    def candidates(with_edges: DataFrame) -> DataFrame:
        cand = with_edges.withColumn("Phase", phase).filter(F.col("Phase").isin(on))
        if not_before is not None:
            cand = cand.filter((F.col("Phase") != "backfill") | (F.col("ChangedAt") >= F.lit(not_before)))
        return cand

    groups = ["CompanyName", "Phase"]
    hist = materialized(key_histogram(candidates(feed.join(edges, "CompanyName", "left")), groups, F.col("Phase") != "forward"))
    ranks = F.when(F.col("Phase") == "seedfill", F.array_distinct(F.array(F.lit(caps.seed), F.lit(wanted["seedfill"])))) \
        .when(F.col("Phase") == "forward", F.array(F.lit(caps.forward))).otherwise(F.array(F.lit(caps.backfill)))
    keys = kth_keys(hist, groups, ranks.cast("array<bigint>"))

    def key_of(p: str, k: int) -> Column:
        return F.max(F.when((F.col("Phase") == p) & (F.col("k") == k), F.col("Key")))

    cut = keys.groupBy("CompanyName").agg(
        key_of("forward", caps.forward).alias("ForwardTo"), key_of("backfill", caps.backfill).alias("BackfillFrom"),
        key_of("seedfill", wanted["seedfill"]).alias("SeedfillFrom"), key_of("seedfill", caps.seed).alias("SeedFrom"))
    bounds = cut.unionByName(edges, allowMissingColumns=True).groupBy("CompanyName").agg(
        *[F.max(c).alias(c) for c in ("MaxEntryNo", "MinEntryNo", "ForwardTo", "BackfillFrom", "SeedfillFrom", "SeedFrom")])
    j = feed.join(bounded_broadcast(bounds, materialize=True), "CompanyName", "left")
    p = F.col("Phase")
    inside = (F.when(p == "forward", e <= F.coalesce("ForwardTo", e)).when(p == "backfill", e >= F.coalesce("BackfillFrom", e))
              .otherwise(e >= F.coalesce("SeedfillFrom", e)))
    seed = F.lit(caps.seed > 0) & (e >= F.coalesce("SeedFrom", e))
    out = candidates(j).where(inside).withColumn(
        "Phase", F.when(p != "seedfill", p).when(seed, "seed").otherwise("backfill"))
    if not_before is not None:
        out = out.filter((F.col("Phase") != "backfill") | (F.col("ChangedAt") >= F.lit(not_before)))
    return out.drop("MaxEntryNo", "MinEntryNo", "ForwardTo", "BackfillFrom", "SeedfillFrom", "SeedFrom")
