"""Mixing sources: tempered weights, and budgets realised as block permutations.

A source's share of all tokens is raised to an exponent and normalised; the exponent is
bisected until the mix meets its target -- the largest flattening whose most repeated source
is read at most ``max_epochs`` times, or a target entropy. Weights become token budgets. A
budget is realised epoch by epoch: in epoch e a source's documents are ordered by
md5(seed:e:doc_id), whose first three hex digits name the block; whole epochs take every
document, the last one takes documents in that order while their token sum stays within
the rest of the budget.

Scale: one partial aggregate makes the source table; every bisection round evaluates a grid
of exponents by one Spark aggregate over that table and returns one small row per exponent.
The cut of the last epoch is found digit by digit (token sums per block, then inside the one
block that crosses the rest, and so on), so no task orders a whole source, however hot.

Defined results: tokens are words; a null text has none; a null source is a source of its own;
sources without tokens get one epoch; documents without tokens stay where their order puts
them; rows with equal doc_id and source share a place and are taken or left together; an
empty table gives an empty result; other columns are carried only by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.joins import bounded_broadcast
from auditlake.llm.common import WORD_RE, unpack, with_row_struct, written

MAX_EPOCHS = 2.0
SEED = 17
GRID = 1_000_000          # exponents are k / GRID
SECTIONS = 32             # exponents tried in a bisection round
DIGITS = 3                # hex digits of the order key per block level


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def tokens_by_row(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", source_key(F.col("source")).alias("skey"),
                       F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long").alias("n_tokens"))


def source_table(rows: DataFrame) -> DataFrame:
    return rows.groupBy("skey").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))


def _at(sources: DataFrame, ks: list[int]) -> list:
    """One row per exponent k / GRID: the largest over the smallest number of epochs, and the entropy."""
    live = sources.where("tokens > 0")
    total = live.agg(F.sum("tokens")).first()[0]
    if not total:
        return []
    p = live.select((F.col("tokens") / F.lit(float(total))).alias("p"))
    a = F.col("k") / GRID
    grid = p.select("p", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).select(
        "k", F.pow("p", a).alias("w"), F.pow("p", a - 1).alias("epochs"))
    return grid.groupBy("k").agg(
        (F.max("epochs") / F.min("epochs")).alias("spread"),
        (F.log(F.sum("w")) - F.sum(F.col("w") * F.log("w")) / F.sum("w")).alias("entropy")).orderBy("k").collect()


def exponent(sources: DataFrame, max_epochs: float | None = MAX_EPOCHS, entropy: float | None = None) -> float:
    """Smallest exponent in [0, 1] (a multiple of 1 / GRID) whose spread is within ``max_epochs``,
    or, with ``entropy`` (nats), whose mix has at most that entropy. 1 leaves the shares as they are."""
    if (max_epochs is None) == (entropy is None):
        raise ValueError("give either max_epochs or entropy")
    low, high = 0, GRID  # high always meets the target or is the end of the range
    while low < high:
        ks = sorted({low + (high - low) * i // SECTIONS for i in range(SECTIONS)})
        rows = _at(sources, ks)
        if not rows:
            return 1.0
        for r in rows:
            ok = r["spread"] <= max_epochs + 1e-12 if entropy is None else r["entropy"] <= entropy
            if ok:
                high = r["k"]
                break
            low = r["k"] + 1
    return high / GRID


def budgets(sources: DataFrame, alpha: float, total_budget: float | None = None) -> DataFrame:
    """Add weight, budget (tokens), full_epochs and rest. Without ``total_budget`` the least
    repeated source gets exactly one epoch, so no document is left out."""
    live = sources.where("tokens > 0")
    total = float(live.agg(F.sum("tokens")).first()[0] or 1)
    w = live.select("skey", "tokens", "docs", F.pow(F.col("tokens") / F.lit(total), F.lit(alpha)).alias("w"))
    whole = w.agg(F.sum("w").alias("sum_w"), F.max(F.col("tokens") / F.col("w")).alias("scale")).first()
    share = F.col("w") / F.lit(whole["sum_w"] or 1.0)
    want = F.col("w") * F.lit(whole["scale"] or 1.0) if total_budget is None else share * float(total_budget)
    got = w.select("skey", "tokens", "docs", share.alias("weight"), F.round(want).cast("long").alias("budget"))
    got = got.select("*", F.expr("budget div tokens").alias("full_epochs"), F.expr("budget % tokens").alias("rest"))
    empty = sources.where("tokens = 0").select(
        "skey", "tokens", "docs", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"),
        F.lit(1).cast("long").alias("full_epochs"), F.lit(0).cast("long").alias("rest"))
    return got.unionByName(empty)


def order_key(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"),
                             F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def last_epoch_cut(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """(skey, cut): the first order key of the last epoch that no longer fits the rest. Sources
    whose rest holds everything have no row."""
    part = plan.where("rest > 0").select("skey", "full_epochs", "rest")
    cur = rows.join(bounded_broadcast(part), "skey").select("skey", "n_tokens", "rest", order_key(F.col("full_epochs"), seed).alias("key"))
    for level in range(2):
        digit = F.substring("key", 1 + level * DIGITS, DIGITS)
        sums = cur.groupBy("skey", "rest", digit.alias("digit")).agg(F.sum("n_tokens").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("skey").orderBy("digit"))  # at most 16**DIGITS rows a source
        cross = sums.select("*", upto.alias("upto")).where("upto > rest") \
            .groupBy("skey").agg(F.min(F.struct("digit", "upto", "n", "rest")).alias("c")) \
            .select("skey", F.col("c.digit").alias("digit"),
                    (F.col("c.rest") - (F.col("c.upto") - F.col("c.n"))).alias("left"))
        cur = cur.join(bounded_broadcast(cross, materialize=True), "skey").where(digit == F.col("digit")) \
            .select("skey", "n_tokens", F.col("left").alias("rest"), "key")
    keys = cur.groupBy("skey", "rest", "key").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("skey").orderBy("key"))
    return keys.select("*", upto.alias("upto")).where("upto > rest").groupBy("skey").agg(F.min("key").alias("cut"))


def mix(docs: DataFrame, max_epochs: float | None = MAX_EPOCHS, entropy: float | None = None,
        total_budget: float | None = None, seed: int = SEED) -> DataFrame:
    """One row per taken document and epoch: doc_id, source, n_tokens, epoch, block, order_key.
    Reading by (epoch, order_key) gives the mixed order."""
    rows = written(tokens_by_row(docs), "mixrows")
    sources = written(source_table(rows), "sources")
    alpha = exponent(sources, max_epochs, entropy)
    plan = written(budgets(sources, alpha, total_budget), "plan")
    cuts = last_epoch_cut(rows, plan, seed)
    full = plan.join(cuts, "skey", "left").select("skey", "full_epochs", "rest", "cut")
    taken = rows.join(bounded_broadcast(full, materialize=True), "skey").select(
        "doc_id", "source", "n_tokens", "full_epochs", "cut",
        F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("rest") > 0, F.col("full_epochs"))
                             .otherwise(F.col("full_epochs") - 1))).alias("epoch")).where("epoch >= 0")
    taken = taken.select("*", order_key(F.col("epoch"), seed).alias("order_key"))
    taken = taken.where((F.col("epoch") < F.col("full_epochs")) | F.col("cut").isNull()
                        | (F.col("order_key") < F.col("cut")))
    return taken.select("doc_id", "source", "n_tokens", "epoch",
                        F.conv(F.substring("order_key", 1, DIGITS), 16, 10).cast("int").alias("block"), "order_key")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The input rows, each as often as the mix takes it; columns unchanged."""
    times = mix(docs, **options).groupBy("doc_id", source_key(F.col("source")).alias("skey"), "epoch") \
        .agg(F.lit(1).alias("one")).groupBy("doc_id", "skey").agg(F.count("*").cast("int").alias("times"))
    d = with_row_struct(docs).select("row", F.col("row.doc_id").alias("_id"), source_key(F.col("row.source")).alias("_s"))
    got = d.join(times, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_s") == F.col("skey")))
    return unpack(got.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")), docs.columns)


def op1(docs: DataFrame) -> DataFrame:
    return mix(docs)
