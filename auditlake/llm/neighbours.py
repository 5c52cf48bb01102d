"""Approximate nearest neighbours over learned partitions.

1. Fit, on a bounded sample (SAMPLE vectors, those of smallest id hash): the neighbour graph of
   the sample, cut into balanced partitions by recursive bisection (smoothed along the graph,
   split at the median), and a softmax classifier from vector to partition. The number of
   partitions a query is routed to is the smallest whose estimated recall on sample rows held
   out from the classifier reaches TARGET.
2. Index every vector under its most probable partition; partitions are cut into chunks of
   CHUNK vectors by a hash of the id, so a partition of any size spreads over many tasks.
3. Route each query to its most probable partitions, rerank there by exact distance and merge.
   A query that finds fewer than ``k`` is searched again in all partitions.

Defined results: vectors null, empty, zero, or with null or non-finite components take no part;
vectors meet only vectors of their own length; rows that repeat a vec_id are separate candidates
(a query's own id never is) but one query, by its first vector; ties go to the smaller
vec_id; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from auditlake.llm.common import written

SAMPLE = 8192           # bound of the fitting sample, and with it of all model sizes
PARTITION_ROWS = 1500   # aimed at; at most SAMPLE // 32 partitions
GRAPH_K = 10
TARGET = 0.95
CHUNK = 4096
QUERIES_PER_BLOCK = 1024
TOP = 10


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    v = F.col("v")
    d = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return d.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0))


@dataclass
class Router:
    dim: int
    mean: np.ndarray
    scale: float
    weights: np.ndarray   # (dim + 1, partitions)
    probes: int

    @property
    def partitions(self) -> int:
        return self.weights.shape[1]

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return z @ self.weights[:-1] + self.weights[-1]


def _knn(x: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest others, by blocks."""
    n, sq = len(x), (x * x).sum(axis=1)
    out = np.empty((n, k), dtype=np.int64)
    for a in range(0, n, 512):
        d = sq[a:a + 512, None] - 2 * x[a:a + 512] @ x.T + sq[None, :]
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[a:a + 512] = near
    return out


def _bisect(near: np.ndarray, x: np.ndarray, members: np.ndarray, depth: int, label: np.ndarray, at: int) -> None:
    """Halve ``members`` along the slowest direction of the graph, again and again."""
    if depth == 0:
        label[members] = at
        return
    inside = np.full(len(x), -1, dtype=np.int64)
    inside[members] = np.arange(len(members))
    local = inside[near[members]]
    have = local >= 0
    y = x[members] - x[members].mean(axis=0)
    f = y @ np.linalg.svd(y, full_matrices=False)[2][0] if len(members) > 1 else np.zeros(len(members))
    for _ in range(30):  # smoothing along the edges pulls neighbours to one side
        f = (f - f.mean()) / (f.std() + 1e-12)
        f = 0.5 * f + 0.5 * np.where(have, f[local], 0).sum(axis=1) / np.maximum(have.sum(axis=1), 1)
    order = np.lexsort((members, f))
    half = len(members) // 2
    _bisect(near, x, np.sort(members[order[:half]]), depth - 1, label, 2 * at)
    _bisect(near, x, np.sort(members[order[half:]]), depth - 1, label, 2 * at + 1)


def _softmax_fit(z: np.ndarray, label: np.ndarray, parts: int) -> np.ndarray:
    """Multinomial logistic regression by accelerated gradient steps."""
    a = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros((a.shape[1], parts))
    hot = np.zeros((len(z), parts))
    hot[np.arange(len(z)), label] = 1
    step = 4.0 / (np.linalg.norm(a, 2) ** 2 / len(a))
    v = w.copy()
    for i in range(200):
        s = a @ v
        s = np.exp(s - s.max(axis=1, keepdims=True))
        s /= s.sum(axis=1, keepdims=True)
        new = v - step * (a.T @ (s - hot) / len(a) + 1e-4 * v)
        v, w = new + i / (i + 3) * (new - w), new
    return w


def fit(vectors: DataFrame, n_rows: int, sample: int = SAMPLE, target: float = TARGET) -> Router:
    """Fit on at most ``sample`` rows, chosen by id hash."""
    dim = vectors.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()["dim"]
    picked = vectors.where(F.size("v") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    x = np.unique(np.array([r["v"] for r in picked], dtype=np.float64), axis=0)
    x = x[np.random.default_rng(7).permutation(len(x))]
    mean = x.mean(axis=0)
    scale = float(x.std()) or 1.0
    depth = 0
    while 2 ** (depth + 1) <= max(1, min(n_rows // PARTITION_ROWS, len(x) // 32)):
        depth += 1
    if depth == 0:
        return Router(dim, mean, scale, np.zeros((dim + 1, 1)), 1)
    z = (x - mean) / scale
    near = _knn(z, min(GRAPH_K, len(x) - 1))
    label = np.zeros(len(x), dtype=np.int64)
    _bisect(near, z, np.arange(len(x)), depth, label, 0)
    held = np.arange(len(x)) % 4 == 0
    w = _softmax_fit(z[~held], label[~held], 2 ** depth)
    router = Router(dim, mean, scale, w, 2 ** depth)
    # recall if a query goes to its m most probable partitions and vectors lie where the classifier puts them
    score = router.logits(x[held])
    rank = np.argsort(np.argsort(-score, axis=1, kind="stable"), axis=1)
    home = router.logits(x).argmax(axis=1)[near[held]]
    where = np.take_along_axis(rank, home, axis=1)
    for m in range(1, 2 ** depth + 1):
        if (where < m).mean() >= target:
            router.probes = m
            break
    return router


def _routed(vectors: DataFrame, router: Router, probes: int) -> DataFrame:
    """Rows under their ``probes`` most probable partitions; another vector length is a partition of its own."""
    import pyarrow as pa

    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            col = batch.column("v")
            size = col.value_lengths().to_numpy(zero_copy_only=False)
            parts = [[-int(n)] for n in size]
            fit_rows = np.flatnonzero(size == router.dim)
            if len(fit_rows):
                x = col.take(pa.array(fit_rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, router.dim)
                best = np.argsort(-router.logits(x), axis=1, kind="stable")[:, :probes]
                for i, b in zip(fit_rows.tolist(), best.tolist()):
                    parts[i] = b
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), col, pa.array(parts, pa.list_(pa.int32()))],
                                             names=["vec_id", "v", "parts"])
    return vectors.select("vec_id", "v").mapInArrow(run, f"vec_id {kind}, v array<double>, parts array<int>")


def build_index(vectors: DataFrame, router: Router) -> DataFrame:
    """Every vector once: vec_id, v, part, chunk."""
    d = written(_routed(vectors, router, 1).select("vec_id", "v", F.col("parts")[0].alias("part")), "annindex")
    chunks = d.groupBy("part").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))  # a row per partition
    return d.join(F.broadcast(chunks), "part").select(
        "vec_id", "v", "part", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"), "chunks")


def search(queries: DataFrame, index: DataFrame, router: Router, k: int = TOP, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): exact distances within the probed partitions."""
    routed = _routed(queries, router, router.probes if probes is None else probes) \
        .select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.explode("parts").alias("part"))
    chunks = index.groupBy("part").agg(F.first("chunks").alias("chunks"))
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, queries.count() // QUERIES_PER_BLOCK))).cast("int")
    routed = routed.join(F.broadcast(chunks), "part").select(
        "query_id", "q", "part", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    blocks = routed.select("part", "chunk", "block").distinct()
    cand = index.join(blocks, ["part", "chunk"]).select(F.col("part").alias("c_part"), F.col("chunk").alias("c_chunk"),
                                                        F.col("block").alias("c_block"), "vec_id", "v")
    kind = queries.schema["vec_id"].dataType.simpleString()

    def rerank(left, right):
        import pandas as pd
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x = np.array(right["v"].tolist(), dtype=np.float64)
        ids = right["vec_id"].to_numpy()
        out_q, out_v, out_s = [], [], []
        for qid, q in zip(left["query_id"], left["q"]):
            d = np.zeros(len(x))
            for j, qj in enumerate(q):  # one summation order, whatever the block
                d += (x[:, j] - qj) ** 2
            d = np.sqrt(d)
            for i in np.flatnonzero(np.isinf(d)).tolist():  # the squares are too large, the distance need not be
                apart = np.abs(x[i] / 2 - np.asarray(q) / 2)
                d[i] = 2 * apart.max() * np.sqrt(((apart / apart.max()) ** 2).sum())
            others = np.flatnonzero(ids != qid)
            if not len(others):
                continue
            kth = np.partition(d[others], min(k, len(others)) - 1)[min(k, len(others)) - 1]
            near = others[d[others] <= kth]
            near = near[np.lexsort((ids[near], d[near]))][:k]
            out_q += [qid] * len(near)
            out_v += ids[near].tolist()
            out_s += d[near].tolist()
        return pd.DataFrame({"query_id": out_q, "vec_id": out_v, "score": out_s})

    keys = ["part", "chunk", "block"]
    found = routed.groupBy(*keys).cogroup(cand.groupBy(*[f"c_{c}" for c in keys])) \
        .applyInPandas(rerank, f"query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", "vec_id", "score", rank.alias("rank")).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, query_ids, k: int = TOP, sample: int = SAMPLE, target: float = TARGET,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found of every row whose id satisfies ``query_ids`` (a function of the id column)."""
    vectors = written(usable(rows, id_col, vector_col), "vectors")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    n = vectors.count()
    if n == 0:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    router = fit(vectors, n, sample, target)
    index = written(build_index(vectors, router), "annchunks")
    queries = written(vectors.where(query_ids(F.col("vec_id"))).groupBy("vec_id").agg(F.min("v").alias("v")), "annqueries")
    found = written(search(queries, index, router, k), "annfound")
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    short = written(queries.join(counts, queries["vec_id"] == counts["query_id"], "left")
                    .where(F.coalesce("n", F.lit(0)) < k).select("vec_id", "v"), "annshort")
    if router.probes < router.partitions and short.limit(1).count():
        again = search(short, index, router, k, router.partitions)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti") \
            .select("query_id", "rank", "vec_id", "score").unionByName(again)
    return found


def op10(rows: DataFrame) -> DataFrame:
    return nearest(rows, lambda c: c % 100 == 0)
