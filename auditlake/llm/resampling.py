"""Target-distribution importance resampling of documents.

1. Features are the runs of 1 and 2 words; every feature falls into one of ``BUCKETS`` buckets. One pass
   counts the buckets of the source and of the target (each task adds up its own counts first).
2. A bucket's gain is its log ratio of target to source frequency; the gains are one array of fixed
   length. A document's weight is the floored mean gain of its features; with Gumbel noise drawn from
   its id the weight becomes a score, so that the best scores are a sample without replacement.
3. The exact cutoff score is found by weighted median-of-medians: every task gives the median key of its
   remaining rows, their median weighted by the rows they stand for is the next pivot, and the side that
   cannot hold the cutoff is discarded (at least an eighth of the rows a round). No row leaves its task.
4. Winners are range-partitioned, sorted and numbered.

Defined results: null and empty texts have no feature, weight 0 and no word (never drawn); equal scores go to
the smaller id, null ids last; rows that repeat an id are documents of their own, and of rows alike in every
column any may be drawn; an empty table gives an empty result, an empty target gives gains of the
source alone; other columns are never read; texts of any length are read whole, in slices.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import id_and_text, pieces, text_bytes, written
from auditlake.operators.views import ranked_top

BUCKETS = 10_000
GAIN_SCALE = 1000
SEED = 7
SHARE = 25              # per cent of the documents with MIN_WORDS words or more
MIN_WORDS = 20
SLICE = 1_000_000       # bytes of one text looked at together
CHUNK = 65_536          # rows whose median a task takes at a time
REWRITE = 16            # the remaining rows are stored anew when this many times fewer

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
KEYS = ["k_score", "k_null", "k_id", "k_features", "k_place"]


def feature_buckets(text: bytes, buckets: int):
    """(words, buckets of their features) of one text, slice by slice; no word is cut."""
    text, last = text.lower(), None
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        gap = GAP.search(text, end) if end < len(text) else None
        end = gap.start() if gap else len(text)
        words = WORDS.findall(text[at:end])
        at = end
        if not words:
            continue
        single = list(map(zlib.crc32, words))
        if last is not None:
            words = [last, *words]
            before = [zlib.crc32(last), *single]
        else:
            before = single
        pairs = map(zlib.crc32, words[1:], map(zlib.crc32, repeat(b" "), before))
        last = words[-1]
        found = np.fromiter(single, np.int64, len(single)), np.fromiter(pairs, np.int64, len(words) - 1)
        yield len(single), np.concatenate(found) % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for piece in (p for batch in batches for p in pieces(batch)):
            for text in text_bytes(piece):
                for _, found in feature_buckets(text or b"", buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counts = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, dtype=np.int64)
    for r in counts.collect():  # a row per bucket
        total[r["bucket"]] = r["n"]
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(GAIN_SCALE * math.log(float(t + 1) * (s_all + n) / (float(s + 1) * (t_all + n))))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def noise(doc_id, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-GAIN_SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and the row's place in its task."""
    import pyarrow as pa

    buckets = len(gains)

    def run(batches):
        place = 0
        for piece in (p for batch in batches for p in pieces(batch)):
            rows = []
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), text_bytes(piece)):
                n_words = n_features = total = 0
                for words, found in feature_buckets(text or b"", buckets):
                    n_words, n_features, total = n_words + words, n_features + len(found), total + int(gains[found].sum())
                weight = total // n_features if n_features else 0
                rows.append((n_words, n_features, weight, weight + noise(doc_id, seed), place))
                place += 1
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *[pa.array(c, pa.int64()) for c in zip(*rows)]],
                                             names=["doc_id", "n_words", "n_features", "weight", "score", "place"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long, score long, place long")


# ---------------------------------------------------------------- selection
def weighted_median(keys: list, sizes: list):
    """The first key, in order, at which half of the total size is reached."""
    half, seen = sum(sizes) / 2, 0
    for key, size in sorted(zip(keys, sizes)):
        seen += size
        if seen >= half:
            return key


def _medians(rows: DataFrame, keys: list[str], pivot: tuple | None) -> list:
    """Per task and side of the pivot (-1 below, 0 equal, 1 above): median key and number of rows."""
    import pyarrow as pa

    key = F.struct(*keys)
    side = F.lit(-1)
    if pivot is not None:
        p = F.struct(*[F.lit(int(v)).cast("long").alias(k) for k, v in zip(keys, pivot)])
        side = F.when(key < p, -1).when(key == p, 0).otherwise(1)
    names = ["side", *keys]

    def run(batches):
        held, n_held = {-1: [], 1: []}, {-1: 0, 1: 0}
        found = {-1: [], 1: []}   # (median key, rows) of every chunk
        equal = 0

        def close(s):
            cols = np.concatenate(held[s], axis=1)
            order = np.lexsort(cols[::-1])
            found[s].append((tuple(cols[:, order[(len(order) - 1) // 2]].tolist()), len(order)))
            held[s], n_held[s] = [], 0

        for batch in batches:
            cols = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
            equal += int((cols[0] == 0).sum())
            for s in (-1, 1):
                part = cols[1:, cols[0] == s]
                if part.shape[1]:
                    held[s].append(part)
                    n_held[s] += part.shape[1]
                    if n_held[s] >= CHUNK:
                        close(s)
        out = [(0, *[0] * len(keys), equal)] if equal else []
        for s in (-1, 1):
            if n_held[s]:
                close(s)
            if found[s]:
                m = weighted_median(*zip(*found[s]))
                out.append((s, *m, sum(n for _, n in found[s])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[*names, "n"])

    schema = ", ".join(f"{c} long" for c in [*names, "n"])
    return rows.select(side.cast("long").alias("side"), *keys).mapInArrow(run, schema).collect()  # three rows a task


def kth_smallest(rows: DataFrame, keys: list[str], k: int) -> tuple:
    """The ``k``-th smallest (1-based) tuple of the long columns ``keys`` of stored ``rows``."""
    stored = remaining = None
    pivot, low, high = None, None, None

    def within(df):
        key = F.struct(*keys)
        for bound, below in ((low, False), (high, True)):
            if bound is not None:
                b = F.struct(*[F.lit(int(v)).cast("long").alias(c) for c, v in zip(keys, bound)])
                df = df.where(key < b if below else key > b)
        return df

    while True:
        found = _medians(within(rows), keys, pivot)
        sides = {s: [(tuple(r[c] for c in keys), r["n"]) for r in found if r["side"] == s] for s in (-1, 0, 1)}
        below, equal = (sum(n for _, n in sides[s]) for s in (-1, 0))
        if pivot is None:
            stored = remaining = below
        elif k <= below:
            high, remaining = pivot, below
        elif k <= below + equal:
            return pivot
        else:
            k, low, remaining = k - below - equal, pivot, sum(n for _, n in sides[1])
        side = -1 if pivot is None or high == pivot else 1
        pivot = weighted_median(*zip(*sides[side]))
        if remaining * REWRITE < stored:
            rows, stored = written(within(rows).select(*keys), "remaining"), remaining


def draw(rows: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """``rank`` 1, 2, ... of the drawn rows of ``scored`` output, null for the others."""
    keyed = rows.select("*", (-F.col("score")).alias("k_score"), F.col("doc_id").isNull().cast("long").alias("k_null"),
                        F.coalesce("doc_id", F.lit(0)).alias("k_id"), F.col("n_features").alias("k_features"),
                        F.col("place").alias("k_place"))
    fit = keyed.where(F.col("n_words") >= min_words)
    k = fit.count() * share // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if k == 0:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    cutoff = F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(KEYS, kth_smallest(fit, KEYS, k))])
    wins = (F.col("n_words") >= min_words) & (F.struct(*KEYS) <= cutoff)
    ranked = ranked_top(keyed.where(wins), [F.col(c) for c in KEYS], 2**62, local_max=0)
    rank = F.when(F.col("_rank") <= k, F.col("_rank")).cast("long").alias("rank")  # rows alike at the cutoff
    return ranked.select(*out, rank).unionByName(keyed.where(~wins).select(*out, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """All documents with weight, score and rank; those with a rank are the sample."""
    docs = id_and_text(docs)
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target.select("text"), buckets))
    return draw(written(scored(docs, gains, seed), "scored"), share, min_words)


def op13(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark)
