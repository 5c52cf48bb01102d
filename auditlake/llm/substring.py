"""Substring dedup by seed and extend.

Seeds: winnowing picks in every window of ``size`` words the k-gram of smallest hash, so two
equal windows hold the same anchor at the same place. Extension: an anchor owns a run of
neighbouring windows; its context is the words left and right of it that those windows
span. Documents meet on anchors:

1. anchors that occur once are dropped (partial aggregate, then a join that AQE can split);
2. occurrences with equal anchor and context form a class: all but the first extend over the
   whole context to the first, so all their windows repeat. No pairs are made: a class of a
   million copies costs a million rows;
3. the first occurrence of each of several classes of one anchor may match another class in
   part: its windows are compared one by one, again by first occurrence;
4. repeated windows that overlap are merged into maximal repeats of at least ``size`` words.

Defined results: null and empty texts have no words; documents are ordered by (doc_id, CRC-32 of
the text), a null doc_id first; rows that agree in both are one document whose result every
such row gets; texts shorter than ``size`` words lose nothing; other columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import id_and_text, pieces, text_bytes, written
from auditlake.llm.seeds import Anchors, Words, covered

SIZE = 20
GRAM = 6

PLACE = ["doc_id", "crc", "pos"]


def _same_doc(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    b = b.withColumnsRenamed({"doc_id": "_doc_id", "crc": "_crc"})
    return a.join(b, a["doc_id"].eqNullSafe(b["_doc_id"]) & (a["crc"] == b["_crc"]), how).drop("_doc_id", "_crc")


def prepared(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), "text")


def id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def seed_rows(docs: DataFrame, size: int, k: int) -> DataFrame:
    """(gram, context, doc_id, crc, pos): each anchor class once per document, at its first place."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                w = Words(text_bytes(piece))
                a = Anchors(w, size, k)
                own = np.flatnonzero(a.first_in_doc() == np.arange(len(a.at)))
                take = pa.array(a.doc[own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.gram[own].view(np.int64)), pa.array(a.context[own].view(np.int64)),
                     piece.column("doc_id").take(take), piece.column("crc").take(take),
                     pa.array((a.at[own] - w.first[a.doc[own]]).astype(np.int32))],
                    names=["gram", "context", "doc_id", "crc", "pos"])
    return docs.mapInArrow(run, f"gram long, context long, doc_id {id_type(docs)}, crc long, pos int")


def classes_to_marks(seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repeated anchors to (whole, part): places whose whole context repeats an earlier one with
    that first place, and first places whose windows must be compared."""
    place = F.struct(*PLACE)
    cls = seeds.groupBy("gram", "context").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    several = cls.groupBy("gram").agg(F.count("*").alias("n_classes")).where("n_classes > 1").select("gram")
    whole = seeds.join(cls.where("n > 1").select("gram", "context", "first"), ["gram", "context"]) \
        .where(~place.eqNullSafe(F.col("first"))).select(*PLACE, "first")
    part = cls.join(several, "gram").select("first.*")
    return whole, part


def window_rows(docs: DataFrame, part: DataFrame, size: int, k: int) -> DataFrame:
    """Windows owned by the listed anchors: (gram, off, win, doc_id, crc, pos)."""
    import pyarrow as pa

    listed = part.groupBy("doc_id", "crc").agg(F.array_sort(F.collect_set("pos")).alias("anchors"))
    joined = _same_doc(docs.dropDuplicates(["doc_id", "crc"]), listed, "inner").select("doc_id", "crc", "text", "anchors")

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                w = Words(text_bytes(piece))
                a = Anchors(w, size, k)
                col = piece.column("anchors")
                doc = np.repeat(np.arange(piece.num_rows), col.value_lengths().to_numpy(zero_copy_only=False))
                at = w.first[doc] + col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                own = np.searchsorted(a.at, at)
                count = a.high[own] - a.low[own] + 1
                own = np.repeat(own, count)
                nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                start = a.low[own] + nth
                take = pa.array(a.doc[own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.gram[own].view(np.int64)), pa.array((a.at[own] - start).astype(np.int32)),
                     pa.array(w.runs.of(start, np.int64(size)).view(np.int64)),
                     piece.column("doc_id").take(take), piece.column("crc").take(take),
                     pa.array((start - w.first[a.doc[own]]).astype(np.int32))],
                    names=["gram", "off", "win", "doc_id", "crc", "pos"])
    return joined.mapInArrow(run, f"gram long, off int, win long, doc_id {id_type(docs)}, crc long, pos int")


def repeated_windows(windows: DataFrame) -> DataFrame:
    """Window places that are not the first of their words: (doc_id, crc, pos, first)."""
    key = ["gram", "off", "win"]
    firsts = windows.groupBy(*key).agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n")).where("n > 1")
    return windows.join(firsts, key).where(~F.struct(*PLACE).eqNullSafe(F.col("first"))).select(*PLACE, "first")


def per_document(docs: DataFrame, whole: DataFrame, wins: DataFrame) -> DataFrame:
    """docs with the sorted arrays ``whole`` (anchor positions) and ``wins`` (window starts), each place once
    however often its row was delivered."""
    def listed(d: DataFrame, name: str, pos: Column) -> DataFrame:
        return d.groupBy("doc_id", "crc").agg(F.array_sort(F.collect_set(pos)).alias(name))
    marks = listed(whole, "whole", F.col("pos")).withColumn("wins", F.lit(None).cast("array<int>")).unionByName(
        listed(wins, "wins", F.col("pos")).withColumn("whole", F.lit(None).cast("array<int>")))
    marks = marks.groupBy("doc_id", "crc").agg(F.max("whole").alias("whole"), F.max("wins").alias("wins"))
    return _same_doc(docs, marks, "left").select("doc_id", "crc", "text", "whole", "wins")


def _list(col, i) -> np.ndarray:
    v = col[i].values
    return np.empty(0, dtype=np.int64) if v is None else v.to_numpy(zero_copy_only=False).astype(np.int64)


def repeated_starts(w: Words, a: Anchors, piece, d: int, lead: np.ndarray) -> np.ndarray:
    """Starts (within document d) of the windows to remove: those owned by an anchor that is
    marked, or that repeats an earlier class of its document, and the single windows."""
    lo, hi = np.searchsorted(a.doc, [d, d + 1])
    base = w.first[d]
    marked = np.isin(a.at[lo:hi] - base, _list(piece.column("whole"), d))
    own = lo + np.flatnonzero(marked | (lead[lo:hi] != np.arange(lo, hi)))
    owned = [np.arange(a.low[x], a.high[x] + 1) - base for x in own]
    return np.concatenate([*owned, _list(piece.column("wins"), d)]) if owned or piece.column("wins")[d].is_valid \
        else np.empty(0, dtype=np.int64)


def spans_of(gone: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edge[0::2], edge[1::2])]


def dedup(docs: DataFrame, size: int = SIZE, k: int = GRAM) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept (text of the kept words, joined by
    one space) and spans (start, end) of the removed maximal repeats, in words."""
    return _resolve(docs, size, k, True)


def _resolve(docs: DataFrame, size: int, k: int, with_text: bool) -> DataFrame:
    import pyarrow as pa

    d = prepared(docs)
    seeds = written(seed_rows(d, size, k), "seeds")
    repeated = seeds.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    # two seeds of one document may share a gram: contexts differ, so they count as two
    seeds = written(seeds.join(repeated, "gram"), "repseeds")
    whole, part = classes_to_marks(seeds)
    wins = repeated_windows(written(window_rows(d, part, size, k), "windows"))
    joined = per_document(d, whole, wins)
    kind = id_type(d)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                texts = text_bytes(piece)
                w = Words(texts)
                a = Anchors(w, size, k)
                lead = a.first_in_doc()
                n, gone_n, kept, spans = [], [], [], []
                for i, t in enumerate(texts):
                    own = (t or b"").split()
                    starts = repeated_starts(w, a, piece, i, lead)
                    cut = []
                    if len(starts):
                        gone = covered(len(own), starts, size)
                        cut = spans_of(gone)
                        own = [x for x, g in zip(own, gone.tolist()) if not g]
                    n.append(int(w.first[i + 1] - w.first[i]))
                    gone_n.append(n[-1] - len(own))
                    text = b" ".join(own)
                    kept.append(text.decode() if with_text else hashlib.sha256(text).hexdigest())
                    spans.append([{"start": x, "end": y} for x, y in cut])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone_n, pa.int64()),
                     pa.array(kept, pa.string()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    names=["doc_id", "n_words", "n_removed", "kept", "spans"])
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string, "
                                  "spans array<struct<start:int,end:int>>")


def op3(docs: DataFrame) -> DataFrame:
    return _resolve(docs, SIZE, GRAM, False).select("doc_id", "n_words", "n_removed",
                                                    F.col("kept").alias("kept_sha256"), "spans")
