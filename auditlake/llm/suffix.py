"""Repeated passages by a sparse suffix array.

Suffixes are retained at minimiser positions only: every window of ``size`` words keeps the
suffix at its k-gram of smallest hash. The suffixes are put in one total order (k-gram hash, hash
of the context, document, position) by range partitioning and sorting, so a passage with any
number of copies is cut over as many tasks as it needs. Neighbours are compared in one streaming
pass: an equal neighbour extends left and right over the whole context; neighbours that agree
on the k-gram only are compared window by window. Classes cut by a partition border are
joined from two edge records per partition. Matches extend to maximal spans.

A passage counts as repeated where an earlier document (order of ``substring``) has the same
``size`` words in sequence; repeats inside one document only do not count. Defined results for
nulls, empty texts, repeated rows and other columns are those of ``substring``; documents
without a repeated passage have no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import pieces, text_bytes, written
from auditlake.llm.seeds import Anchors, Words, covered
from auditlake.llm.substring import (PLACE, _same_doc, id_type, prepared, repeated_windows, seed_rows, spans_of,
                                     window_rows)

SIZE = 50
GRAM = 8


def neighbour_marks(seeds: DataFrame) -> DataFrame:
    """Sorted suffixes to marks (kind, doc_id, crc, pos, f_*, edge, gram, context, need, single).

    whole: equal neighbour before it, f_* = first suffix of its class; part: first suffix of a
    class whose neighbour class has the same gram. first/last: the classes at the borders of
    partition ``edge``; ``whole`` marks of a border class carry ``edge`` as well."""
    import pyarrow as pa

    kind_id = id_type(seeds)
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind_id, pa.int64())
    names = ["kind", "doc_id", "crc", "pos", "f_doc_id", "f_crc", "f_pos", "edge", "gram", "context", "need", "single"]
    types = [pa.string(), arrow_id, pa.int64(), pa.int32(), arrow_id, pa.int64(), pa.int32(), pa.int32(), pa.int64(),
             pa.int64(), pa.bool_(), pa.bool_()]

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        key, first, need, at_border = None, None, False, True

        def close(followed):
            """The record of the class that ends here."""
            if at_border:
                return [("first", *first, None, None, None, part, *key, need or followed, False)]
            return [("part", *first, None, None, None, None, None, None, None, None)] if need or followed else []

        for batch in batches:
            out = []
            for g, c, *place in zip(*[batch.column(x).to_pylist() for x in ("gram", "context", *PLACE)]):
                if key == (g, c):
                    if place[:2] == first[:2]:  # the same document delivered again
                        continue
                    out.append(("whole", *place, *first, part if at_border else None, None, None, None, None))
                    continue
                if key is not None:
                    out += close(key[0] == g)
                    at_border = False
                need = key is not None and key[0] == g
                key, first = (g, c), place
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)
        if key is not None:
            last = [("first" if at_border else "last", *first, None, None, None, part, *key, need, at_border)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*last), types)], names=names)

    order = ["gram", "context", *PLACE]
    placed = seeds.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.mapInArrow(run, f"kind string, doc_id {kind_id}, crc long, pos int, f_doc_id {kind_id}, f_crc long, "
                                  "f_pos int, edge int, gram long, context long, need boolean, single boolean")


def join_borders(edges: list) -> tuple[list, list, list]:
    """Edge records in partition order to (whole marks, part marks, first place per border class).
    At most two records per partition, so this is a walk over the partitions, not over the data."""
    whole, part, corrected = [], [], []
    cur = None  # open class: key, first place, need

    def place(r):
        return (r["doc_id"], r["crc"], r["pos"])

    def close():
        if cur and cur[2]:
            part.append(cur[1])

    for r in sorted(edges, key=lambda r: (r["edge"], r["kind"] == "last")):
        key = (r["gram"], r["context"])
        if r["kind"] == "last":
            cur = (key, place(r), r["need"])
            continue
        if cur and cur[0] == key:
            if place(r)[:2] != cur[1][:2]:
                whole.append((*place(r), *cur[1]))
            corrected.append((r["edge"], *cur[1]))
            cur = (key, cur[1], cur[2] or r["need"])
        else:
            alike = cur is not None and cur[0][0] == key[0]
            if cur and alike:
                cur = (cur[0], cur[1], True)
            close()
            cur = (key, place(r), r["need"] or alike)
        if not r["single"]:
            close()
            cur = None
    close()
    return whole, part, corrected


def repeats(docs: DataFrame, size: int = SIZE, k: int = GRAM) -> DataFrame:
    """One row per maximal repeated span: doc_id, start_word, n_words and where the words at its
    start occur in an earlier document (src_doc_id, src_start)."""
    import pyarrow as pa

    d = prepared(docs)
    spark = d.sparkSession
    kind = id_type(d)
    marks = written(neighbour_marks(seed_rows(d, size, k)), "marks")
    edges = marks.where("kind in ('first', 'last')").collect()  # two rows per partition
    e_whole, e_part, corrected = join_borders(edges)
    place = f"doc_id {kind}, crc long, pos int"
    src = f"f_doc_id {kind}, f_crc long, f_pos int"
    fix = spark.createDataFrame(corrected, "edge int, " + src.replace("f_", "g_"))
    whole = marks.where("kind = 'whole'").select(*PLACE, "f_doc_id", "f_crc", "f_pos", "edge")
    inner = whole.where("edge is null").drop("edge")
    border = whole.where("edge is not null").join(F.broadcast(fix), "edge", "left").select(
        *PLACE, *[F.when(F.col("g_pos").isNotNull(), F.col(f"g_{c}")).otherwise(F.col(f"f_{c}")).alias(f"f_{c}")
                  for c in PLACE])
    whole = inner.unionByName(border).unionByName(spark.createDataFrame(e_whole, place + ", " + src)) \
        .where("not (doc_id <=> f_doc_id and crc = f_crc)")  # a border class may begin in the document itself
    part = marks.where("kind = 'part'").select(*PLACE).unionByName(spark.createDataFrame(e_part, place))
    wins = repeated_windows(written(window_rows(d, part, size, k), "windows")).select(
        *PLACE, F.col("first.doc_id").alias("f_doc_id"), F.col("first.crc").alias("f_crc"),
        F.col("first.pos").alias("f_pos")).where("not (doc_id <=> f_doc_id and crc = f_crc)")
    found = whole.withColumn("win", F.lit(False)).unionByName(wins.withColumn("win", F.lit(True)))
    listed = found.groupBy("doc_id", "crc").agg(F.array_sort(F.collect_set(F.struct(  # once per place, however often delivered
        "pos", "win", F.col("f_pos").alias("src_pos"), F.col("f_doc_id").alias("src_doc")))).alias("marks"))
    joined = _same_doc(d, listed, "inner").select("doc_id", "crc", "text", "marks")

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                w = Words(text_bytes(piece))
                a = Anchors(w, size, k)
                lead = a.first_in_doc()
                rows = []
                for i, own in enumerate(piece.column("marks").to_pylist()):
                    rows += [(i, *x) for x in _spans(w, a, lead, i, own, size)]
                take = pa.array([r[0] for r in rows], pa.int64())
                ids = piece.column("doc_id")
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], ids.type),
                     pa.array([r[4] for r in rows], pa.int64())],
                    names=["doc_id", "start_word", "n_words", "src_doc_id", "src_start"])
    return joined.mapInArrow(run, f"doc_id {kind}, start_word long, n_words long, src_doc_id {kind}, src_start long")


def _spans(w: Words, a: Anchors, lead: np.ndarray, d: int, marks: list, size: int) -> list[tuple]:
    """(start, length, source document, source start) of the maximal spans of document d."""
    lo, hi = np.searchsorted(a.doc, [d, d + 1])
    base = int(w.first[d])
    whole = {m["pos"]: m for m in marks if not m["win"]}
    wins = {m["pos"]: (m["src_doc"], m["src_pos"]) for m in marks if m["win"]}
    at: dict[int, tuple] = dict(wins)
    for i in range(lo, hi):  # an anchor class is marked at its first place in the document, and so are its windows
        m = whole.get(int(a.at[lead[i]]) - base)
        own = range(int(a.low[i]) - base, int(a.high[i]) - base + 1)
        if m is not None:
            shift = m["src_pos"] - (int(a.at[i]) - base)
            for s in own:
                at[s] = (m["src_doc"], s + shift)
        elif lead[i] != i and wins:
            shift = int(a.at[lead[i]]) - int(a.at[i])
            for s in own:
                if s + shift in wins:
                    at[s] = wins[s + shift]
    starts = np.array(sorted(at), dtype=np.int64)
    if not len(starts):
        return []
    gone = covered(int(w.first[d + 1]) - base, starts, size)
    return [(x, y - x, *at[x]) for x, y in spans_of(gone)]


def op5(docs: DataFrame) -> DataFrame:
    return repeats(docs)
