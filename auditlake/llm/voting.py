"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

1. Terms are runs of 1 to 3 signs of a text's shape: letters, capitals and digits count as one sign each however many stand
   together, as do blanks; marks and line ends stand for themselves; a blank before a word that repeats the word before
   has a sign of its own, and so have a text's two ends. Terms are hashed into TERMS columns. One pass over all documents counts in
   how many each term occurs.
2. The latent-semantic space is spanned by the AXES main directions of the weighted term vectors (square root of the share in the
   text, times inverse document frequency) of the labelled documents, at most SAMPLE of them (those of smallest id hash): the only
   part of the data that is sampled. Their unit vectors and labels are broadcast; their size is bounded by SAMPLE.
3. Every document's cosine with every labelled vector is computed exactly, in blocks. The NEAREST labelled vectors (all of those
   that tie for the last place) vote, weighted by a power of their similarity; the score is the share of label 1.

The score depends on the text alone. Labels are learned only from rows outside the held-out fold (crc32 of the id as text, modulo FOLDS, is 0).
Defined results: null and empty texts have the terms of their ends only and are scored like any other; labels that are null count for nothing, several labels
of one id vote with their mean; a labelled id with several texts is learned by its smallest text; without any label the score
is 0.5; an empty table gives an empty result; other columns are never read; texts of any length are read whole, in slices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import id_and_text, pieces, text_bytes

TERMS = 2048            # a power of two
AXES = 64
SAMPLE = 8192           # labelled documents at most
NEAREST = 15
POWER = 8
THRESHOLD = 0.3
FOLDS = 5
BLOCK = 256             # documents compared at a time
PART = 1 << 18          # bytes of text looked at together

BEGIN, END, AGAIN = 1, 2, 3   # signs of a text's ends and of a blank between two equal words
_MIX = np.uint64(0x9E3779B97F4A7C15)
_DROP = np.uint64(64 - (TERMS.bit_length() - 1))


def _sign_table() -> np.ndarray:
    signs = np.arange(256, dtype=np.uint8)
    signs[ord("a"):ord("z") + 1] = ord("a")
    signs[ord("A"):ord("Z") + 1] = ord("A")
    signs[ord("0"):ord("9") + 1] = ord("0")
    signs[128:] = ord("a")
    signs[[9, 11, 12, 13]] = ord(" ")
    return signs


SIGNS = _sign_table()
MERGED = np.isin(np.arange(256), [ord(c) for c in "aA0 "])   # signs that count once however often they follow


def _powers(base: int) -> np.ndarray:
    out = np.full(PART, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x100000001B3
_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))


def _parts(texts: list[bytes]):
    """Texts as groups of whole ones, a longer text in pieces of its own, as lists of (row, begins, ends, bytes):
    PART bytes at most together. Pieces begin before a blank, if there is one."""
    group, size = [], 0
    for row, text in enumerate(texts):
        if group and size + len(text) + 2 > PART:
            yield group
            group, size = [], 0
        at = 0
        while len(text) - at > PART - 2:
            end = max(text.rfind(b" ", at + 1, at + PART - 2), text.rfind(b"\n", at + 1, at + PART - 2))
            end = end if end > 0 else at + PART - 2
            yield [(row, at == 0, False, text[at:end])]
            at = end
        group.append((row, at == 0, True, text[at:]))
        size += len(text) - at + 2
    if group:
        yield group


def term_counts(texts: list[bytes]) -> np.ndarray:
    """How often each term occurs: a row per text."""
    counts = np.zeros(len(texts) * TERMS, dtype=np.int64)
    tail, last_word = np.zeros(0, dtype=np.uint8), None   # of the piece before, if it is of the same text
    for group in _parts(texts):
        if group[0][1]:
            tail, last_word = tail[:0], None
        b = np.frombuffer(b"".join(bytes([BEGIN]) * begins + part + bytes([END]) * ends for _, begins, ends, part in group), np.uint8)
        lengths = np.array([begins + len(part) + ends for _, begins, ends, part in group])
        stop = np.cumsum(lengths)
        row = np.repeat(np.array([g[0] for g in group]), lengths)
        signs = SIGNS[b]
        word = (signs != 32) & (signs != 10)
        word[(stop - lengths)[[g[1] for g in group]]] = False
        word[stop[[g[2] for g in group]] - 1] = False
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            sums = np.zeros(len(b) + 1, dtype=np.uint64)
            np.cumsum((b + np.uint64(1)) * _UP[:len(b)], out=sums[1:])
            codes = (sums[ends] - sums[starts]) * _DOWN[starts]
            same = np.zeros(len(codes), dtype=bool)
            same[1:] = codes[1:] == codes[:-1]
            same[0] = last_word is not None and codes[0] == last_word
            blank = starts[same & (starts > 0)] - 1
            signs[blank[row[blank] == row[blank + 1]]] = AGAIN   # words of another text are no repeats
            last_word = codes[-1]
            if len(group) > 1:
                signs[stop[:-1] - 1], signs[stop[:-1]] = END, BEGIN
            if group[0][1]:
                signs[0] = BEGIN
        keep = ~MERGED[signs]
        keep[1:] |= signs[1:] != signs[:-1]
        keep[0] |= not len(tail) or tail[-1] != signs[0]
        s = np.concatenate([tail, signs[keep]]).astype(np.uint64)
        row = np.concatenate([np.full(len(tail), group[0][0]), row[keep]])
        h = s + np.uint64(1)
        for n in (1, 2, 3):
            if n > 1:
                h = h[:-1] * np.uint64(257) + s[n - 1:]
            old = max(0, len(tail) - n + 1)   # these ended in the piece before
            whole = row[old:len(row) - n + 1] == row[old + n - 1:]
            at = ((h[old:] + np.uint64(n << 40)) * _MIX >> _DROP).astype(np.int64) + row[old + n - 1:] * TERMS
            counts += np.bincount(at[whole], minlength=len(counts))
        tail = s[-2:][row[-2:] == row[-1]].astype(np.uint8)
    return counts.reshape(len(texts), TERMS)


def _blocks(texts: list):
    for a in range(0, len(texts), BLOCK):
        yield term_counts([t or b"" for t in texts[a:a + BLOCK]])


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents, and documents per term, over all rows."""
    import pyarrow as pa

    def run(batches):
        n, total = 0, np.zeros(TERMS, dtype=np.int64)
        for piece in (p for batch in batches for p in pieces(batch)):
            for counts in _blocks(text_bytes(piece)):
                total += (counts > 0).sum(axis=0)
                n += len(counts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()]), pa.array([n, *total[at].tolist()])], names=["term", "n"])

    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in got}  # a row per term
    out = np.zeros(TERMS)
    for term, n in counts.items():
        if term >= 0:
            out[term] = n
    return counts.get(-1, 0), out


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, sample: int = SAMPLE) -> DataFrame:
    """(label, text) of at most ``sample`` labelled ids outside the held-out fold."""
    known = labels.select("doc_id", F.col(label_col).cast("double").alias("label")) \
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out()) \
        .groupBy("doc_id").agg(F.avg("label").alias("label"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi") \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.join(F.broadcast(known), "doc_id").groupBy("doc_id") \
        .agg(F.first("label").alias("label"), F.min("text").alias("text")).select("label", "text")


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray      # (TERMS, axes)
    vectors: np.ndarray   # (labelled, axes), of unit length
    labels: np.ndarray

    def place(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors of rows of term counts in the latent space (zero if nothing of a text lies in it)."""
        return unit(weighted(counts, self.idf) @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        likeness = np.rint(self.place(counts) @ self.vectors.T * 2.0**30) / 2.0**30  # the same in blocks of any size
        k = min(NEAREST, len(self.labels))
        last = np.partition(likeness, likeness.shape[1] - k, axis=1)[:, likeness.shape[1] - k, None]
        row, near = np.nonzero(likeness >= last)
        weight = np.maximum(likeness[row, near], 0) ** POWER
        total, ones = (np.bincount(row, w, minlength=len(counts)) for w in (weight, weight * self.labels[near]))
        return np.clip(np.where(total > 0, ones / np.where(total > 0, total, 1), self.labels.mean()), 0, 1)


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.sqrt(counts / counts.sum(axis=1, keepdims=True)) * idf)


def main_axes(rows: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` leading right singular vectors of the rows, by the eigenvectors of their term products (TERMS
    by TERMS at most, and only of terms that occur)."""
    occurs = np.flatnonzero(rows.any(axis=0))
    found = rows[:, occurs]
    values, inner = np.linalg.eigh(found.T @ found)
    axes = np.zeros((rows.shape[1], min(k, len(occurs), len(rows))))
    axes[occurs] = inner[:, ::-1][:, :axes.shape[1]]
    return axes


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> Model:
    import pyarrow as pa

    n, frequency = document_frequencies(docs)
    idf = np.log((n + 1) / (frequency + 1)) + 0.1

    def run(batches):
        for piece in (p for batch in batches for p in pieces(batch)):
            counts = [row for block in _blocks(text_bytes(piece)) for row in block]
            terms = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [piece.column("label"), pa.array([t.tolist() for t in terms], pa.list_(pa.int32())),
                 pa.array([c[t].tolist() for c, t in zip(counts, terms)], pa.list_(pa.int64()))], names=["label", "terms", "counts"])

    rows = labelled_sample(docs, labels, label_col, sample) \
        .mapInArrow(run, "label double, terms array<int>, counts array<long>").toArrow()   # at most ``sample`` rows
    rows = sorted(zip(*[rows.column(c).to_pylist() for c in ("label", "terms", "counts")]))
    dense = np.zeros((len(rows), TERMS))
    for i, (_, terms, counts) in enumerate(rows):
        dense[i, terms] = counts
    label = np.array([r[0] for r in rows])
    if not len(rows):
        return Model(idf, np.zeros((TERMS, 0)), np.zeros((0, 0)), label)
    dense = weighted(dense, idf)
    axes = main_axes(dense, AXES)
    return Model(idf, axes, unit(dense @ axes), label)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE,
             threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    import pyarrow as pa

    docs = id_and_text(docs)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label_col, sample))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for piece in (p for batch in batches for p in pieces(batch)):
            scores = [x for counts in _blocks(text_bytes(piece)) for x in model.value.score(counts).tolist()]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op12(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels)
