"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood.

The samples are labelled by the patterns themselves: the strings they catch in all documents
train the model of random strings, all other tokens under 20 characters the model of
ordinary identifiers. Both are transition counts over the token alphabet, summed by Spark over every
document (a table bounded by the alphabet, 2 * 66 * 66 rows at most). A token of 20 or more
characters outside the pattern spans, with letters and digits, is reported as ``markov`` if its
mean log-likelihood ratio per character reaches MIN_MEAN; one transition counts EVIDENCE at most
either way, so a letter the ordinary tokens happen to lack is no verdict.

Defined results: a null text is an empty one and has no span; documents are judged row by row, so
repeated rows give equal rows; without samples both models are uniform and nothing is added;
other columns are never read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import pieces

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
MIN_MEAN = 0.75
BACKOFF = 20.0  # weight, in samples, of the single-character distribution
EVIDENCE = 3.0  # nats one transition may say: letters that prose lacks don't decide alone
_HINTS = ("passw", "secret", "token", "api")

_CODE = np.zeros(256, dtype=np.int64)  # 0: outside the alphabet, and the state before a token
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i + 1
_N = len(ALPHABET) + 1


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself), sorted."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def transitions(text: str) -> np.ndarray:
    """Counts of (state, next token character) over a text."""
    code = _CODE[np.frombuffer(text.encode("latin-1", errors="replace").replace(b"?", b" "), dtype=np.uint8)]
    pair = np.concatenate([[0], code[:-1]]) * _N + code if len(code) else code
    return np.bincount(pair[code > 0], minlength=_N * _N)


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Mean-ready table of log-likelihood ratios [state, character], from all documents."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros((2, _N * _N), dtype=np.int64)
        for batch in batches:
            for piece in pieces(batch):
                rest, caught = [], []
                for t in piece.column("text").to_pylist():
                    t = t or ""
                    end, kept = 0, []
                    for s, _, e, v in base_spans(t):
                        caught.append(t[v:e])
                        if e > end:
                            kept.append(t[end:max(s, end)])
                            end = e
                    kept.append(t[end:])
                    # tokens long enough to be judged are no samples: none may vouch for itself
                    rest.append(TOKEN.sub(" ", " ".join(kept)))
                total[0] += transitions(" ".join(rest))
                total[1] += transitions(" ".join(caught))
        label, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(pair, pa.int32()),
                                          pa.array(total[label, pair], pa.int64())], names=["label", "pair", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "label int, pair int, n long") \
        .groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, _N, _N))
    for r in counted:
        counts[r["label"], r["pair"] // _N, r["pair"] % _N] += r["n"]
    # a transition backs off to how common the character is under the label, that to uniform
    single = counts.sum(axis=1) + 1.0
    single[:, 0] = 0
    single /= single.sum(axis=1, keepdims=True)
    p = (counts + BACKOFF * single[:, None, :]) / (counts.sum(axis=2, keepdims=True) + BACKOFF)
    p = np.log(np.maximum(p, 1e-300))
    return np.clip(p[1] - p[0], -EVIDENCE, EVIDENCE)


def score(token: str, ratios: np.ndarray) -> float:
    """Mean log-likelihood ratio per character of a token."""
    code = _CODE[np.frombuffer(token.encode("ascii"), dtype=np.uint8)]
    return float(ratios[np.concatenate([[0], code[:-1]]), code].sum() / len(code))


def added_spans(text: str, base: list, ratios: np.ndarray) -> list[tuple[int, int, int, int]]:
    out, nth, reach = [], 0, 0   # base spans that begin before the token's end, and how far they reach
    for m in TOKEN.finditer(text):
        while nth < len(base) and base[nth][0] < m.end():
            reach = max(reach, base[nth][2])
            nth += 1
        if reach > m.start():
            continue
        token = m.group()
        if any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and score(token, ratios) >= MIN_MEAN:
            out.append((m.start(), 3, m.end(), m.start()))
    return out


def scan(docs: DataFrame, ratios: np.ndarray, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id and spans (kind, start, end) sorted by start, then kind."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # 66 * 66 numbers
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                rows = []
                for t in piece.column("text").to_pylist():
                    base = base_spans(t or "")
                    rows.append([{"kind": KINDS[k], "start": s, "end": e}
                                 for s, k, e, _ in sorted(base + added_spans(t or "", base, shared.value))])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(rows, spans_type)],
                                                 names=["doc_id", "spans"])
    return d.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def op7(docs: DataFrame) -> DataFrame:
    found = scan(docs, train(docs))
    base = F.filter("spans", lambda x: x["kind"] != "markov")

    def listed(c):
        return F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"),
                                                                     x["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"), count("markov").alias("n_markov"))
