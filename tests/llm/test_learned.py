"""Whitening, neighbour voting and importance resampling against plain computations."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from auditlake.llm import resampling, voting, whitening
from tests.llm.conftest import nasty_rows, prose

VECTORS = "vec_id long, embedding array<double>, n long, v string, deviation string, dim int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in rows], VECTORS)


# ---------------------------------------------------------------- op11
def plain_whitening(rows, k=32):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    d = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    cov = d.T @ d / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    keep = [i for i in range(min(k, len(values))) if values[i] > 1e-10 * values[0]]
    dev = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    return n, dev, values[keep], values.sum() or np.trace(cov), d @ axes[:, keep] / np.sqrt(values[keep])


def check_whitening(got, rows):
    n, dev, values, trace, w = plain_whitening(rows)
    assert len(got) == len(rows) * len(values)
    table = {}
    for r in got:
        table.setdefault(r.vec_id, {})[r.component] = r
    for j in range(len(values)):
        mine = np.array([table[i][j + 1].whitened for i, _ in rows])
        sign = np.sign(mine @ w[:, j])
        assert np.abs(sign * mine - w[:, j]).max() < 1e-6
        assert all(abs(table[i][j + 1].explained - values[j] / trace) < 1e-6 for i, _ in rows)
    assert all(r.n == n and r.identity_error < 1e-4 for r in got)
    assert [table[i][1].deviation for i, _ in rows] == dev


def test_whitening_matches_a_plain_eigensolver(spark):
    r = np.random.default_rng(3)
    mixed = r.standard_normal((400, 40)) @ np.diag(np.linspace(3, 0.2, 40)) @ np.linalg.qr(r.standard_normal((40, 40)))[0]
    rows = [(i, v.tolist()) for i, v in enumerate(mixed)]
    for parts in (1, 7):
        check_whitening(whitening.op11(vectors(spark, rows).repartition(parts)).collect(), rows)
    # fewer dimensions than components, one of them a copy of another: that direction has no variance
    flat = [(i, [v[0], v[1], v[0]]) for i, v in rows]
    got = whitening.op11(vectors(spark, flat)).collect()
    assert {x.component for x in got} == {1, 2}
    check_whitening(got, flat)


def test_whitening_of_awkward_rows(spark):
    good = [(i, [float(i % 5), -float(i % 3), 0.5]) for i in range(30)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, []),
           (105, [1.0]), (106, [2.0**46, 0.0, 0.0])]
    got = whitening.op11(vectors(spark, good + bad)).collect()
    check_whitening(got, good)
    twice = whitening.op11(vectors(spark, good + good)).collect()
    assert len(twice) == 2 * len(got) and {x.n for x in twice} == {60}
    assert whitening.op11(vectors(spark, bad[:4])).count() == 0
    assert whitening.op11(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.op11(vectors(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    nobody = whitening.op11(vectors(spark, good + [(None, [9.0, 9.0, 9.0])])).collect()
    assert sum(x.vec_id is None for x in nobody) == 3
    # beyond the range of long a deviation is null, next to it exact
    far = [(i, [2.0**17 * i, 0.0]) for i in range(40)]
    got = {x.vec_id: x.deviation for x in whitening.op11(vectors(spark, far)).where("component = 1").collect()}
    x = [64 * 2**17 * i for i in range(40)]
    want = [(40 * a - sum(x)) ** 2 for a in x]
    assert got == {i: w if w < 2**63 else None for i, w in enumerate(want)}
    assert None in got.values() and any(v is not None for v in got.values())


@pytest.mark.parametrize("spectrum", [np.ones(30), np.repeat([5.0, 2.0, 1.0], 10), np.geomspace(1, 1e-9, 30), np.arange(30.0)[::-1],
                                      np.concatenate([np.full(20, 1.0), np.full(10, 1.0 + 1e-9)])])
def test_feast_finds_every_component(spectrum):
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((30, 30)))[0]
    v = (q * spectrum) @ q.T
    v = (v + v.T) / 2
    for k in (1, 12, 30):
        values, axes = whitening.feast(v, k)
        assert np.allclose(values, np.sort(spectrum)[::-1][:k], atol=1e-10 * spectrum.max())
        assert np.allclose(axes.T @ axes, np.eye(k), atol=1e-10) and np.allclose(v @ axes, axes * values, atol=1e-9 * spectrum.max())


def test_inertia_counts_eigenvalues():
    a = np.random.default_rng(2).standard_normal((20, 20))
    a = a + a.T
    diag, off = whitening.tridiagonal(a)
    values = np.linalg.eigvalsh(a)
    assert np.allclose(np.linalg.eigvalsh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1)), values)
    for shift in [*(values[:-1] + np.diff(values) / 2), -1e9, 1e9]:
        assert whitening.inertia(diag, off, shift) == (values > shift).sum()
    assert whitening.inertia(np.zeros(3), np.zeros(2), 0.0) == 0


# ---------------------------------------------------------------- op12
def plain_terms(text):
    """Runs of 1 to 3 signs, spelled out."""
    signs, words, at = [(1, True)], [], 0
    data = (text or "").encode()
    while at < len(data):
        end = at
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        if end > at:
            if words and words[-1] == data[at:end] and at:
                signs[-1] = (3, True)
            words.append(data[at:end])
            signs += [(b, False) for b in data[at:end]]
        if end < len(data):
            signs.append((data[end], False))
        at = end + 1
    out = []
    for b, special in [*signs, (2, True)]:
        s = b if special else int(voting.SIGNS[b])
        if special or not (out and out[-1] == s and chr(s) in "aA0 "):
            out.append(s)
    return out


def test_terms_are_runs_of_signs():
    texts = ["", " ", "One two two, 22 33 É\n\nend", "a", "  x  x  ", "HEY!! HEY!! you", "word " * 50, prose(3, 200) + " z z", "tab\tsep sep"]

    def code(run):
        h = 0
        for j, s in enumerate(run):
            h = h * 257 + s + (1 if j == 0 else 0)
        return ((h + (len(run) << 40)) * 0x9E3779B97F4A7C15 % 2**64) >> int(voting._DROP)
    for t, got in zip(texts, voting.term_counts([t.encode() for t in texts])):
        signs = plain_terms(t)
        want = Counter(code(signs[i:i + n]) for n in (1, 2, 3) for i in range(len(signs) - n + 1))
        assert dict(want) == {i: int(c) for i, c in enumerate(got) if c}, t


def test_votes_match_exhaustive_cosines():
    r = np.random.default_rng(4)
    counts = r.poisson(1.0, (60, voting.TERMS)) + 1
    idf, axes = r.random(voting.TERMS) + 0.1, np.linalg.qr(r.standard_normal((voting.TERMS, 8)))[0]
    labelled = np.vstack([counts[:40], counts[:5]])   # copies tie
    label = r.integers(0, 2, 45).astype(float)
    model = voting.Model(idf, axes, np.zeros((0, 0)), np.zeros(0))
    assert (model.score(counts) == 0.5).all()
    model.vectors, model.labels = model.place(labelled), label
    for row, got in zip(counts, model.score(counts)):
        like = [round(float(v) * 2**30) / 2**30 for v in model.vectors @ model.place(row[None])[0]]
        last = sorted(like, reverse=True)[voting.NEAREST - 1]
        votes = [(max(x, 0) ** voting.POWER, y) for x, y in zip(like, label) if x >= last]
        assert abs(got - sum(w * y for w, y in votes) / sum(w for w, _ in votes)) < 1e-6


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in voting.op12(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(held) > 500 and np.mean([a == b for a, b in held]) > 0.98
    assert np.mean([p == 0 for q, p in held if q == 0]) > 0.9


def test_scores_depend_on_the_text_alone(spark, nasty, nothing):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(20)] + [(3, 0, 1), (None, 1, 1), (7, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = voting.op12(nasty, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in nasty_rows())
    by_text = {}
    for r, text in zip(sorted((r for r in got if r.doc_id in (0, 1, 11, 12, 5, 6)), key=lambda r: r.doc_id), range(10)):
        by_text[r.doc_id] = r.score
    assert by_text[0] == by_text[1] and by_text[5] == by_text[6]
    other = nasty.selectExpr("doc_id", "text", "'zz' lang", "'q' source", "1 score", "2 label").repartition(5)
    assert {(r.doc_id, r.score) for r in voting.op12(other, labels).collect()} == {(r.doc_id, r.score) for r in got}
    # labels of the held-out fold change nothing
    fold = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5 == 0]
    flipped = spark.createDataFrame([(i, (i + 1) % 2 if i in fold else i % 2, 0) for i in range(20)] + [(3, 0, 1), (7, None, 0)],
                                    "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.score) for r in voting.op12(nasty, flipped).collect()} == {(r.doc_id, r.score) for r in got}
    assert {r.score for r in voting.op12(nasty, labels.where("false")).collect()} == {0.5}
    assert voting.op12(nothing, labels).count() == 0


# ---------------------------------------------------------------- op13
def plain_resampling(docs, bench):
    """(doc_id, n_features, weight, score, rank) by the definition."""
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = "".join(c if c >= "\x80" or c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in low).split(" ")
        words = [w for w in words if w]
        return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    def bucket(f):
        return zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in bench for f in features(x)[1])
    gain = {b: math.floor(1000 * math.log(float(t[b] + 1) * (s.total() + 10000) / (float(s[b] + 1) * (t.total() + 10000)))) for b in s}
    rows = []
    for d, text in docs:
        n, f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        rows.append([d, n, len(f), weight, weight + resampling.noise(d, 7)])
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = fit[:25 * len(fit) // 100]
    rank = {id(r): k + 1 for k, r in enumerate(drawn)}
    return Counter((r[0], r[2], r[3], r[4], rank.get(id(r))) for r in rows)


def test_noise_by_hand():
    import hashlib
    h = int(hashlib.sha256(b"7:42").hexdigest()[:8], 16)
    assert resampling.noise(42, 7) == math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def test_resampling_matches_the_definition(spark, nasty, nothing, monkeypatch):
    docs = [(r[0], r[1]) for r in nasty_rows()]
    bench = [prose(3, 60), prose(70, 100), None, "", "A B a b"]
    target = spark.createDataFrame([(i, t, 1) for i, t in enumerate(bench)], "item_id long, text string, bucket int")
    cols = ["doc_id", "n_features", "weight", "score", "rank"]

    def bag(df):
        return Counter(tuple(r[c] for c in cols) for r in df.collect())
    assert bag(resampling.op13(nasty, target)) == plain_resampling(docs, bench)
    many = docs + [(i, prose(i, 15 + i % 20)) for i in range(100, 700)] + [(55, prose(5, 30))] * 90
    frame = spark.createDataFrame(many, "doc_id long, text string").repartition(7)
    monkeypatch.setattr(resampling, "CHUNK", 20)
    monkeypatch.setattr(resampling, "REWRITE", 2)
    monkeypatch.setattr(resampling, "SLICE", 100)
    want = plain_resampling(many, bench)
    assert bag(resampling.op13(frame, target)) == want
    assert sum(n for r, n in want.items() if r[4]) == 25 * sum(1 for _, t in many if t and len(
        resampling.WORDS.findall(t.lower().encode())) >= 20) // 100
    assert resampling.op13(nothing, target).count() == 0
    assert bag(resampling.op13(nasty, target.where("false"))) == plain_resampling(docs, [])
    few = spark.createDataFrame(docs[:2], "doc_id long, text string")
    assert all(r["rank"] is None for r in resampling.op13(few, target).collect())


def test_kth_smallest_is_exact(spark, monkeypatch):
    r = np.random.default_rng(9)
    monkeypatch.setattr(resampling, "CHUNK", 7)
    for n, spread in ((1, 5), (50, 3), (400, 1000)):
        rows = [(int(a), int(b)) for a, b in r.integers(-spread, spread, (n, 2))]
        df = spark.createDataFrame(rows, "a long, b long").repartition(5)
        for k in {1, (n + 1) // 2, n}:
            assert resampling.kth_smallest(df, ["a", "b"], k) == sorted(rows)[k - 1]
