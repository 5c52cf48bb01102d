"""Conversations, vectors, components and the pipeline."""

import json
import math
import random

import numpy as np

from auditlake.llm import chat, neighbours
from auditlake.llm.common import connected_components


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 400)] + [(5, 1000 + i) for i in range(300)] \
        + [(r.randint(2000, 2400), r.randint(2000, 2400)) for _ in range(300)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}


CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after_id string, status string"
RESULTS = "conv_id long, call_id string, turn long, content string, depth int"


def test_tool_calls(spark):
    ok = '{"limit": 3, "query": "é"}'
    calls = [(1, "a", 1, "search", ok, None, "x"), (1, "b", 3, "fetch", '{"url":"u","depth":9}', "a", "x"),
             (1, "b", 5, "fetch", '{"url":"later"}', None, "x"), (1, "c", 7, "nope", "{}", "b", "x"),
             (1, "d", 9, "search", "not json", "missing", "x"), (2, "a", 1, "search", '{"query":""}', "b", "x"),
             (2, "b", 2, "search", '{"query":1,"limit":true,"zz":1}', "a", "x"), (2, "c", 3, "fetch", "[1]", "b", "x"),
             (None, "n", 1, "fetch", None, None, "x"), (3, None, 1, None, None, None, None), (2, "a", 1, "search", '{"query":""}', "b", "x")]
    results = [(1, "a", 2, "r", 1), (1, "a", 4, "late", 1), (2, "z", 5, None, 1), (None, None, None, None, None)]
    rows = chat.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)).collect()
    by = {(r.conv_id, r.call_id): r for r in rows if r.status != "no_id"}
    assert sum(r.status == "no_id" for r in rows) == 3 and len(rows) == 11
    assert (by[1, "a"].status, by[1, "a"].depth, by[1, "a"].valid) == ("linked", 0, True)
    assert by[1, "a"].record == '{"after":null,"arguments":{"limit":3,"query":"é"},"id":"a","name":"search","result":"r"}'
    assert (by[1, "b"].status, by[1, "b"].depth, by[1, "b"].errors) == ("unanswered", 1, ["depth: too large"])
    assert by[1, "c"].depth == 2 and by[1, "c"].errors == ["name: unknown tool"]
    assert by[1, "d"].depth == 0 and by[1, "d"].errors == ["arguments: not JSON"]
    assert {by[2, x].status for x in "abc"} == {"cyclic"} and by[2, "a"].depth is None
    assert by[2, "a"].errors == ["limit: missing", "query: too small"]
    assert by[2, "b"].errors == ["limit: not integer", "query: not string", "zz: unknown"]
    assert by[2, "z"].status == "orphan" and by[2, "z"].valid is None


def test_long_chain_and_query(spark):
    calls = [(1, str(i), i, "fetch", '{"url":"u"}', str(i - 1) if i else None, None) for i in range(700)]
    rows = chat.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS)).collect()
    assert {r.call_id: r.depth for r in rows} == {str(i): i for i in range(700)}
    conv = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a. b"), (1, 2, "user", None), (1, 3, "assistant", None),
                                  (None, 1, "assistant", "x"), (2, None, "user", "x"), (3, 1, None, "x"), (1, 1, "assistant", "a. b")],
                                 "conv_id long, turn long, role string, text string")
    got = chat.op6(conv).collect()
    assert len(got) == 6 and sum(r.status == "no_id" for r in got) == 2 and sum(r.status == "message" for r in got) == 2
    assert all(json.dumps(json.loads(r.record), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.record for r in got)
    assert chat.op6(conv.where("false")).collect() == []


def test_calls_carry_whole_turns(spark):
    text = 'First. Second "quoted"\n. Third é \U0001f600. ' + "x. " * 500
    conv = [(c, t, ("user", "assistant")[t % 2], f"{c}-{t} {text}") for c in range(4) for t in range(6)] + [(5, 0, "system", text)]
    rows = chat.op6(spark.createDataFrame(conv, "conv_id long, turn long, role string, text string")).collect()
    field = {"search": "query", "fetch": "text", "count_words": "text"}
    records = {(r.conv_id, r.turn): json.loads(r.record) for r in rows if r.depth is not None}
    got = {k: r["arguments"][field[r["name"]]] for k, r in records.items()}
    assert got == {(c, t): x for c, t, role, x in conv if role == "assistant"}
    assert {r["name"] for r in records.values()} == set(field) and not any("unknown" in e for r in rows for e in r.errors)


VEC = "vec_id long, embedding array<float>, label int, part int, v int"


def brute_nearest(rows, k=10):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
          and any(v)]
    out = {}
    for q, a in ok:
        if q % 100 == 0 and q not in out:
            near = sorted((float(np.sqrt(sum((float(y) - float(x)) ** 2 for x, y in zip(a, b)))), i)
                          for i, b in ok if i != q and len(b) == len(a))[:k]
            out[q] = [(i, d) for d, i in near]
    return out


def test_neighbours_small_and_awkward(spark):
    r = random.Random(8)
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32([r.gauss(0, 1) for _ in range(8)])) for i in range(1, 240)]
    same = f32([1, 2, 3, 4, 5, 6, 7, 8])
    rows += [(0, same), (300, same), (301, same), (301, same), (302, None), (303, []), (304, [0.0] * 8), (305, [float("nan")] * 8),
             (306, [float("inf")] + same[1:]), (307, [None] + same[1:]), (None, same), (400, [1.0, 2.0]), (401, [1.0, 3.0])]
    got = {}
    for x in neighbours.op10(spark.createDataFrame([(*t, None, 1, 2) for t in rows], VEC)).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = brute_nearest(rows)
    assert set(got) == set(want)
    for q, near in want.items():
        assert [(n + 1, i) for n, (i, _) in enumerate(near)] == [g[:2] for g in sorted(got[q])]
        assert np.allclose([d for _, d in near], [g[2] for g in sorted(got[q])], rtol=1e-12)
    assert neighbours.op10(spark.createDataFrame([], VEC)).collect() == []


def test_neighbours_recall_with_partitions(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PARTITION_ROWS", 300)
    g = np.random.default_rng(3)
    centre = g.normal(size=(30, 16)) * 3
    x = (centre[g.integers(0, 30, 6000)] + g.normal(size=(6000, 16))).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*t, 0, 0, 0) for t in rows], VEC).repartition(4)
    got = {}
    for r in neighbours.op10(df).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_nearest(rows)
    recall = np.mean([len(set(got[q]) & {i for i, _ in near}) / len(near) for q, near in want.items()])
    router = neighbours.fit(neighbours.usable(df), 6000)
    assert router.partitions == 16 and router.probes < 10 and recall >= 0.9


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline
    from auditlake.llm import mixing, quality, simhash
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    kept = quality.quality_report(docs).where("kept")
    named = simhash.near_duplicates(docs.join(kept.select("doc_id"), "doc_id")).collect()
    want = {r.doc_id for r in named if r.doc_id == r.component_id}
    got = [r.doc_id for r in out.collect()]
    assert set(got) == want and len(got) >= len(want) and len(corpus_pipeline.STAGES) == 5
    assert mixing.MAX_EPOCHS >= max(got.count(d) for d in want) - 1e-9


def test_pipeline_rows_match_brute_force(spark):
    """Every row of run(): ids, token counts, both digests and the number of copies."""
    import re
    from collections import Counter

    import corpus_pipeline
    from auditlake.llm import pii, quality
    from auditlake.llm.queries import tokenizer_path
    from tests.llm import brute as B
    from tests.llm.test_documents import brute_mix
    from tokenizers import Tokenizer

    stop = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(set(quality.STOP_WORDS))) + r")(?![^\W_])", re.I)

    def passes(t):
        n, chars, symbols, dup, _, failed = B.quality(t)
        if failed:
            return False
        lines = sum(bool(B.words(x)) for x in t.split("\n"))
        upper = len(re.findall("[A-ZÀ-ÖØ-Þ]", t))
        return 2 <= chars / n <= 14 and symbols / n <= 0.2 and len(stop.findall(t)) / n >= 0.02 \
            and dup / lines <= 0.5 and upper / chars <= 0.6

    def mod97(m):
        return int("".join(str(int(c, 36)) for c in (m[4:] + m[:4]))) % 97 == 1

    def redacted(t):
        for kind in ("email", "ip", "card", "phone"):
            for _, a, b in reversed([x for x in B.pii(t) if x[0] == kind]):
                t = f"{t[:a]}<{kind.upper()}>{t[b:]}"
        iban = next(k for k in pii.KINDS if k.name == "iban")
        return re.sub(iban.pattern, lambda m: "<IBAN>" if mod97(m.group().replace(" ", "")) else m.group(), t)

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [r for r in rows if r[1] is not None and passes(r[1])]
    comp = B.components([r[0] for r in rows], [B.simhash(r[1]) for r in rows])
    rows = [(d, redacted(t), s) for (d, t, s), c in zip(rows, comp) if d == c]
    copies = Counter(d for d, _, _ in brute_mix([(d, s, t) for d, t, s in rows]).elements())
    t = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for d, text, _ in rows:
        ids = t.encode(text, add_special_tokens=False).ids
        want[d, len(ids), B.sha(",".join(map(str, ids))), B.sha(t.decode(ids, skip_special_tokens=False))] += copies[d]
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == want and want
