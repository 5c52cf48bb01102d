"""Cases that once crashed, lost rows, took quadratic time or depended on the partitioning."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import chat, credentials, mixing, neighbours, seeds, simhash, substring, suffix
from auditlake.llm.common import connected_components
from tests.llm import brute as B
from tests.llm.conftest import prose


def test_rows_delivered_hundreds_of_times_mark_each_place_once(spark):
    shared = prose(1, 60)
    rows = [(1, prose(2, 30) + " " + shared)] + [(2, shared + " " + prose(3, 60))] * 300 + [(3, prose(2, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    d = substring.prepared(docs)
    marks, part = substring.classes_to_marks(substring.seed_rows(d, 20, 8))
    wins = substring.repeated_windows(substring.window_rows(d, part, 20, 8))
    held = substring.per_document(d, marks, wins)
    assert held.agg(F.max(F.greatest(F.coalesce(F.size("whole"), F.lit(0)), F.coalesce(F.size("wins"), F.lit(0))))).first()[0] < 120
    got = substring.op3(docs).where("doc_id = 2").select("n_words", "n_removed", "kept_sha256").distinct().collect()
    assert len(got) == 1 and got[0].n_removed == 60
    spans = suffix.op5(docs).collect()
    assert {(r.doc_id, r.start_word, r.n_words, r.src_doc_id) for r in spans} == {(2, 0, 60, 1)} and len(spans) == 300


CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after_id string"


def test_arguments_no_json_writer_can_take(spark):
    calls = [(1, "a", 1, "search", '{"query":"x","limit":1e999}', None), (1, "b", 2, "search", '{"query":"\\ud800","limit":3}', None),
             (1, "c", 3, "fetch", '{"url":"u","z\\udfff":[-1e400]}', None), (1, "d", 4, "fetch", '{"url":"u","\\udc00":1}', None),
             (1, "e", 5, "search", '{"query":NaN}', None)]
    rows = {r.call_id: r for r in chat.link(spark.createDataFrame(calls, CALLS),
                                            spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")).collect()}
    assert rows["a"].errors == rows["c"].errors == ["arguments: number too large"] and rows["e"].errors == ["arguments: not JSON"]
    assert rows["b"].valid and rows["b"].record == \
        '{"after":null,"arguments":{"limit":3,"query":"\\ud800"},"id":"b","name":"search","result":null}'
    assert rows["d"].errors == ["\\udc00: unknown"] and json.loads(rows["d"].record)["arguments"] == {"url": "u", "\udc00": 1}


def test_every_turn_has_a_row(spark):
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in conv.collect()]
    got = chat.op6(conv).collect()
    plain = B.tool_calls(turns)
    assert sorted((r.conv_id, r.call_id or "", r.turn, r.depth, r.status, r.valid, r.record) for r in got) == sorted(plain)
    odd = spark.createDataFrame([(1, 0, None, None), (None, None, "tool", "x"), (2, 0, "user", "é")],
                                "conv_id long, turn long, role string, text string")
    assert {(r.status, r.record) for r in chat.op6(odd).collect()} == {
        ("message", '{"role":null,"text":null,"turn":0}'), ("message", '{"role":"tool","text":"x","turn":null}'),
        ("message", '{"role":"user","text":"é","turn":0}')}


def test_long_text_with_many_secrets_takes_linear_time():
    ratios = np.zeros((credentials._N, credentials._N))

    def seconds(n):
        text = " ".join(f"token=abcdef{i} someratherlongtoken{i:06d}" for i in range(n))
        base = credentials.base_spans(text)
        start = time.process_time()
        credentials.added_spans(text, base, ratios)
        return time.process_time() - start
    seconds(500)
    assert seconds(40_000) < 3
    # the walk finds what a comparison of all pairs finds
    text = "token=abcdefgh12345678901234567890 x" + "1" * 30 + " secret=" + "a1" * 20 + "-" + "f0" * 15 + " zz9" * 12
    base = sorted(credentials.base_spans(text))
    high = np.full_like(ratios, 1.0)
    want = [m.span() for m in credentials.TOKEN.finditer(text)
            if not any(s < m.end() and m.start() < e for s, _, e, _ in base) and any(c.isalpha() for c in m.group())
            and any(c.isdigit() for c in m.group())]
    assert [(s, e) for s, _, e, _ in credentials.added_spans(text, base, high)] == want


def test_survivor_of_a_group_does_not_depend_on_the_partitioning(spark):
    text = prose(1, 50)
    docs = spark.createDataFrame([(7, text, "en", f"src{i}") for i in range(40)] + [(8, text, "en", "x"), (9, prose(2, 30), None, None)],
                                 "doc_id long, text string, lang string, source string")
    got = {tuple(sorted((r.doc_id, r.source or "") for r in simhash.keep_one_per_group(docs.repartition(n)).collect())) for n in (1, 3, 8, 17)}
    assert len(got) == 1 and {d for d, _ in got.pop()} == {7, 9}


def test_neighbours_at_distances_beyond_double_squares(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e200, 0.0]), (2, [0.0, 2.0]), (3, [1e308, 1e308]), (4, [-1e308, 1.0])]
    got = [(r.vec_id, r.score) for r in neighbours.op10(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
           .where("query_id = 0").orderBy("rank").collect()]
    assert [v for v, _ in got] == [2, 1, 4, 3]
    assert got[0][1] == np.sqrt(5) and got[1][1] == pytest.approx(1e200) and got[3][1] == pytest.approx(np.sqrt(2) * 1e308)


def test_components_end_with_stars(spark):
    r = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(64)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    root = {x.node: x.root for x in got}
    assert len(root) == len(got) and all(root[a] == root[b] for a, b in edges if a != b)
    assert all(root[v] == v and v <= k for k, v in root.items())
    assert connected_components(spark.createDataFrame([(5, 5)], "u long, v long")).count() == 0


def test_mixing_plan_is_broadcast(spark):
    docs = spark.createDataFrame([(i, prose(i, 20), "en", f"s{0 if i % 3 else i % 7}") for i in range(90)],
                                 "doc_id long, text string, lang string, source string")
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_anchor_rows_are_those_of_the_windows():
    texts = [prose(1, 80).encode()]
    w = seeds.Words(texts)
    a = seeds.Anchors(w, 20, 8)
    assert (a.low <= a.at).all() and (a.high >= a.low).all()
