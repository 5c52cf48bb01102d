"""Contracts of the document operators against plain definitions, on awkward and empty tables."""

import hashlib
from collections import Counter

import numpy as np

import pytest

from auditlake.llm import bpe, credentials, mixing, pii, quality, simhash, substring, suffix
from auditlake.llm.queries import tokenizer_path
from tests.llm import brute as B
from tests.llm.conftest import nasty_rows, prose

ROWS = [(r[0], r[1]) for r in nasty_rows()]


def bag(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_quality_measures(nasty):
    got = bag(quality.op9(nasty), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
              "base_failed")
    assert got == Counter((d, *B.quality(t)) for d, t in ROWS)


def test_quality_filter_keeps_columns_and_passing_rows(nasty):
    kept = quality.quality_filter(nasty)
    assert kept.columns == nasty.columns
    report = quality.quality_report(nasty)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in report.where("kept").collect())
    assert not any(B.quality(r.text)[5] for r in kept.collect())


def test_pii_spans(nasty):
    for r in pii.op8(nasty).collect():
        texts = [t for d, t in ROWS if d == r.doc_id]
        base = [x for x in r.spans.split(",") if not x.startswith("iban")]
        assert ",".join(base) in {B.listed(B.pii(t)) for t in texts}
        assert r.base_sha256 == B.sha(",".join(base))
    row = pii.op8(nasty.where("doc_id = 19")).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (3, 3, 1, 1)
    assert row.spans.count("iban") == 2 and max(row.scores) == 0.9


IBANS = ["ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "SE45 5000 0000 0583 9825 7466",
         "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606",
         "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "CH93 0076 2011 6238 5295 7"]


def test_pii_account_numbers_before_other_tokens(spark):
    """Numbers end where their country's do, whatever follows; one in groups and one in a run."""
    after = ["", ",", " BIC CAIXESBB", " BIC", " 2024", " EUR 20", " A1", " 7", " AT61 1904 3002 3457 3201", " B"]
    forms = [x for n in IBANS for x in (n, n.replace(" ", ""))]
    rows = [(i, f, f"zum {p}{f}{x}", 1 + (x == after[-2])) for i, (f, x, p) in enumerate(
        (f, x, p) for f in forms for x in after for p in ("", "BE12 ", "XX12 3456 7890 "))]
    df = spark.createDataFrame([(i, t) for i, _, t, _ in rows], "doc_id long, text string")
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("iban")] for r in pii.op8(df).collect()}
    for i, f, t, n in rows:
        at = t.index(f)
        assert f"iban:{at}:{at + len(f)}" in got[i] and len(got[i]) == n, t
    long = [(0, "DE89 " * 60_000), (1, "AB12 3456 " * 30_000), (2, "MT84 MALT 0110 " * 20_000)]
    assert all(r.spans == "" for r in pii.op8(spark.createDataFrame(long, "doc_id long, text string")).collect())


def test_redaction_of_account_numbers_before_other_tokens(spark):
    df = spark.createDataFrame([(i, f"zum {f} BIC CAIXESBB") for i, f in enumerate(IBANS)], "doc_id long, text string")
    for r in pii.redact(df.where("doc_id in (0, 1, 4, 5)")).collect():
        assert r.text == "zum <IBAN> BIC CAIXESBB"


def test_pii_context_decides_for_unknown_countries(spark):
    def number(rest, code="XX"):
        digits = "".join(str(int(c, 36)) for c in rest.replace(" ", "") + code + "00")
        return f"{code}{98 - int(digits) % 97:02d} {rest}"
    x = number("1234 5678 9012 34")
    texts = [f"order {x} shipped", f"Konto {x}.", f"order {x}" + " -" * 30 + " account", f"order {x}. Bank: {IBANS[0]}, 1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.op8(df).collect()}
    assert [("iban_other" in found[i]) for i in range(4)] == [False, True, False, True]
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert [out[i] for i in range(3)] == [texts[0], "Konto <IBAN_OTHER>.", texts[2]]
    assert out[3] == "order <IBAN_OTHER>. Bank: <IBAN>, 1"


def test_pii_long_runs_stay_linear(spark):
    texts = ["a" * 300_000, "1" * 300_000, "1." * 100_000, "+1" + "(" * 200_000, "a@b" + ".c" * 100_000, "1 " * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.op8(df).collect()}
    assert got[4].n_email == 1 and got[2].n_ip == 25_000 and got[0].spans == got[1].spans == got[3].spans == ""


def test_redaction(nasty):
    out = {r.doc_id: r for r in pii.redact(nasty).collect()}
    assert out[19].text.startswith("<CARD>, <PHONE>, <IP>, 300.1.1.1, <EMAIL>, <IP>.<IP> ")
    assert out[19].n_chars == len(out[19].text) and out[5].text is None and out[6].text == ""
    assert pii.redact(nasty).columns == nasty.columns


def test_simhash(nasty):
    ids, texts = zip(*ROWS)
    fps = [B.simhash(t) for t in texts]
    comp = B.components(ids, fps)
    got = bag(simhash.op2(nasty), "doc_id", "fingerprint", "component_id")
    assert got == Counter((d, f"{f:016x}", c) for d, f, c in zip(ids, fps, comp))


def test_simhash_split_shards_lose_no_link(spark):
    import random
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(4)]
    keys = set(base)
    for b in base:  # a dense ball, a chain at distance 2, and noise that shares blocks
        keys |= {b ^ 1 << i for i in range(0, 64, 2)}
        x = b
        for i in range(20):
            x ^= 3 << (3 * i)
            keys.add(x)
    keys |= {base[0] & ~0xFFFF | r.getrandbits(16) for _ in range(200)}
    keys = sorted(keys)
    df = spark.createDataFrame([(simhash._signed(k),) for k in keys], "fp long")
    from auditlake.llm.common import connected_components
    roots = {x.node: x.root for x in connected_components(simhash.links(df, 2, 8)).collect()}
    want = B.components(list(range(len(keys))), keys)
    groups = {}
    for k, c in zip(keys, want):
        groups.setdefault(c, set()).add(roots.get(simhash._signed(k), simhash._signed(k)))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_one_row_per_group(nasty):
    kept = simhash.keep_one_per_group(nasty)
    assert kept.columns == nasty.columns
    got = Counter(r.doc_id for r in kept.collect())
    ids, texts = zip(*ROWS)
    comp = B.components(ids, [B.simhash(t) for t in texts])
    assert set(got) == {d for d, c in zip(ids, comp) if d == c}
    assert got[12] == 1 and got[11] == 1 and got[0] == 1 and got[None] == 1


def test_substring(nasty, spark):
    unique = spark.createDataFrame([x for x in dict(ROWS).items() if x[0] is not None], "doc_id long, text string")
    want = B.kept_words(sorted((d, t) for d, t in dict(ROWS).items() if d is not None))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.op3(unique).collect()}
    assert got == want
    assert substring.op3(nasty).count() == len(ROWS)


def test_substring_phrases_and_borders(spark):
    import random
    r = random.Random(3)
    vocab = [prose(i, 1) + str(i) for i in range(30)]
    phrase = [[r.choice(vocab) for _ in range(r.randint(12, 45))] for _ in range(12)]
    docs = []
    for d in range(150):
        parts = [w for _ in range(r.randint(0, 5)) for w in (r.choice(phrase) if r.random() < .7 else
                                                             [r.choice(vocab) for _ in range(r.randint(1, 30))])]
        docs.append((d, " ".join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring.op3(df).collect()}
    assert got == B.kept_words(docs)
    text = {x.doc_id: x.kept for x in substring.dedup(df).collect()}
    assert all(hashlib.sha256(text[d].encode()).hexdigest() == got[d][2] for d in text)


def spans_over(docs, size):
    first, out = {}, set()
    for d, t in docs:
        w = B.words(t)
        gone = [False] * (len(w) + 1)
        for i in range(len(w) - size + 1):
            if first.setdefault(tuple(w[i:i + size]), d) != d:
                gone[i:i + size] = [True] * size
        i = 0
        while i < len(w):
            if gone[i]:
                j = gone.index(False, i)
                out.add((d, i, j - i))
                i = j
            i += 1
    return out


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_suffix_passages(spark, parts):
    """Few and many range partitions: classes cut by borders must join."""
    docs = [(d, prose(d % 3, 90 + d % 5) + " " + prose(100 + d, 20) + " " + prose(50 + d % 7, 70)) for d in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = suffix.op5(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {(r.doc_id, r.start_word, r.n_words) for r in rows} == spans_over(docs, 50)
    words = {d: B.words(t) for d, t in docs}
    for r in rows:
        assert r.src_doc_id < r.doc_id
        assert words[r.src_doc_id][r.src_start:][:50] == words[r.doc_id][r.start_word:][:50]


def test_suffix_passages_twice_in_one_document(spark):
    """The first holder of an anchor class may hold its block twice: both copies repeat the earlier document."""
    docs = []
    for i in range(40):
        p = prose(1000 + i, 50 + i % 25)
        block = prose(2000 + i, 60) + " " + p + " " + prose(3000 + i, 60)
        docs += [(2 * i, prose(4000 + i, 30) + " " + p + " " + prose(5000 + i, 30)),
                 (2 * i + 1, block + " " + prose(6000 + i, 20) + " " + block + " " + block)]
    rows = suffix.op5(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {(r.doc_id, r.start_word, r.n_words) for r in rows} == spans_over(docs, 50)
    words = {d: B.words(t) for d, t in docs}
    assert all(words[r.src_doc_id][r.src_start:][:50] == words[r.doc_id][r.start_word:][:50] for r in rows)


@pytest.mark.parametrize("parts", [1, 40])
def test_suffix_rows_delivered_twice(spark, parts):
    """Equal rows are one document: no source of themselves, and each gets the document's result."""
    once = [(d, prose(700 + d, 80)) for d in range(6)]
    docs = [*once, *once, (None, prose(800, 90)), (None, prose(800, 90)), (9, prose(900, 20) + " " + once[2][1]),
            (9, prose(900, 20) + " " + once[2][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = bag(suffix.op5(df), "doc_id", "start_word", "n_words", "src_doc_id", "src_start")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {(9, 20, 80, 2, 0): 2}
    edges = [{"kind": "first", "edge": e, "gram": 1, "context": 1, "need": False, "single": True, "doc_id": d, "crc": 5,
              "pos": 0} for e, d in enumerate([7, 7, 8])]
    assert suffix.join_borders(edges)[0] == [(8, 5, 0, 7, 5, 0)]


def test_suffix_awkward(nasty):
    got = {r.doc_id for r in suffix.op5(nasty).collect()}
    assert {1, 2, 4, 12} <= got and not got & {3, 5, 6, 7, 8, 13, 14, 15, 16}


def test_bpe(nasty):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())

    def row(d, text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        return (d, len(ids), B.sha(",".join(map(str, ids))), B.sha(t.decode(ids, skip_special_tokens=False)))
    assert bag(bpe.op4(nasty, tokenizer_path()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") \
        == Counter(row(d, x) for d, x in ROWS)


def test_bpe_unusual_text(monkeypatch):
    import random

    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    with open(tokenizer_path(), encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    r = random.Random(1)
    chars = "ab Z09'st  \t\n\r\x0b\x0c\x1c\x1f\x85\xa0   　​﻿é́ß漢字٣½Ⅷ😀<|endoftext|>.,!-"
    texts = []
    for _ in range(3000):
        s = "".join(r.choice(chars) for _ in range(r.randint(0, 24)))
        texts.append(s if r.random() < .9 else s + "<|endoftext|>" + s)
    wants = [t.encode(s, add_special_tokens=False).ids for s in texts]
    for s, want in zip(texts, wants):
        assert codec.encode(s) == want, repr(s)
        assert codec.decode(want) == t.decode(want, skip_special_tokens=False)
    # all together, and one long text in chunks
    ids, counts = codec.encode_many([s.encode() for s in texts] + [None, b""])
    ends = np.cumsum(counts)
    assert [ids[b - n:b].tolist() for n, b in zip(counts, ends)] == wants + [[], []]
    monkeypatch.setattr(bpe, "GROUP_BYTES", 50)
    long = "".join(texts)
    groups = list(bpe.chunks([long.encode(), b"", None, long.encode()]))
    assert len(groups) > 20
    got = {row: [] for row in range(4)}
    for group in groups:
        ids, counts = codec.encode_many([x for _, x in group])
        for (row, _), n, end in zip(group, counts, np.cumsum(counts)):
            got[row] += ids[end - n:end].tolist()
    want = t.encode(long, add_special_tokens=False).ids
    assert got == {0: want, 1: [], 2: [], 3: want}


def test_secrets(nasty):
    got = bag(credentials.op7(nasty), "doc_id", "base_sha256")
    assert got == Counter((d, B.sha(B.listed(B.secrets(t)))) for d, t in ROWS)
    row = credentials.op7(nasty.where("doc_id = 18")).first()
    assert (row.n_assign, row.n_access, row.n_hex) == (1, 1, 1)


def test_markov_model_separates_held_out_samples(spark):
    import random
    r = random.Random(2)
    abc = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rand = lambda: "".join(r.choice(abc) for _ in range(32))
    docs = [(i, prose(i, 200) + f" item{i} in {1900 + i} token={rand()} " + prose(i + 500, 50)) for i in range(300)]
    docs.append((999, "the value " + "x7Kq9Zr2Lm4Tn8Vb3Wc5Yd1Pf" + " and anotherlongordinaryidentifier2024"))
    out = {x.doc_id: x for x in credentials.op7(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[999].spans == "markov:10:35"
    ratios = credentials.train(spark.createDataFrame(docs, "doc_id long, text string"))
    secrets = [credentials.score(rand(), ratios) >= credentials.MIN_MEAN for _ in range(300)]
    plain = [credentials.score(prose(9000 + i, 12).replace(" ", "").encode("ascii", "ignore").decode(), ratios)
             < credentials.MIN_MEAN for i in range(300)]
    assert sum(secrets) >= 285 and sum(plain) >= 297


def brute_mix(rows, max_epochs=mixing.MAX_EPOCHS, seed=mixing.SEED):
    import math
    tokens = {}
    for d, s, t in rows:
        tokens.setdefault(s, 0)
        tokens[s] += len(B.words(t))
    live = {s: n for s, n in tokens.items() if n}
    total = sum(live.values())
    p = {s: n / total for s, n in live.items()}
    spread = max(p.values()) / min(p.values())
    alpha = max(0, math.ceil(1e6 * (1 - math.log(max_epochs) / math.log(spread)))) / 1e6 if spread > 1 else 0.0
    w = {s: x ** alpha for s, x in p.items()}
    scale = max(live[s] / w[s] for s in w)
    out = Counter()
    for s in tokens:
        budget = round(w[s] * scale) if s in live else 0
        full, rest = divmod(budget, live[s]) if s in live else (1, 0)
        mine = [(d, len(B.words(t))) for d, q, t in rows if q == s]
        for e in range(full):
            out.update((d, s, e) for d, _ in mine)
        key = lambda d: hashlib.md5(f"{seed}:{full}:{'null' if d is None else d}".encode()).hexdigest()
        used, by = 0, {}
        for d, n in mine:
            by.setdefault(key(d), []).append((d, n))
        for k in sorted(by):
            used += sum(n for _, n in by[k])
            if rest == 0 or used > rest:
                break
            out.update((d, s, full) for d, _ in by[k])
    return out


def test_mixing(nasty, spark):
    rows = [(r[0], r[3], r[1]) for r in nasty_rows()]
    assert bag(mixing.op1(nasty), "doc_id", "source", "epoch") == brute_mix(rows)
    rows = [(i, f"s{min(i % 17, 5)}", prose(i, 1 + i % 23)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = brute_mix(rows)
    assert bag(mixing.op1(df), "doc_id", "source", "epoch") == want
    copies = Counter(d for d, _, e in want.elements())
    assert Counter(r.doc_id for r in mixing.mix_documents(df).collect()) == copies and min(copies.values()) >= 1


def test_mixing_entropy_target(spark):
    import math
    src = spark.createDataFrame([("a", 900, 9), ("b", 90, 9), ("c", 10, 9)], "skey string, tokens long, docs long")
    a = mixing.exponent(src, None, 0.9)

    def entropy(x):
        w = [p ** x for p in (.9, .09, .01)]
        return -sum(v / sum(w) * math.log(v / sum(w)) for v in w)
    assert entropy(a) <= 0.9 < entropy(a - 1e-6)


@pytest.mark.parametrize("op", [quality.op9, pii.op8, simhash.op2, substring.op3, suffix.op5, credentials.op7,
                                mixing.op1, lambda d: bpe.op4(d, tokenizer_path()), pii.redact, mixing.mix_documents,
                                quality.quality_filter, simhash.keep_one_per_group])
def test_empty_table(nothing, op):
    assert op(nothing).collect() == []
