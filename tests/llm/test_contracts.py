"""Methods held against plain versions of themselves, and rows that the given tables lack."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vexel.llm import chat_format, decontaminate, exact_dedup, line_dedup, mixing, queries, suffix_dedup, token_counts, toxicity
from vexel.llm.common import Points

STATE = "doc_id bigint, source string, lang string, tokenizer string, tokens bigint"
DOCS = "doc_id bigint, text string, lang string, source string, _row int, `_ROW2` int, first boolean, recipe string"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def frame(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(texts)), texts, strict=True)), "doc_id bigint, text string")


def same(got, want):
    return sorted(map(str, got)) == sorted(map(str, want))


# shared pieces


@given(st.text("aé\U0001f600\n", max_size=60))
def test_points(text):
    p, raw = Points(text.encode()), text.encode()
    for i in range(len(text) + 1):
        assert p(len(text[:i].encode())) == i
    assert len(raw) >= len(text)


# mixing


def mixed(docs):
    """(doc_id, size, taken) of (doc_id, text, source) rows, by the contract."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in docs}
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s))
    total = {s: sum(size[d] for d, _, x in docs if x == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    left, room, target = sum(total.values()), set(sources), {}
    while True:
        level = left / sum(weight[s] for s in room) if room else 0
        full = [s for s in room if level * weight[s] > 3 * total[s]]
        if not full:
            break
        for s in full:
            target[s] = 3 * total[s]
            left -= target[s]
            room.remove(s)
    target |= {s: level * weight[s] for s in room}
    out = []
    for s in sources:
        words, at = math.floor(target[s] + 1e-9), 0
        for d, *_ in sorted((x for x in docs if x[2] == s), key=lambda x: (hashlib.md5(f"mix:{x[0]}".encode()).hexdigest(), x[0])):
            taken = sum(max(0, min(at + size[d], words - k * total[s]) - at) for k in range(3)) if total[s] else 0
            out.append((d, size[d], taken))
            at += size[d]
    return out


def test_mix_by_document(spark):
    r = random.Random(3)
    docs = [(i, " ".join(["w"] * r.randrange(60)) if r.random() < 0.9 else None, r.choice(["a", "b", "b", "b", "c", None])) for i in range(150)]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), block=32)
    assert same([(x.doc_id, x["size"], x.taken) for x in got.collect()], mixed(docs))


def test_slots_decide_what_is_taken(spark, monkeypatch):
    """Without slots nothing is taken, and another sequence gives documents other slots."""
    d = spark.createDataFrame([(i, "w " * 50, f"s{i % 3}") for i in range(120)], "doc_id bigint, text string, source string")
    usual = sorted(mixing.mix(d, block=64).collect())
    assert all((x.n_slots > 0) == (x.taken > 0) == (x.first_slot is not None) for x in usual)
    monkeypatch.setattr(mixing, "GOLDEN", 0.0)
    degenerate = sorted(mixing.mix(d, block=64).collect())
    assert [x.first_slot for x in usual] != [x.first_slot for x in degenerate]
    real = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *a: real(*a).filter("r > 0"))
    fewer = mixing.mix(d, block=64).collect()
    assert sum(x.taken for x in usual) - sum(x.taken for x in fewer) == 3 * 64


def test_schedule_gives_every_source_its_slots(spark):
    shares = spark.createDataFrame([("a", 10, 0, 500.0), ("b", 10, 1, 301.5), ("c", 5, 2, 3.2), ("d", 0, 3, 0.0)], "source string, source_size int, rank long, target double")
    s = mixing.schedule(shares, 10).collect()
    assert len({x.slot for x in s}) == len(s) == 50 + 31 + 1
    assert Counter(x["rank"] for x in s) == {0: 50, 1: 31, 2: 1}
    assert all(sorted(x.r for x in s if x["rank"] == k) == list(range(n)) for k, n in ((0, 50), (1, 31), (2, 1)))
    assert sum(x.words for x in s if x["rank"] == 1) == 301


# token counts


def test_two_writers_from_one_state(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "r")
    one, two = token_counts.TokenRollup(spark, root), token_counts.TokenRollup(spark, root)
    one.commit("b0", spark.createDataFrame([(1, "a", "en", "v", 10)], STATE))
    revise = lambda n: spark.createDataFrame([(1, "a", "en", "v", n, "revise")], STATE + ", op string")
    publish, met = one._publish, []

    def late(staged, batch_id, version=None):
        if not met:
            met.append(two.commit("b2", revise(12)))  # the other writer is first
        return publish(staged, batch_id, version)

    monkeypatch.setattr(one, "_publish", late)
    assert one.commit("b1", revise(11)) and met == [True]
    assert [(r.docs, r.tokens) for r in one.totals().collect()] == [(1, 11)]
    assert one.committed() == ["b0", "b1", "b2"] and one.version() == 3


def test_snapshots_change_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "SNAPSHOT", 3)
    r, rng, want = token_counts.TokenRollup(spark, str(tmp_path / "r")), random.Random(1), {}
    for n in range(8):
        rows = []
        for d in rng.sample(range(6), 3):
            op = rng.choice(["insert", "revise", "delete"])
            rows.append((d, rng.choice("ab"), "en", "v", rng.randrange(50), op))
            want.pop(d, None)
            if op != "delete":
                want[d] = rows[-1]
        assert r.commit(f"b{n}", spark.createDataFrame(rows, STATE + ", op string"))
        assert not r.commit(f"b{n // 2}", spark.createDataFrame(rows, STATE + ", op string"))
    assert r.committed() == [f"b{n}" for n in range(8)] and r.version() == 8
    sums = Counter()
    for _, s, _, _, t, _ in want.values():
        sums[s] += t
    assert {x.source: x.tokens for x in r.totals().collect()} == dict(sums)
    assert sorted((x.doc_id, x.tokens) for x in r.state().collect()) == sorted((d, x[4]) for d, x in want.items())


def test_rows_that_cannot_be_committed_are_set_aside(spark, tmp_path):
    r = token_counts.TokenRollup(spark, str(tmp_path / "r"))
    rows = [(1, "a", "en", "v", 10, "insert"), (None, "a", "en", "v", 3, "insert"), (2, "a", "en", "v", 3, "upsert"), (3, "a", "en", "v", 3, None)]
    assert r.commit("b", spark.createDataFrame(rows, STATE + ", op string"), set_aside=True)
    assert [(x.docs, x.tokens) for x in r.totals().collect()] == [(1, 10)]
    assert sorted((x.batch, x.reason, x.rows) for x in r.rejected().collect()) == [("b", "no doc_id", 1), ("b", "unknown op", 2)]


@pytest.fixture(scope="module")
def counter():
    return token_counts.byte_pair(f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken")


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from(list("ab 1!\n\t\r　\x1c\x85é")), max_size=60))
def test_long_runs_are_cut_without_changing_the_count(counter, text):
    long, token_counts._LONG = token_counts._LONG, re.compile(f"[{token_counts.BLANKS}]{{3,}}")
    limit, token_counts.LONG_RUN = token_counts.LONG_RUN, 3
    try:
        assert counter.count(text) == len(counter.encoding().encode_ordinary(text))
    finally:
        token_counts._LONG, token_counts.LONG_RUN = long, limit


def test_very_long_runs(counter):
    assert counter([b" " * 1_000_000 + b"a", b"x" + b"\n" * 1_000_000, b""])[2] == 0


def tables(spark, path, docs, schema=DOCS, labels=(), bench=(), turns=()):
    spark.createDataFrame(list(docs), schema).repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(bench), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(list(turns), "conv_id bigint, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


ODD = [
    (1, "a  b\tc", "en", "s1"), (2, "a b c", "en", "s1"), (2, "a b c", "en", "s1"), (3, None, None, None), (4, "", "en", "s2"), (5, "w " * 40_000 + " " * 30_000, "de", "s2"),
    (None, "a b c", "en", "s1"), (None, None, "en", "s1"), (7, "x" * 100_000, "fr", "s3"), (8, "Ä ö \U0001f600 " * 40, "fr", "s3"), (9, "one two three four five six seven eight nine ten eleven", "fr", "s3"),
]
ODD = [(*r, 0, 0, True, "x") for r in ODD]


def test_op1_after_each_batch(spark, tmp_path, counter):
    """Totals of all documents, of those that are left and tidied, and of all again; from the query, of all."""
    at = tables(spark, tmp_path / "t", rows := [*ODD, (10, "p  q", "en", "s1", 0, 0, True, "x"), (11, "p  q", "en", "s2", 0, 0, True, "x"), (12, "p  q r", "en", "s2", 0, 0, True, "x")])
    count = {"words-v1": lambda t: len((t or "").encode().split()), "byte_bpe_50k-v1": lambda t: counter([(t or "").encode()])[0]}
    times = Counter(r[0] for r in rows)
    alone, first = [r for r in rows if r[0] is not None and times[r[0]] == 1], {}
    for r in sorted(alone):
        first.setdefault(r[1] or "", r[0])
    gone = {r[0] for r in alone if first[r[1] or ""] != r[0]}
    tidy = [(r[0], re.sub("  +", " ", r[1] or "") if r in alone else r[1], *r[2:]) for r in rows if r[0] not in gone]

    def totals(documents):
        want = {}
        for _, t, lang, source, *_ in documents:
            for name, n in count.items():
                docs, tokens = want.get((source, lang, name), (0, 0))
                want[source, lang, name] = (docs + 1, tokens + n(t))
        return want

    found = lambda df: {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in df.collect()}
    versions = {"words-v1": token_counts.count_words, "byte_bpe_50k-v1": counter}
    r = queries.tidied_and_restored(spark.read.parquet(f"{at}/documents.parquet"), versions, str(tmp_path / "r"))
    assert r.committed() == ["load", "restore", "tidy"] and gone and r.rejected().count() == 0
    assert [found(r.totals(v)) for v in (1, 2, 3)] == [totals(rows), totals(tidy), totals(rows)] and totals(tidy) != totals(rows)
    assert found(queries.op1_token_counts(spark, at)) == totals(rows)


def test_queries_on_odd_and_empty_tables(spark, tmp_path):
    some = tables(spark, tmp_path / "some", ODD, labels=[(1, 0, 0), (None, 1, 1), (9, 0, None)], bench=[(1, "nothing here"), (None, None)], turns=[(None, None, None, None)] * 3)
    none = tables(spark, tmp_path / "none", [])
    for name, f in queries.QUERIES.items():
        n = f(spark, some).count()
        assert n == len(ODD) or name in ("op1_token_counts", "op5_chat_rotation") and n > 0, name
        assert f(spark, none).count() == 0, name


# chat formatting


def test_oversized_parts(spark):
    """Null and repeated turn numbers, many more than a part holds, against the SQL."""
    r = random.Random(1)
    rows = [(None, None if r.random() < 0.3 else r.randrange(3), r.choice(["a", "b", "system", None, "ü\n"]), r.choice(["x", "y <| é", "z\\", None, "long " * 50])) for _ in range(1500)]
    rows += [(1, i, "u" if i % 2 else "v", f"t{i}") for i in range(600)] + [(2, 5, "q", "same")] * 700 + [(3, 0, "system", "alone"), (4, 0, "u", "y" * 200_000), (4, 1, "", "")]
    df = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    df["conv_id"], df["turn"] = df["conv_id"].astype("Int64"), df["turn"].astype("Int64")
    c = duckdb.connect()
    c.register("conversations", df)
    got = chat_format.rotate(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"))
    names, found = sorted(got.columns), got.collect()
    want = c.sql(chat_format.SQL.format(conversations="conversations")).select(*names).fetchall()
    assert same([tuple(x[k] for k in names) for x in found], want)
    assert max(x.n_turns for x in found) == chat_format.PART_TURNS
    assert sum(x.n_turns for x in found if x.conv_id == 2) == 700


# toxicity


def plain_score(text, model):
    """Sentences of a text with their logits, in plain Python; features of a word alone come from the code under test."""
    of = dict(zip(model.known.tolist(), model.weights.tolist(), strict=True))
    out = []
    for m in re.finditer(r"[^.!?\n]+", text):
        words = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", m[0].translate(LOW)))
        feats = {int(f) for w in words for f in toxicity.Bags([w[0].encode()]).feature}
        live = [of[f] for f in feats if f in of]
        if live:
            out.append((m.start() + words[0].start(), m.start() + words[-1].end(), model.bias + sum(live)))
    return out


def test_scores_and_spans_by_hand(spark):
    r = random.Random(2)
    words = ["vile", "vileness", "Vile", "nice", "goody", "été", "x", "hatefulness", "42"]
    texts = ["".join(r.choice(words) + r.choice([" ", "  ", ". ", "!\n", ", "]) for _ in range(r.randrange(12))) for _ in range(60)] + ["", "...", None]
    all_ = np.unique(toxicity.Bags([w.lower().encode() for w in words]).feature)
    known = all_[::2]
    model = toxicity.Model(known, np.array([r.uniform(-2, 4) for _ in known]), -1.5)
    got = {x.doc_id: x for x in toxicity.score_texts(frame(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        want = plain_score(t or "", model)
        assert got[i].score == pytest.approx(1 - math.prod(1 - 1 / (1 + math.exp(-z)) for *_, z in want), abs=1e-8)
        assert [(s.start, s.stop) for s in got[i].sentences] == [(a, b) for a, b, z in want if z >= 0]


def test_slopes_are_those_of_the_loss():
    r = np.random.default_rng(3)
    text, sentence, feat = np.repeat(np.arange(6), 3)[:16], r.integers(0, 16, 40), r.integers(0, 9, 40)
    plain, y, w, b = r.integers(0, 4, 6), np.array([1, 0, 1, 0, 1, 0]), r.normal(size=9), -1.0
    loss = lambda w, b: toxicity.slope(w, b, text, sentence, feat, plain, y, 0.1)[0]
    _, g, gb = toxicity.slope(w, b, text, sentence, feat, plain, y, 0.1)
    for i in range(9):
        e = np.eye(9)[i] * 1e-6
        assert g[i] == pytest.approx((loss(w + e, b) - loss(w - e, b)) / 2e-6, abs=1e-6)
    assert gb == pytest.approx((loss(w, b + 1e-6) - loss(w, b - 1e-6)) / 2e-6, abs=1e-6)


def test_training_sample_has_a_bound_in_bytes(spark, monkeypatch):
    texts = [f"vile{i} words. " * 40 if i % 2 else "kind words. " * 40 for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    sizes = [len(t) for t in texts]
    whole, small = (toxicity.train(frame(spark, texts), labels, sample_bytes=b) for b in (sum(sizes), sum(sizes) // 4))
    assert len(whole.known) >= len(small.known) > 0
    assert len(toxicity.train(frame(spark, texts), labels, sample_bytes=10).known) == 0
    again = toxicity.train(frame(spark, texts).repartition(5), labels, sample_bytes=sum(sizes))
    assert np.array_equal(whole.known, again.known) and np.allclose(whole.weights, again.weights)


def test_null_id_is_not_held_out(spark):
    d = frame(spark, ["a", "b"], [None, 1])
    got = {r.doc_id: r.held_out for r in toxicity.digest(toxicity.score_texts(d, toxicity.fit([], np.empty(0, int)))).collect()}
    assert got == {None: False, 1: zlib.crc32(b"1") % 4 == 2}


# ids, windows, lines


def test_the_greatest_id_is_not_null(spark):
    text, last = "".join(random.Random(1).choices("abcdef", k=200)), (1 << 63) - 1
    got = suffix_dedup.suffix_dedup(frame(spark, [text, text, text, "q"], [last, 1, None, None])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 0), (str(last), 200), ("None", 0), ("None", 200)]


def test_a_window_of_many_items_is_spread_over_blocks(spark, monkeypatch):
    made, init = [], decontaminate.Block.__init__
    monkeypatch.setattr(decontaminate.Block, "__init__", lambda self, rows: made.append(len(rows)) or init(self, rows))
    bench = spark.createDataFrame([(i, "one two three") for i in range(200)] + [(200, "four five")], "item_id bigint, text string")
    d = frame(spark, ["zero one two three", "four five six", None])
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.digest(decontaminate.decontaminate(d, bench, block_windows=20)).collect()}
    assert got == {0: (3, 200), 1: (2, 1), 2: (0, 0)} and max(made) < 50


def test_exploded_lines_of_copies(spark):
    text = "common\nown\n\n common "
    d = frame(spark, [text] * 40 + ["common\nother"], [*range(40), None])
    for most in (0, 100):
        got = line_dedup.line_dedup(d, documents=41, broadcast_keys=most).collect()
        assert Counter((r.kept, r.n_lines, r.n_dropped) for r in got) == {("own\n", 4, 2): 40, ("other", 2, 1): 1}


# pipeline


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    some = tables(spark, tmp_path / "some", ODD, bench=[(1, "Two three four five six seven eight nine ten, eleven"), (None, None)])
    assert sorted((str(r.doc_id), r["size"]) for r in pipeline.run(spark, some).collect()) == [("1", 3), ("3", 0), ("5", 40000), ("7", 1), ("8", 120)]
    none = tables(spark, tmp_path / "none", [])
    assert pipeline.run(spark, none).count() == 0
    docs = spark.read.parquet(f"{some}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, some).columns == docs.columns


def test_pipeline_stages_against_labels_and_a_plain_mix(spark):
    """Toxicity by the given labels, which the held-out quarter of has not been learnt from, and the mix by document."""
    pipeline = pytest.importorskip("corpus_pipeline")
    at = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = {r.doc_id for r in pipeline.drop_toxic(spark, docs, at).select("doc_id").collect()}
    labels = spark.read.parquet(f"{at}/labels.parquet").filter("toxic is not null").collect()
    toxic, clean = ([r.doc_id for r in labels if r.toxic == y] for y in (1, 0))
    assert sum(d not in kept for d in toxic) >= 0.9 * len(toxic) and sum(d in kept for d in clean) >= 0.99 * len(clean)
    some = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id % 2 = 0")
    rows = [(r.doc_id, r.text, r.source) for r in some.collect()]
    got = pipeline.mix_sources(spark, some, at).collect()
    assert same([(r.doc_id, r["size"], r.taken) for r in got], mixed(rows))


def test_exact_dedup_of_many_copies(spark):
    d = frame(spark, ["same  text"] * 30 + ["same text"] * 30 + [None, ""])
    got = exact_dedup.exact_dedup(d).collect()
    assert Counter((r.keep_id, r.group_size) for r in got) == {(0, 60): 60, (60, 2): 2}
    assert sorted(r.doc_id for r in got if r.kept) == [0, 60]
