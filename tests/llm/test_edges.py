"""Nulls, empty and very long texts, ties and repeated rows, empty tables, clashing columns; faults and fallbacks."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vexel.llm import chat_format, decontaminate, exact_dedup, jaccard_join, line_dedup, mixing, secrets, suffix_dedup, token_counts, toxicity
from vexel.llm.common import Words, blank_table, grams, running_sum

SCHEMA = "doc_id bigint, text string, lang string, source string, kept int, size int, row int, n int, slot int, key string, tag int"
LONG = " ".join(f"w{i * 7919 % 100003}" for i in range(60_000))
ROWS = [
    (1, "a  b\tc", "en", "s1"), (2, "a b c", "en", "s1"), (2, "a b c", "en", "s1"), (3, None, None, None), (4, "", "en", "s2"), (5, LONG, "de", "s2"),
    (6, LONG + " end", "de", None), (None, "a b c", "en", "s1"), (None, None, "en", "s1"), (7, "x" * 300_000, "fr", "s3"), (8, "Ä ö \U0001f600 " * 40, "fr", "s3"), (9, "\n\n \n", "fr", "s3"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, 0, 0, 0, 0, "k", 0) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


# exact dedup


def test_exact_dedup(docs, nothing):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(ROWS)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for r in got:
        same = [x for x in ROWS if hashlib.sha256(norm(x[1]).encode()).hexdigest() == r.text_sha256]
        assert r.group_size == len(same)
        ids = [x[0] for x in same if x[0] is not None]
        assert r.keep_id == (min(ids) if ids else None)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    assert all(sum(r.kept for r in g) == 1 and next(r for r in g if r.kept).doc_id == g[0].keep_id for g in by.values())
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_weak_identifiers_lose_nothing(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(r.randrange(0, 3000))) for _ in range(60)] * 2
    d = frame(spark, texts)
    strong, weak = (sorted(exact_dedup.exact_dedup(d, digest_bytes=b).drop("n_chunks").collect()) for b in (16, 1))
    assert strong == weak
    assert all(x.group_size == texts.count(texts[x.doc_id]) or re.search("  ", texts[x.doc_id]) for x in strong)


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=3000), st.binary(max_size=3000))
def test_chunks(a, b):
    """Chunks give the text again and do not depend on the texts before."""
    (t, parts), (_, again) = list(exact_dedup.chunked([a, b]))[0], list(exact_dedup.chunked([b, a]))[1]
    assert b"".join(parts) == t and parts == again
    assert exact_dedup.normalised(a) == re.sub(rb"[\x20\x09-\x0D]+", b" ", a)


# mixing


def test_mixing(spark, docs, nothing):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    taken, target = {}, {}
    for r in got:
        taken[r.source_size, r.target] = taken.get((r.source_size, r.target), 0) + r.taken
        assert r.taken <= 3 * r.size
    assert all(abs(v - k[1]) <= 1 for k, v in taken.items())
    assert sum(k[1] for k in taken) == pytest.approx(sum(r.size for r in got))
    assert mixing.mix(nothing).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [None, ""]).withColumn("source", F.lit("s"))).collect()] == [0, 0]
    assert sorted(got, key=str) == sorted(mixing.mix(docs).collect(), key=str)
    del target


def test_slots_are_spread(spark):
    shares = spark.createDataFrame([("a", 10, 0, 50.0), ("b", 10, 1, 30.0), ("c", 5, 2, 20.0), ("d", 0, 3, 0.0)], "source string, source_size int, rank long, target double")
    s = mixing.slots(shares, 1000).collect()
    assert sorted(x.slot for x in s) == list(range(1000))
    for rank, share in ((0, 0.5), (1, 0.3), (2, 0.2)):
        own = sorted((x.slot, x.r) for x in s if x["rank"] == rank)
        assert [r for _, r in own] == list(range(len(own)))
        assert all(abs(i + 1 - share * (slot + 1)) < 6 for i, (slot, _) in enumerate(own))


def test_pieces_fill_slots(spark):
    d = spark.createDataFrame([(i, "w " * (i % 37 + 1), f"s{i % 3}") for i in range(200)], "doc_id bigint, text string, source string")
    rows, pieces = mixing.mixed_blocks(d, block=16)
    full = pieces.filter("slot is not null").groupBy("slot").agg(F.sum("words").alias("w")).collect()
    assert all(x.w <= 16 for x in full) and sum(x.w == 16 for x in full) >= len(full) - 3


# decontamination


def test_decontaminate(spark, docs, nothing):
    bench = spark.createDataFrame([(1, "A b, C!"), (2, None), (3, "..."), (4, " ".join(f"W{i * 7919 % 100003}" for i in range(500, 520))), (4, "a b c"), (None, "a b c")], "item_id bigint, text string")
    got = {(r.doc_id, r.n_words): r for r in decontaminate.digest(decontaminate.decontaminate(docs, bench)).collect()}
    assert got[1, 3].n_items == 2 and got[1, 3].n_hit == 3
    assert got[5, 60000].n_hit == 20 and got[5, 60000].items_sha256 == decontaminate.sha([4])
    assert got[3, 0].n_hit == 0 and not got[3, 0].contaminated
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("size(items) > 0").count() == 0
    left = decontaminate.without_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["3", "4", "7", "8", "9", "None"]


def test_items_without_id_count_as_hits(spark):
    d = frame(spark, ["x one two three y", "four five", "clean"])
    b = spark.createDataFrame([(None, "one two three"), (None, "four five"), (7, "five")], "item_id bigint, text string")
    for n in (500_000, 1):
        got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.digest(decontaminate.decontaminate(d, b, block_windows=n)).collect()}
        assert got == {0: (3, 0, True), 1: (2, 1, True), 2: (0, 0, False)}
    assert [r.doc_id for r in decontaminate.without_contaminated(d, b).collect()] == [2]


def test_blocks_of_windows_find_the_same(spark):
    r = random.Random(5)
    words = [f"v{i}" for i in range(40)]
    d = frame(spark, [" ".join(r.choice(words) for _ in range(r.randrange(0, 120))) for _ in range(80)] + [None])
    b = spark.createDataFrame([(f"i{k}", " ".join(r.choice(words) for _ in range(r.choice((1, 2, 2, 3))))) for k in range(60)], "item_id string, text string")
    one, many = (sorted(decontaminate.digest(decontaminate.decontaminate(d, b, block_windows=n)).collect()) for n in (500_000, 7))
    assert one == many and any(x.n_items > 1 for x in one)


# chat formatting


def test_chat(spark):
    turns = [(1, 0, "system", "be <|im_end|> \\ nice"), (1, 1, "user", "hi"), (1, 2, "bob\n", "yo"), (1, None, None, None), (2, 0, "system", "alone"), (1, 300, "user", "late")]
    t = spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").withColumn("part", F.lit(1)).withColumn("people", F.lit("x"))
    got = {(r.participant, r.part): r for r in chat_format.rotate(t).collect()}
    assert sorted({k[0] for k in got}) == ["bob\n", "unknown", "user"] and len(got) == 9
    r = got["bob\n", 0]
    assert r.dialogue == "<|im_start|>system\nbe <\\|im_end|> \\\\ nice<|im_end|>\n<|im_start|>user name=user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    a, b = map(int, r["mask"].split(":"))
    assert r.dialogue[a:b] == "yo<|im_end|>" and r.n_masked == 1
    assert "name=bob\\n\n" in got["user", 0].dialogue and got["user", 1].dialogue.endswith("late<|im_end|>\n")
    assert got["user", -1]["mask"] == ""
    assert chat_format.rotate(t.limit(0)).count() == 0
    plan = chat_format.rotate(t)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# secrets


def test_secrets(spark, docs, nothing):
    d = frame(spark, ["é PASSWD='abcdefghijkl' AKIA" + "Z" * 14, "token=short secret: 123456789012 0123456789abcdef", None, "a" * 200_000, "api-key=xxxxxxxxxxxxx apikey=xxxxxxxxxxxxx", "ghp_" + "a" * 36])
    got = {r.doc_id: r for r in secrets.digest(secrets.scan_secrets(d)).collect()}
    assert got[0].spans == "assign:2:22,access:24:42" and got[0].n_assign == 1
    assert got[1].n_hex == 1 and got[1].n_assign == 1
    assert got[2].spans == "" and got[3].spans == "hex:0:200000" and got[4].n_assign == 1
    assert got[5].spans.split(",")[0] == "github:0:40"
    assert secrets.scan_secrets(docs).count() == len(ROWS) and secrets.scan_secrets(nothing).count() == 0


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("hello") == ("all", ("tri", "hel"), ("tri", "ell"), ("tri", "llo"))
    assert q("[0-9a-f]+") == secrets.ANY and q("a?b?") == secrets.ANY and q("(abc)*") == secrets.ANY
    assert q("abc|xyz") == ("one", ("tri", "abc"), ("tri", "xyz")) and q("abc|x") == secrets.ANY
    assert q("(?:abc)+") == ("tri", "abc")


@settings(max_examples=200, deadline=None)
@given(st.sampled_from([r.pattern for r in secrets.BASE + secrets.MORE] + ["ab(cd|ef)?gh", "x{3}y+z", "(foo|ba[rz])-[0-9]{2,}"]), st.data())
def test_no_match_escapes_its_query(pattern, data):
    text = data.draw(st.from_regex(re.compile(pattern, re.A))).encode("utf-8", "ignore")
    rule = (secrets.Rule("k", pattern),)
    s = secrets.Scanner(rule)
    assert s.spans([b"", text])[1]


# line dedup


@pytest.mark.parametrize("most", [1000, 0])
def test_lines(spark, docs, nothing, most):
    d = frame(spark, [f" Common\t\nown {i}\n\nCOMMON" for i in range(10)] + ["common\nrare", None, "", "rare"])
    got = {r.doc_id: r for r in line_dedup.line_dedup(d, broadcast_keys=most).collect()}
    assert got[0].kept == "own 0\n" and (got[0].n_lines, got[0].n_dropped) == (4, 2)
    assert got[10].kept == "rare" and got[11].kept == "" and got[11].n_lines == 1 and got[12].n_lines == 1
    assert line_dedup.line_dedup(docs, broadcast_keys=most).count() == len(ROWS)
    assert line_dedup.line_dedup(docs, documents=1, broadcast_keys=most).filter(F.col("kept").rlike(r"[^ \n]")).count() == 0
    assert line_dedup.line_dedup(nothing, broadcast_keys=most).count() == 0


# suffix dedup


def covered(rows):
    first = {}
    for d, x in sorted(rows, key=lambda r: r[0]):
        for i in range(len(x) - 49):
            first.setdefault(x[i : i + 50], d)
    out = []
    for d, x in rows:
        c = np.zeros(len(x), bool)
        for i in range(len(x) - 49):
            if first[x[i : i + 50]] < d:
                c[i : i + 50] = True
        out.append((d, len(x), int(c.sum()), int(np.sum(np.diff(np.concatenate([[0], c])) == 1)), hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~c])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_suffixes(spark, monkeypatch, seed):
    for name, value in (("TEXT_BUCKET", 4000), ("ANCHOR_BUCKET", 4000), ("SEND", 6000), ("SORTED", 500)):
        monkeypatch.setattr(suffix_dedup, name, value)
    r = random.Random(seed)
    passages = ["".join(r.choice("ab é") for _ in range(r.choice((48, 49, 50, 51, 99, 200)))) for _ in range(12)] + ["z" * 120, "xy" * 60, "a" * 49]
    texts = ["".join(r.choice(passages) if r.random() < 0.6 else "".join(r.choice("abcdefg") for _ in range(r.randrange(60))) for _ in range(r.randrange(7))) for _ in range(60)]
    rows = list(enumerate(texts))
    d = spark.createDataFrame([*rows, (7, texts[3]), (7, texts[8])], "doc_id bigint, text string")
    got = sorted(tuple(x) for x in suffix_dedup.digest(suffix_dedup.suffix_dedup(d)).collect())
    assert got == covered([(i, t.encode()) for i, t in [*rows, (7, texts[3]), (7, texts[8])]])


def test_suffix_edges(spark, docs, nothing):
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert len(got) == len(ROWS) and sum(r.doc_id is None for r in got) == 2
    six = next(r for r in got if r.doc_id == 6)
    assert bytes(six.kept) == b" end" and [tuple(s) for s in six.spans] == [(0, len(LONG))]
    assert next(r for r in got if r.doc_id == 7).n_removed == 0
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.text("ab", min_size=12, max_size=12)), min_size=1, max_size=60), st.integers(1, 3))
def test_deep_shallow_sorting(rows, scale):
    """Groups that the quicksort and the tries end with are the equal strings of several documents."""
    tails = [("q" * (8 * scale) + t + "r" * (38 - 8 * scale)).encode() for _, t in rows]
    doc = np.array([d for d, _ in rows])
    text = b"".join(tails) + bytes(100)
    eight, start = suffix_dedup.words_at(text), np.arange(len(rows)) * 50
    r, g = suffix_dedup.multikey_quicksort(eight, start, np.arange(len(rows)), np.zeros(len(rows), np.int64), doc, 16)
    r, g = suffix_dedup.blind_tries(np.frombuffer(text, np.uint8), eight, start, r, g, doc, 16, 50)
    got = {}
    for a, b in zip(r.tolist(), g.tolist(), strict=True):
        got.setdefault(b, set()).add(a)
    want = {}
    for i, t in enumerate(tails):
        want.setdefault(t, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len({doc[i] for i in v}) > 1)


# toxicity


def test_toxicity(spark, docs, nothing):
    r = random.Random(2)
    plain = [f"word{i}" for i in range(300)]
    say = lambda: " ".join(r.choice(plain) for _ in range(9))
    texts, y = [], []
    for i in range(400):
        s = [say() for _ in range(6)]
        if i % 4 == 0:
            s[r.randrange(6)] += " vilethings" + str(i)
        texts.append(". ".join(s))
        y.append(int(i % 4 == 0))
    d = frame(spark, texts)
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)] + [(5, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(d, labels)
    got = {x.doc_id: x for x in toxicity.score_texts(d, model).collect()}
    out = [i for i in range(400) if toxicity_held(i)]
    assert all((got[i].score >= 0.3) == bool(y[i]) for i in out)
    for i in out:
        places = [texts[i][s.start : s.stop] for s in got[i].sentences]
        assert all("vilethings" in p and "." not in p for p in places) and bool(places) == bool(y[i])
    odd = toxicity.score_texts(docs, model).collect()
    assert len(odd) == len(ROWS) and all(x.score == 0 for x in odd if x.doc_id in (3, 4))
    assert toxicity.score_texts(nothing, model).count() == 0
    none = toxicity.train(d, labels.limit(0))
    assert toxicity.score_texts(d, none).agg(F.max("score")).first()[0] < 1e-6
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    assert len(toxicity.train(d, labels, sample=40).known) <= len(model.known)


def test_long_clean_text_is_not_toxic():
    r = random.Random(4)
    say = lambda n: [" ".join(f"word{r.randrange(300)}" for _ in range(9)) for _ in range(n)]
    bags = [say(6) for _ in range(400)]
    for b in bags[::4]:
        b[2] += " vilethings"
    model = toxicity.fit([". ".join(b).encode() for b in bags], np.array([int(i % 4 == 0) for i in range(400)]))
    long = say(50_000)
    scores, places = model.score([". ".join(x).encode() for x in (long, [*long, "some vilethings here"])])
    assert scores[0] < 0.3 <= scores[1] and [len(p) for p in places] == [0, 1]


def toxicity_held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4 == 2


# Jaccard join


def components(texts):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            b = len(sets[i] & sets[j])
            if b and 100 * b >= 85 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_jaccard(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard_join, "SEND", 3000)
    r = random.Random(seed)
    texts = []
    for _ in range(14):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice((5, 10, 12, 15, 18, 25, 60, 150)))]
        for _ in range(r.choice((1, 2, 9))):
            t = list(base)
            for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
                r.choice((lambda t=t: t.append(f"e{r.randrange(99)}"), lambda t=t: t.pop(), lambda t=t: t.__setitem__(r.randrange(len(t)), f"e{r.randrange(99)}")))()
            texts.append(r.choice((" ", "\n")).join(t))
    texts += [None, "", "one two", "ONE  two", "one"]
    got = sorted(tuple(x) for x in jaccard_join.jaccard_join(frame(spark, texts)).collect())
    assert got == components(texts)


@pytest.mark.parametrize("light", [0, 9, 14])
def test_boundary_changes_no_answer(spark, monkeypatch, light):
    r = random.Random(9)
    texts = []
    for _ in range(25):
        base = [f"w{r.randrange(90)}" for _ in range(r.randrange(9, 20))]
        texts += [" ".join(base), " ".join(base[:-1]), " ".join([*base, "x"])]
    monkeypatch.setattr(jaccard_join, "boundary", lambda *_: light)
    assert sorted(tuple(x) for x in jaccard_join.jaccard_join(frame(spark, texts)).collect()) == components(texts)


def test_jaccard_edges(spark, docs, nothing):
    got = jaccard_join.jaccard_join(docs).collect()
    assert len(got) == len(ROWS)
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert by[1, 1] == by[2, 1] == 1 and by[3, 0] == 3 and by[4, 0] == 4 and by[6, 59998] == 5
    assert next(r for r in got if r.doc_id is None and r.n_shingles == 1).component_id == 1
    assert jaccard_join.jaccard_join(nothing).count() == 0
    assert jaccard_join.boundary(1.0, 85) <= jaccard_join.boundary(1000.0, 85) <= jaccard_join.LIGHT_LIMIT


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)], "a bigint, b bigint")
    got = {r.row: r.comp for r in jaccard_join.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


# token counts


def test_rollup(spark, docs, tmp_path):
    r = token_counts.TokenRollup(spark, str(tmp_path / "r"))
    state = "doc_id bigint, source string, lang string, tokenizer string, tokens bigint"
    assert r.totals().count() == 0
    new = spark.createDataFrame([(1, "a", "en", "v1", 10), (2, "a", "en", "v1", 5), (3, None, None, "v1", 7), (1, "a", "en", "v2", 12)], state)
    assert r.commit("b1", new) and not r.commit("b1", new)
    change = spark.createDataFrame([(1, "a", "en", "v1", 11, "revise", 0), (2, None, None, "v1", None, "delete", 0), (9, "z", "z", "v1", 1, "delete", 0), (3, "b", "de", "v1", 6, "insert", 1), (3, "b", "de", "v1", 8, "insert", 2)], state + ", op string, order int")
    assert r.commit("b2", change)
    got = {(x.source, x.lang, x.tokenizer): (x.docs, x.tokens) for x in token_counts.TokenRollup(spark, str(tmp_path / "r")).totals().collect()}
    assert got == {("a", "en", "v1"): (1, 11), ("b", "de", "v1"): (1, 8), ("a", "en", "v2"): (1, 12)}
    assert r.commit("b3", change.limit(0)) and r.committed() == ["b1", "b2", "b3"]
    with pytest.raises(Exception, match="doc_id"):
        r.commit("b4", spark.createDataFrame([(None, "a", "en", "v1", 10)], state))
    with pytest.raises(ValueError):
        r.commit("../x", new)
    assert r._publish("_staged/none", "b1") is False  # a writer that comes late
    counted = token_counts.count_tokens(docs, {"w": token_counts.count_words}).collect()
    assert len(counted) == len(ROWS) and sum(x.tokens for x in counted if x.doc_id in (3, 4)) == 0


def test_a_load_counts_every_row(spark, docs, tmp_path):
    r = token_counts.TokenRollup(spark, str(tmp_path / "r"))
    v = {"w": token_counts.count_words}
    assert r.commit("load", token_counts.count_tokens(docs, v)) and not r.commit("load", token_counts.count_tokens(docs, v))
    want = {}
    for _, text, lang, source in ROWS:
        n, k = want.get((source, lang), (0, 0))
        want[source, lang] = (n + 1, k + len((text or "").encode().split()))
    totals = lambda: {(x.source, x.lang): (x.docs, x.tokens) for x in r.totals().collect()}
    assert totals() == want
    gone = spark.createDataFrame([(2, None, None, "w", None, "delete", 0)], "doc_id bigint, source string, lang string, tokenizer string, tokens bigint, op string, order int")
    assert r.commit("gone", gone)
    n, k = want["s1", "en"]
    assert totals() == {**want, ("s1", "en"): (n - 2, k - 6)}


# shared pieces


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB \néx", max_size=30), max_size=8))
def test_words(texts):
    raw = [t.encode() for t in texts] + [b"y" * 700 + b" " + b"y" * 699 + b"z"]
    w = Words(raw, blank_table(True))
    want = [t.lower().split() for t in raw]
    assert w.counts().tolist() == [len(x) for x in want]
    flat = [x for t in want for x in t]
    assert [w.text(i, 1) for i in range(len(flat))] == flat
    h = w.hashes().tolist()
    assert len(set(h)) == len(set(flat)) and dict(zip(flat, h, strict=True)) == {a: b for a, b in zip(flat, h, strict=True)}
    assert len(grams(w.hashes(), 2)) == len(flat) - 1


def test_running_sum(spark):
    d = spark.createDataFrame([(k, i % 5, i, i * 3 % 7) for k in ("a", None) for i in range(40)], "k string, s int, i int, v int")
    got = {(r.k, r.i): r.c for r in running_sum(d, ["k"], ["i"], "v", "s", "c").collect()}
    for k in ("a", None):
        total = 0
        for i in sorted(range(40), key=lambda i: (i % 5, i)):
            assert got[k, i] == total
            total += i * 3 % 7
