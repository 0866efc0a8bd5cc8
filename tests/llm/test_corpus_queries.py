"""opN queries against their SQL or brute force, at the smallest scale, and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import pytest

from vexel.llm import queries as Q
from vexel.llm import secrets, toxicity

AT = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{AT}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("select doc_id, coalesce(text, '') from documents").fetchall())


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = Q.QUERIES[name](spark, AT), duck.sql(Q.SQL[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_ten_queries():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in Q.QUERIES] == list(range(1, 11))


def test_op1(spark, duck):
    import tiktoken

    from vexel.llm.token_counts import PATTERN, byte_pair

    counter = byte_pair(f"{Q.TOKENIZERS}/byte_bpe_50k.tiktoken")
    e = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=counter.encoding()._mergeable_ranks, special_tokens={})
    want: Counter = Counter()
    n: Counter = Counter()
    for s, lang, t in duck.sql("select source, lang, coalesce(text, '') from documents").fetchall():
        for name, k in (("words-v1", len(re.findall(r"[^\x20\x09-\x0D]+", t))), ("byte_bpe_50k-v1", len(e.encode_ordinary(t)))):
            want[s, lang, name] += k
            n[s, lang, name] += 1
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in Q.op1_token_counts(spark, AT).collect()}
    assert got == {k: (n[k], want[k]) for k in want}


def test_op6(spark, texts):
    kinds = [(r.kind, re.compile(r.pattern, re.A), r.group, r.least) for r in secrets.BASE + secrets.MORE]
    for r in Q.op6_secret_scan(spark, AT).collect():
        found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}", kind) for k, (kind, p, g, least) in enumerate(kinds) for m in p.finditer(texts[r.doc_id]) if len(m[g]) >= least]
        found.sort()
        base = [f[2] for f in found if f[1] < 3]
        c = Counter(f[3] for f in found)
        assert (r.n_assign, r.n_access, r.n_hex) == (c["assign"], c["access"], c["hex"])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r.spans == ",".join(f[2] for f in found)


def test_op9_learns(spark, duck):
    """On labels that training has not seen."""
    y = dict(duck.sql("select doc_id, toxic from labels").fetchall())
    at = "/root/testdata/sf0.1"
    y = dict(duck.sql(f"select doc_id, toxic from '{at}/labels.parquet'").fetchall())
    got = {r.doc_id: r for r in Q.op9_toxicity(spark, at).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    unseen = [d for d in y if got[d].held_out]
    hit = sum(got[d].predicted and y[d] for d in unseen)
    assert hit >= 0.9 * sum(y[d] for d in unseen)
    assert hit >= 0.95 * sum(got[d].predicted for d in unseen)


def test_pipeline(spark, duck, texts):
    """Each stage against a brute-force version of itself, on what the stage before has kept."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    y = spark.read.parquet(f"{AT}/labels.parquet")
    model = toxicity.train(docs, y)
    ids = sorted(texts)
    scores, _ = model.score([texts[d].encode() for d in ids])
    kept = [d for d, s in zip(ids, scores, strict=True) if round(s, 9) < 0.3]
    same: dict[str, int] = {}
    for d in kept:
        same.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[d]), d)
    kept = sorted(same.values())
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d in kept:
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[d].translate(low))
        sets[d] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    top = {d: d for d in kept}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(kept):
        for b in kept[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, z = sorted((find(a), find(b)))
                top[z] = x
    kept = [d for d in kept if find(d) == d]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows: dict[int, set] = {}
    for (t,) in duck.sql("select text from benchmark where text is not null").fetchall():
        w = word.findall(t.translate(low))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(min(10, len(w)), set()).add(tuple(w[i : i + 10]))

    def clean(t):
        w = word.findall(t.translate(low))
        return not any(tuple(w[i : i + n]) in of for n, of in windows.items() for i in range(len(w) - n + 1))

    kept = [d for d in kept if clean(texts[d])]
    got = corpus_pipeline.run(spark, AT).collect()
    assert sorted(r.doc_id for r in got) == kept
    assert sum(r.taken for r in got) == pytest.approx(sum(r["size"] for r in got), abs=30)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
