"""The Jaccard join against brute force at thresholds from 10 to 100 percent, with long lists cut in blocks."""

from __future__ import annotations

import random

import pytest

from vexel.llm import jaccard_join


def sets_of(text, shingle):
    w = text.split()
    return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()


def components(texts, shingle, percent):
    sets, top = [sets_of(t, shingle) for t in texts], list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            b = len(sets[i] & sets[j])
            if b and 100 * b >= percent * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def found(spark, texts, shingle, percent):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return sorted(tuple(x) for x in jaccard_join.jaccard_join(d, shingle=shingle, percent=percent).collect())


def some_texts(seed):
    r = random.Random(seed)
    texts = ["a b c d e f", "a b c d e x y z"]
    for _ in range(9):
        base = [f"w{r.randrange(60)}" for _ in range(r.choice((4, 5, 7, 9, 14, 30, 70)))]
        for _ in range(r.choice((1, 2, 5))):
            t = list(base)
            for _ in range(r.choice((0, 1, 2, 6, 12))):
                t[r.randrange(len(t))] = f"e{r.randrange(30)}"
            texts.append(" ".join(t[: r.randrange(max(1, len(t) // 2), len(t) + 1)]))
    return texts


def test_two_texts_that_meet_twice(spark):
    """Sets of 3 and 5 shingles with 2 in common: 2 of 6 is a third."""
    texts = ["a b c d e f", "a b c d e x y z"]
    assert found(spark, texts, 4, 33) == [(0, 3, 0), (1, 5, 0)]
    assert found(spark, texts, 4, 34) == [(0, 3, 0), (1, 5, 1)]


@pytest.mark.parametrize("percent", [10, 33, 50, 67, 85, 100])
def test_every_threshold(spark, percent):
    texts = some_texts(percent)
    assert found(spark, texts, 4, percent) == components(texts, 4, percent)


@pytest.mark.parametrize("percent", [20, 60])
def test_single_words(spark, percent):
    texts = some_texts(percent + 1)
    assert found(spark, texts, 1, percent) == components(texts, 1, percent)


@pytest.mark.parametrize("light", [0, 14])
def test_blocks_of_long_lists(spark, monkeypatch, light):
    """Many sets that share a passage and stay apart: lists are cut in blocks of a few, and pairs are sent early."""
    for name, value in (("LIST_BLOCK", 5), ("GATHERED", 10), ("HELD", 20)):
        monkeypatch.setattr(jaccard_join, name, value)
    monkeypatch.setattr(jaccard_join, "boundary", lambda *_: light)
    r = random.Random(light)
    common = [f"c{i}" for i in range(20)]
    texts = []
    for _ in range(30):
        own = [f"w{r.randrange(500)}" for _ in range(r.randrange(4, 30))]
        texts += [" ".join(common + own), " ".join(common + own[:-1])][: r.choice((1, 2))]
    assert found(spark, texts, 4, 60) == components(texts, 4, 60)


def test_a_meeting_counts_as_much_as_it_must():
    for need in range(1, 9):
        meets = min(need, jaccard_join.MEETINGS)
        assert meets * jaccard_join.weight(need) >= jaccard_join.MEETINGS


def test_known_shingles_of_all_slices_do_not_meet_in_one_bucket(spark, monkeypatch):
    """Every slice has the same passage twice; its entries go to buckets by slice, not all to the passage's own."""
    from pyspark.sql import functions as F
    from pyspark.sql.classic.dataframe import DataFrame

    made, real = [], DataFrame.mapInArrow

    def recorded(self, *a, **k):
        made.append(real(self, *a, **k))
        return made[-1]

    monkeypatch.setattr(DataFrame, "mapInArrow", recorded)
    docs = spark.range(32, numPartitions=16).select(F.col("id").alias("row"), F.col("id").alias("doc"), F.concat(F.lit("one two three four five w"), "id").alias("text"))
    sets = jaccard_join.shared_sets(docs, 4, 50)
    per = made[0].filter(F.col("kind") == jaccard_join._KNOWN).groupBy("bucket").count().collect()
    assert sum(r["count"] for r in per) == 16 and max(r["count"] for r in per) <= 8
    assert [(r.n, len(jaccard_join.unpacked_set(r.shared))) for r in sets.collect()] == [(3, 2)] * 32
