"""What must hold when tables grow: ids of any size, vectors that stay where they are, folders of parts, stale indexes."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.operators import brute, evaluation, ivf, kernels, kmeans, layout, pq, quant, updates
from vexel.plans import queries as plans
from vexel.sources import vectors as V

SCHEMA = "id bigint, vec array<float>"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA)


@pytest.fixture(scope="module")
def points():
    return np.random.default_rng(7).normal(size=(90, 6)).round(2)


def asks(df):
    return df.filter("id % 9 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("q"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_query(df):
    return sorted((r.qid, r["rank"], r.id) for r in df.collect())


def test_ids_of_any_size(spark, points):
    """Hashed ids near the ends of 64 bits start and train as small ones do."""
    for first in ((1 << 62) + 11, (1 << 63) - 200, -(1 << 63)):
        b = frame(spark, points, first)
        i = ivf.IVFIndex.build(b, 5, iters=2)
        assert i.centroids.shape == (5, 6) and i.lists.count() == 90
        book = pq.train(i, 3, bits=3, iters=2)
        assert [w.shape for w in book.words] == [(8, 2)] * 3
        assert len(kmeans.balanced_hierarchical(b, 6, 1)) >= 2
        assert kmeans.start_place(first) == b.select(kmeans.start_order(F.lit(first).cast("long")).alias("x")).first().x


def test_sums_meet_as_blocks(spark, points, monkeypatch):
    """However few centroids a block has, the step is that of plain numpy."""
    b, c = frame(spark, points).repartition(5), points[:11].astype(np.float32).astype(float)
    x = points.astype(np.float32).astype(float)
    near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
    want = np.array([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(11)])
    for piece in (8, 100, 8192):
        monkeypatch.setattr(kmeans, "PIECE", piece)
        assert np.allclose(kmeans.lloyd_step(b, c), want, atol=1e-8)
    assert "posexplode" not in plan_of(kmeans.sums(b, c))


def test_trained_words_are_those_of_plain_kmeans(spark, points):
    i = ivf.IVFIndex.build(frame(spark, points), 3, iters=1)
    r = {x.id: np.array(x.res) for x in pq.residuals(i).collect()}
    order = sorted(r, key=lambda k: (kmeans.start_place(k), k))
    x = np.array([r[k] for k in sorted(r)])
    book = pq.train(i, 2, bits=2, iters=3)
    for m in range(2):
        w = np.array([r[k][3 * m : 3 * m + 3] for k in order[:4]])
        for _ in range(3):
            near = ((x[:, None, 3 * m : 3 * m + 3] - w) ** 2).sum(2).argmin(1)
            w = np.array([x[near == k, 3 * m : 3 * m + 3].mean(0) if (near == k).any() else w[k] for k in range(4)])
        assert np.allclose(book.words[m], w, atol=1e-7)
    assert [len(w) for w in pq.train(i, 2, bits=2, iters=1, sample=30).words] == [4, 4]


def test_nearest_prefers_the_first_of_equals():
    r = np.random.default_rng(1)
    c = np.repeat(r.normal(size=(7, 33)), 3, axis=0)
    v = r.normal(size=(200, 33))
    assert (kernels.nearest(v, c)[0] % 3 == 0).all()


def test_deletes_do_not_move_vectors(spark, points):
    b = frame(spark, points)
    i, q = ivf.IVFIndex.build(b, 4, iters=1), asks(b)
    gone = b.filter("id % 4 = 1").select("id")
    lists = i.lists
    few, many, rule = ivf.without(lists, gone), ivf.without(lists, gone, most=3), ivf.without(lists, F.col("id") % 4 == 1)
    assert "BroadcastHashJoin" in plan_of(few) and "hashpartitioning" not in plan_of(few)
    assert "Exchange" not in plan_of(rule) and "hashpartitioning" in plan_of(many)
    assert sorted(few.collect()) == sorted(many.collect()) == sorted(rule.collect())
    assert by_query(i.search(q, 5, 4, deleted=gone)) == by_query(i.search(q, 5, 4, deleted=F.col("id") % 4 == 1)) == by_query(brute.brute_force_knn(b.filter("id % 4 <> 1"), q, 5))
    assert not re.search(r"hashpartitioning\(id", plan_of(i.search(q, 5, 2, deleted=gone)))


def test_rerank_does_not_move_vectors(spark, points, monkeypatch):
    monkeypatch.setattr(pq, "RERANK_BLOCK", 3)
    b = frame(spark, points)
    q = asks(b)
    pairs = q.select("qid").crossJoin(b.select("id")).filter("(qid + id) % 3 = 0").unionByName(q.select("qid", F.lit(5).cast("long").alias("id")))
    got = pq.rerank(pairs, b, q, 6)
    assert not re.search(r"hashpartitioning\(id", plan_of(got)) and "SortMergeJoin" not in plan_of(got)
    assert by_query(got) == by_query(brute.masked_knn(b, pairs.withColumn("slot", F.lit(0)), q, 6))
    assert pq.rerank(pairs, b, q.limit(0), 6).count() == 0


def test_folders_of_parts(spark, tmp_path, points):
    x = np.abs(points * 40).round()
    for kind in ("fvecs", "fbin", "u8bin", "bvecs", "ivecs"):
        for at in (str(tmp_path / f"a.{kind}"), f"file://{tmp_path}/b.{kind}"):
            assert V.write_parts(frame(spark, x).repartition(4), at, kind, rows=17) == 90
            got = V.read_vectors(spark, at, rows=10)
            assert [r.vec for r in got.orderBy("id").collect()] == x.tolist()
            assert [r.id for r in V.read_vectors(spark, at, max_n=40).orderBy("id").collect()] == list(range(40))
    parts = V.parts_of(str(tmp_path / "a.fbin"))
    assert sum(p["n"] for p in parts) == 90 and max(p["n"] for p in parts) <= 17
    (tmp_path / "a.fbin" / "attempt-that-failed.fbin").write_bytes(b"xx")
    assert V.read_vectors(spark, str(tmp_path / "a.fbin")).count() == 90
    assert V.write_parts(frame(spark, x).limit(0), str(tmp_path / "none.fbin"), "fbin") == 0
    assert V.read_vectors(spark, str(tmp_path / "none.fbin")).count() == 0


def test_dumps_become_an_index(spark, tmp_path, points):
    b = frame(spark, points)
    i, at = ivf.IVFIndex.build(b, 4, iters=1), lambda n: f"file:{tmp_path}/{n}"
    V.write_vectors(b, at("x.fbin"), "fbin")
    V.write_centroids(i.centroids, at("c"))
    V.write_assign(i.lists, at("a"))
    j = ivf.IVFIndex.from_files(spark, at("x.fbin"), at("c"), at("a"))
    assert by_query(j.search(asks(b), 4, 4)) == by_query(i.search(asks(b), 4, 4))
    assert sorted((r.id, r.cid) for r in j.lists.collect()) == sorted((r.id, r.cid) for r in i.lists.collect())
    with pytest.raises(Exception, match="ids beyond"):
        V.with_assign(spark.range(91), at("a")).collect()
    with pytest.raises(FileNotFoundError):
        V.size_of(at("nothing"))


def test_stale_indexes_are_built_anew(spark, tmp_path, points):
    source, at, built = str(tmp_path / "s"), str(tmp_path / "i"), []

    def build():
        built.append(1)
        return ivf.IVFIndex.build(spark.read.parquet(source), 3, iters=1)

    frame(spark, points).write.parquet(source)
    assert [ivf.IVFIndex.cached(spark, at, source, build)[1] for _ in range(2)] == [True, False]
    os.utime(next((tmp_path / "s").glob("*.parquet")), (1, 1))
    assert ivf.IVFIndex.cached(spark, at, source, build)[1] and len(built) == 2
    names = ivf.IndexCatalog()
    assert [names.load(spark, "x", at) for _ in range(2)] == [True, False]


def test_block_sizes_from_counts(spark):
    r = np.random.default_rng(5)
    for sizes in ([0, 0, 7], [5], [], *(r.integers(0, 400, 12).tolist() for _ in range(3))):
        info = spark.createDataFrame(list(enumerate(sizes)), "cid int, count bigint")
        for ratio in (0.0, 0.05, 0.3):
            want = layout.compute_bcs(sizes, ratio, base=10)
            assert layout.choose_bcs(info, ratio, base=10) == want
            ok = [b for b in range(10, max(10, sum(sizes) // max(1, len(sizes)) // 10 * 10) + 1, 10) if fits(sizes, b, ratio)]
            assert want == max(ok, default=10)


def fits(sizes, size, ratio):
    pieces = [min(size, s - a) for s in sizes for a in range(0, s, size)]
    return (np.std(pieces, ddof=1) if len(pieces) > 1 else 0.0) <= ratio * size or len(pieces) > 11 * len(sizes)


def test_one_search_for_each_state(spark, points, monkeypatch):
    b = frame(spark, points)
    i, q = ivf.IVFIndex.build(b, 3, iters=1), b.select(F.col("id").alias("qid"), F.col("vec").alias("q"))
    delta = updates.delta_segment(spark.createDataFrame([(k, [float(v) for v in points[k] + 0.01]) for k in range(9)], "local_id bigint, vec array<float>"), i, 90)
    searches, real = [], updates.overlay_search
    monkeypatch.setattr(updates, "overlay_search", lambda *a, **k: searches.append(1) or real(*a, **k))
    events = updates.mixed_events(90, 10, 9, 0.4, 2, rounds=2, seed=3)
    got = updates.replay(events, i, b, q, delta, 3, 3, 90)
    assert len(searches) <= 5 < sum(e.kind == "query" for e in events)
    rows, ratio = 0, 0.0
    for e in events:
        rows, ratio = e.insert_to or rows, e.delete_to or ratio
        if e.kind == "query":
            live = b.join(updates.tombstones(b, ratio), "id", "left_anti").unionByName(delta.filter(F.col("id") < 90 + rows).select("id", "vec"))
            want = brute.brute_force_knn(live, q.filter(F.col("qid").between(e.qb, e.qb + e.qn - 1)), 3)
            assert by_query(got.filter(F.col("seq") == e.seq)) == by_query(want)
    assert updates.replay([], i, b, q, delta, 3, 3, 90).count() == 0


def test_timed_grid_gives_result_rows(spark, tmp_path, points):
    b = frame(spark, points)
    i, q = ivf.IVFIndex.build(b, 3, iters=1), asks(b)
    delta = updates.delta_segment(spark.createDataFrame([(0, [0.0] * 6)], "local_id bigint, vec array<float>"), i, 90)
    at = str(tmp_path / "grid.csv")
    for row in updates.timed_grid(i, q, delta, [(0, 0.0), (1, 0.5)], [4, 100], [1], 2, 90):
        V.append_csv(at, row)
    lines = open(at).read().splitlines()
    assert lines[0] == "inserts,deletes,batch,nprobe,k,queries,total_ms,qps" and len(lines) == 5
    assert all(float(x.split(",")[-1]) > 0 for x in lines[1:])


def test_bytes_and_centred_halves(spark, points):
    b = frame(spark, points)
    z = quant.Fp16Centred().train(b)
    assert np.allclose(z.zero, points.astype(np.float32).mean(0), atol=1e-6)
    back = z.decode(z.encode(b)).orderBy("id").collect()
    assert np.allclose([r.decoded for r in back], points, atol=2e-3)
    u, q = quant.MinMaxU8().train(b), asks(b)
    i = ivf.IVFIndex.build(b, 4, iters=1)
    codes = {r.id: np.array(r.codes) for r in u.encode(b).collect()}
    for r in i.search_bytes(u, q, 5, 4, F.col("id") == 3).collect():
        assert r.dist == ((codes[r.qid] - codes[r.id]) ** 2).sum() and r.id != 3


def test_counts_of_probes(spark, points):
    i = ivf.IVFIndex.build(frame(spark, points), 4, iters=1)
    info = layout.cluster_info(i.lists, 4)
    got = evaluation.probe_counts(i.route(asks(i.lists), 4), info, 7).collect()
    chunks = sum(-(-r["count"] // 7) for r in info.collect())
    assert all((r.lists, r.chunks, r.rows) == (4, chunks, 90) for r in got) and len(got) == 10


def test_no_machine_folder_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        sparkContext = type("C", (), {"master": "spark://host:7077"})
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        plans.shared(Elsewhere)


def test_manifest_is_json(spark, tmp_path, points):
    V.write_parts(frame(spark, points), str(tmp_path / "m.fbin"), "fbin")
    assert {"name", "n"} == set(json.loads((tmp_path / "m.fbin" / V.MANIFEST).read_text())[0])


def test_joined_codes_are_added_in_order(spark):
    """The join form adds up subspaces from first to last: to the last bit, whatever the shuffle does."""
    x = np.random.default_rng(3).normal(size=(300, 12))
    b = frame(spark, x)
    i = ivf.IVFIndex.build(b, 3, iters=1)
    book = pq.sampled_codebook(i, 12, 4)
    codes, q = pq.encode(i, book), asks(b)
    of = {r.id: (r.cid, r.codes) for r in codes.collect()}
    asked = {r.qid: np.array(r.q, float) for r in q.collect()}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = pq.adc_sql(codes, i, book, q, i.route(q, 3), 40).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for r in found:
        cid, code = of[r.id]
        d = 0.0
        for m, w in enumerate(code):
            off = float(asked[r.qid][m] - i.centroids[cid][m] - book.words[m][w][0])
            d += off * off
        assert d == r.dist


@pytest.mark.parametrize("name", ["l2_distance", "cosine_distance", "u8_l2", "select_k_largest", "knn_l2_sql", "sql_functions"])
def test_no_lambda_over_all_pairs(spark, name):
    """Pairs of all rows and queries are not measured one by one in interpreted lambdas."""
    plan = plan_of(plans.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_all_pairs_are_those_of_columns(spark, points, monkeypatch):
    from vexel.functions import vector

    monkeypatch.setattr(brute, "PAIRS", (3, 7))
    x = np.vstack([points, np.zeros((1, 6))])
    b = frame(spark, x)
    q = asks(b)
    got = brute.all_pairs(b, q, {"l": "l2", "i": "ip", "n": "norm", "c": "cosine"}, block=4)
    want = b.crossJoin(q).select("qid", "id", vector.l2_distance("q", "vec"), vector.inner_product("q", "vec"), vector.l2_norm("vec"), vector.cosine_distance("q", "vec"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_likely_pairs_hold_all_ties(spark):
    """Copies tie; of them the least ids are found by both forms, and by odd vectors as by columns alone."""
    b = frame(spark, np.repeat(np.random.default_rng(5).normal(size=(12, 6)), 9, axis=0))
    q = asks(b)
    assert by_query(brute.brute_force_knn(b, q, 5, impl="sql")) == by_query(brute.brute_force_knn(b, q, 5))
    odd = b.unionByName(spark.createDataFrame([(900, None), (901, [1.0]), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0])], SCHEMA))
    assert by_query(brute.brute_force_knn(odd, q, 5, impl="sql")) == by_query(brute.brute_force_knn(b, q, 5))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_likely_pairs_do_not_grow_with_batches(spark, metric, monkeypatch):
    """However many batches the rows are dealt to, a query's bound is that of all rows, and k pairs are within it."""
    monkeypatch.setattr(brute, "PACKED", 15)
    b = frame(spark, np.random.default_rng(3).normal(size=(600, 6)))
    q = asks(b)
    want = by_query(brute.brute_force_knn(b, q, 5, metric))
    for parts in (1, 40):
        dealt = b.repartition(parts)
        assert brute.likely(dealt, q, 5, metric, block=30).count() == 5 * q.count()
        assert by_query(brute.brute_force_knn(dealt, q, 5, metric, impl="sql", block=30)) == want


def test_likely_pairs_of_copies_do_not_multiply(spark):
    """Of many copies of a vector in a batch, the k least ids are measured with each query that is one of them."""
    x = np.random.default_rng(3).normal(size=(600, 6))
    x[::3] = x[0]
    b = frame(spark, x[::-1], -299).coalesce(1)
    q = asks(b)
    assert brute.likely(b, q, 5, "l2").count() == 5 * q.count()
    for alone in (False, True):
        assert by_query(brute.brute_force_knn(b, q, 5, impl="sql", exclude_self=alone)) == by_query(brute.brute_force_knn(b, q, 5, exclude_self=alone))


def test_likely_pairs_hold_what_products_cannot_measure(spark):
    """Vectors whose squares overflow, that are not finite or very small: the answers are those of columns alone."""
    from vexel.functions.vector import distance
    from vexel.operators.topk import topk

    x = np.random.default_rng(4).normal(size=(80, 3))
    x[:20] *= 1e-9
    x[20:30] = [[0, 0, z * 1e153] for z in range(4, 14)]
    x[30], x[31], x[36] = [np.nan, 0, 0], [np.inf, 0, 0], [np.nan, 1, 1]
    b = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<double>").repartition(4)
    q = asks(b)
    alone = topk(b.crossJoin(q).select("qid", "id", distance("l2", "q", "vec").alias("dist")), 3)
    assert by_query(brute.brute_force_knn(b, q, 3, impl="sql")) == by_query(alone)
    small = b.filter("id < 20")
    assert brute.likely(small, asks(small), 3, "l2").count() == 3 * asks(small).count()


def test_lists_are_joined_without_all_their_pairs(spark, points, monkeypatch):
    """The equi-join form measures in columns what groups of a list's rows and queries leave, whatever their sizes."""
    b = frame(spark, points)
    i, q = ivf.IVFIndex.build(b, 4, iters=1), asks(b)
    probes = i.route(q, 3)
    want = by_query(ivf.scan(i.lists, probes, q, 5))
    for asking, listed in ((4096, 32768), (3, 2)):
        monkeypatch.setattr(ivf, "ASKING", asking)
        monkeypatch.setattr(ivf, "LISTED", listed)
        found = ivf.scan(i.lists, probes, q, 5, impl="sql")
        assert "inline(" not in plan_of(found) and "CoGroups" in plan_of(found)
        assert by_query(found) == want


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_masked_candidates_do_not_pull_vectors(spark, points, monkeypatch, metric):
    """Repeated, masked and unknown candidates; candidates go packed, and no vector is joined to each of them."""
    from vexel.operators.topk import topk
    from vexel.functions.vector import distance

    monkeypatch.setattr(brute, "MASKED", 20)
    b = frame(spark, points)
    q = asks(b)
    slots = b.select("id").crossJoin(q.select("qid")).select("qid", F.when((F.col("id") + F.col("qid")) % 3 == 0, -1).otherwise(F.col("id")).alias("id"))
    slots = slots.unionByName(slots.filter("id % 2 = 0")).unionByName(slots.limit(3).withColumn("id", F.lit(7777).cast("long")))
    found = brute.masked_knn(b, slots, q, 5, metric)
    assert "CoGroups" in plan_of(found) and "SortMergeJoin" not in plan_of(found)
    pairs = b.crossJoin(q).filter("(id + qid) % 3 <> 0").select("qid", "id", distance(metric, "q", "vec").alias("dist"))
    assert by_query(found) == by_query(topk(pairs, 5))


def test_candidates_are_computed_once(spark, points):
    """The rerank goes block by block of queries, but asks for its candidates once; the best codes are those of all pairs."""
    b = frame(spark, points)
    i, q = ivf.IVFIndex.build(b, 3, iters=1), asks(b)
    book = pq.sampled_codebook(i, 3, 8)
    probes, codes = i.route(q, 2), pq.encode(i, book)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for x in batches:
            seen.add(x.num_rows)
            yield x

    with pytest.MonkeyPatch.context() as m:
        m.setattr(pq, "RERANK_BLOCK", 2)
        found = pq.adc(codes, i, book, q, probes, 7)
        got = by_query(pq.rerank(found.mapInArrow(count, found.schema), b, q, 3))
    assert seen.value == found.count() == 7 * q.count() and len(got) > 2
    assert by_query(found) == by_query(pq.adc_sql(codes, i, book, q, probes, 7))
