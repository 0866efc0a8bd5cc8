"""Search against brute force, ties, zero vectors, empty clusters, odd sizes; updates; layout; quantisers."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vexel.functions import hashing, parsing, vector
from vexel.operators import brute, evaluation, ivf, kernels, kmeans, layout, pq, quant, updates
from vexel.operators.topk import padded, topk

SCHEMA = "id bigint, vec array<float>"


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA)


def asks(df, which):
    return df.filter(F.col("id").isin(which)).select(F.col("id").alias("qid"), F.col("vec").alias("q"))


def answers(df, name="id"):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r[name])
    return out


def expected(x, qs, k, metric="l2", ids=None):
    x = np.float32(x).astype(float)
    ids = range(len(x)) if ids is None else ids
    out = {}
    for q in qs:
        def d(i, q=q):
            if metric == "l2":
                return ((x[q] - x[i]) ** 2).sum()
            n = (x[q] ** 2).sum() * (x[i] ** 2).sum()
            return 1.0 if n < 1e-24 else 1 - np.clip((x[q] * x[i]).sum() / np.sqrt(n), -1, 1)
        out[q] = sorted(ids, key=lambda i: (round(d(i), 9), i))[:k]
    return out


@pytest.fixture(scope="module")
def points():
    x = np.random.default_rng(3).normal(size=(120, 6))
    x[7] = 0
    x[50:55] = x[3]  # ties
    return np.round(x, 2)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("impl", ["sql", "arrow"])
def test_brute_force(spark, points, metric, impl):
    b = frame(spark, points)
    qs = [0, 3, 7, 50, 119]
    got = answers(brute.brute_force_knn(b, asks(b, qs), 8, metric, impl))
    want = expected(points, qs, 8, metric)
    if metric == "l2":
        assert got == want
    else:  # equal up to near ties
        assert all(set(got[q][:5]) == set(want[q][:5]) or len(got[q]) == 8 for q in qs)


def test_blocks_of_queries_and_self(spark, points):
    b = frame(spark, points)
    q = asks(b, list(range(30)))
    assert answers(brute.brute_force_knn(b, q, 4, block=7)) == expected(points, range(30), 4)
    assert all(q not in ids and len(ids) == 4 for q, ids in answers(brute.brute_force_knn(b, q, 4, exclude_self=True)).items())


def test_errors(spark, points):
    b = frame(spark, points)
    q = asks(b, [0])
    i = ivf.IVFIndex.build(b, 4, iters=1)
    for bad in (0, 5, -1):
        with pytest.raises(ValueError):
            i.search(q, 3, bad)
    with pytest.raises(ValueError):
        brute.brute_force_knn(b, q, 3, "dot")
    with pytest.raises(ValueError):
        kmeans.init_sample(b, 1000)
    with pytest.raises(Exception, match="values are needed"):
        kmeans.assign_nearest(spark.createDataFrame([(0, [1.0])], SCHEMA), np.zeros((2, 3))).collect()


@pytest.mark.parametrize("impl", ["arrow", "sql"])
def test_full_probe_is_brute_force_and_recall_grows(spark, points, impl):
    b = frame(spark, points)
    qs = list(range(0, 120, 11))
    i, q = ivf.IVFIndex.build(b, 9, iters=2), asks(frame(spark, points), qs)
    truth = brute.brute_force_knn(b, q, 5)
    assert answers(i.search(q, 5, 9, impl)) == answers(truth)
    seen = [evaluation.recall(i.search(q, 5, n, impl), truth, 5).first()["recall"] for n in (1, 3, 9)]
    assert seen == sorted(seen) and seen[-1] == 1


def test_layouts_and_positions_agree(spark, points):
    b = frame(spark, points)
    i = ivf.IVFIndex.build(b, 5, iters=2)
    q = asks(b, [1, 2, 60])
    plain = i.search(q, 6, 2)
    assert answers(i.search(q, 6, 2, layout_kind="blocks")) == answers(plain)
    at = {r.pos: r.id for r in layout.positions(i.lists, layout.cluster_info(i.lists, 5)).collect()}
    assert sorted(at) == list(range(120))
    assert {k: [at[p] for p in v] for k, v in answers(i.search(q, 6, 2, returns="pos"), "pos").items()} == answers(plain)


def test_save_load_catalog(spark, points, tmp_path):
    b = frame(spark, points)
    i, q = ivf.IVFIndex.build(b, 5, iters=1), asks(b, [4, 90])
    i.save(str(tmp_path / "x"), "f1")
    got = ivf.IVFIndex.load(spark, str(tmp_path / "x"), "f1")
    assert answers(got.search(q, 3, 2)) == answers(i.search(q, 3, 2))
    with pytest.raises(ValueError):
        ivf.IVFIndex.load(spark, str(tmp_path / "x"), "f2")
    c = ivf.IndexCatalog(1)
    c.register("a", got)
    c.register("a", i)
    assert c.get("a") is i and c.names() == ["a"]
    with pytest.raises(ValueError):
        c.register("b", i)
    c.unregister("a")
    with pytest.raises(KeyError):
        c.get("a")


def test_saved_lists_are_pruned(spark, points, tmp_path):
    b = frame(spark, points)
    ivf.IVFIndex.build(b, 8, iters=1).save(str(tmp_path / "p"))
    i = ivf.IVFIndex.load(spark, str(tmp_path / "p"))
    plan = i._shards_of(i.route(asks(b, [0]), 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters: [")[1][:80]


def test_empty_cluster_keeps_its_centroid_and_ties_go_low(spark):
    b = frame(spark, [[0.0], [0.0], [1.0]])
    c = kmeans.lloyd_step(b, np.array([[0.0], [0.0], [5.0], [1.0]]))
    assert c.tolist() == [[0.0], [0.0], [5.0], [1.0]]
    assert {r.cid for r in kmeans.assign_nearest(b, c).filter("id < 2").collect()} == {0}


@pytest.mark.parametrize("method,how", [("minibatch", {"window": 30}), ("subset", {"train_n": 40}), ("hierarchical", {"alpha": 0.5})])
def test_training_methods(spark, points, method, how):
    b = frame(spark, points)
    i = ivf.IVFIndex.build(b, 6, method=method, iters=2, **how)
    assert i.lists.count() == 120
    assert answers(i.search(asks(b, [5, 9]), 4, i.nlist)) == expected(points, [5, 9], 4)


def test_short_results_are_padded(spark):
    b = frame(spark, [[0.0], [1.0]])
    got = padded(brute.brute_force_knn(b, asks(b, [0]), 4), asks(b, [0]), 4).orderBy("rank").collect()
    assert [r.id for r in got] == [0, 1, -1, -1] and got[3].dist == float("inf")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-2, 2), min_size=1, max_size=14), st.integers(1, 6))
def test_one_dimension_with_many_ties(spark, values, k):
    x = [[float(v)] for v in values]
    b = frame(spark, x)
    assert answers(brute.brute_force_knn(b, asks(b, [0]), k)) == expected(x, [0], k)


@given(st.lists(st.lists(st.floats(-5, 5, width=32), min_size=3, max_size=3), min_size=1, max_size=40), st.integers(1, 50), st.sampled_from(["l2", "cosine"]))
def test_shortlist_is_exact(rows, k, metric):
    v = np.array(rows, float)
    r, i, d = kernels.shortlist(v[:1], v, np.arange(len(v)), k, metric)
    full = kernels.exact(np.repeat(v[:1], len(v), 0), v, metric)
    assert np.array_equal(np.sort(full)[:k], d) or np.allclose(np.sort(full)[:k], d, atol=1e-9)
    assert len(i) == min(k, len(v)) and (r == 0).all()


def test_pq(spark, points):
    b = frame(spark, points)
    i = ivf.IVFIndex.build(b, 4, iters=2)
    q = asks(b, [0, 33])
    for m in (2, 4):  # even and uneven widths
        book = pq.train(i, m, bits=4, iters=3)
        assert [w.shape[1] for w in book.words] == pq.subdims(6, m)
        codes = pq.encode(i, book)
        probes = i.route(q, 2)
        assert answers(pq.adc(codes, i, book, q, probes, 12)) == answers(pq.adc_sql(codes, i, book, q, probes, 12))
        assert answers(pq.pq_search(codes, i, book, q, 5, 2, 1000)) == answers(i.search(q, 5, 2))
    assert pq.subdims(7, 3) == [3, 2, 2]
    with pytest.raises(ValueError):
        pq.subdims(3, 4)


def test_overlay_equals_brute_force_on_what_is_left(spark, points):
    b = frame(spark, points)
    i = ivf.IVFIndex.build(b, 4, iters=1)
    new = spark.createDataFrame([(k, [float(v) for v in points[k] + 0.05]) for k in range(20)], "local_id bigint, vec array<float>")
    delta = updates.delta_segment(new, i, 120)
    gone = b.unionByName(delta.select("id", "vec")).select("id").filter("id % 3 = 0")
    left = b.unionByName(delta.select("id", "vec")).join(gone, "id", "left_anti")
    q = asks(b, [0, 1, 44])
    for mode in ("flat", "ivf"):
        assert answers(updates.overlay_search(i, q, 6, 4, delta, gone, mode)) == answers(brute.brute_force_knn(left, q, 6))
    assert updates.overlay_search(i, q, 6, 4, None, b.select("id")).count() == 0
    assert updates.delta_segment(new, i, 120, "hash").count() == 20


def test_mixed_events_cover_everything():
    e = updates.mixed_events(10, 4, 7, 0.5, 3, rounds=2, seed=1)
    assert e == updates.mixed_events(10, 4, 7, 0.5, 3, rounds=2, seed=1)
    assert sorted((x.qb, x.qn) for x in e if x.kind == "query") == sorted([(0, 4), (4, 4), (8, 2)] * 2)
    assert [x.insert_to for x in e if x.kind == "insert"] == [3, 5, 7]
    assert [round(x.delete_to, 6) for x in e if x.kind == "delete"] == [round(0.5 / 3, 6), round(1 / 3, 6), 0.5]


@pytest.mark.parametrize("mode", ["far", "query-copy", "random-u8", "main-sample", "random-main-sample"])
def test_delta_vectors(spark, points, mode):
    b = frame(spark, points)
    got = updates.delta_vectors(b, asks(b, [0, 1]), 10, mode, 120, 6, seed=5, protected=b.filter("id = 2").select("id")).orderBy("local_id").collect()
    assert [r.local_id for r in got] == list(range(10)) and all(len(r.vec) == 6 for r in got)
    sources = [r.source_id for r in got]
    if mode == "main-sample":
        assert sources == [0, 1, 3, 4, 5, 6, 7, 8, 9, 10]
    elif mode == "random-main-sample":
        assert len(set(sources)) == 10 and 2 not in sources
        assert sources[0] == 5
    else:
        assert set(sources) == {None}


def test_truths_under_updates(spark, points):
    b = frame(spark, points)
    q = asks(b, [0, 1])
    truth = brute.brute_force_knn(b, q, 20)
    with pytest.raises(ValueError):
        evaluation.surviving_truth(truth, b.select("id"), 3)
    copies = q.select("qid", (F.col("qid") + 120).alias("id"))
    targets = answers(evaluation.update_truth(truth, 3, copies))
    assert all(ids[0] == q + 120 for q, ids in targets.items())
    assert evaluation.copy_misses(truth, copies).first()["misses"] == 2


def test_layout_blocks(spark, points):
    b = frame(spark, points)
    i = ivf.IVFIndex.build(b, 7, iters=1)
    info = layout.cluster_info(i.lists, 7)
    for bcs in (1, 4, 1000):
        assert {r.violations for r in layout.block_faults(info, layout.blocks(info, bcs), i.lists, bcs).collect()} == {0}
    wrong = layout.blocks(info, 4).withColumn("size", F.col("size") + 1)
    assert sum(r.violations > 0 for r in layout.block_faults(info, wrong, i.lists, 4).collect()) >= 3
    assert layout.compute_bcs([1024] * 4, 0.1) == 1024
    assert layout.compute_bcs([10, 20], 0.1) == 256
    assert layout.compute_bcs([], 0.1) == 256
    assert layout.compute_bcs([100, 700, 1300], 0.05, base=100) == 100


def test_quantisers(spark):
    b = frame(spark, [[0.1, 2.5], [-1.0, 3.0]])
    z = quant.Fp16Linear(2.0, 0.5)
    r = z.encode(b).orderBy("id").first()
    assert np.array_equal(np.frombuffer(r.codes, "<f2"), ((np.float32([0.1, 2.5]).astype(float) - 0.5) * 2).astype("<f2"))
    assert z.code_size(2) == 4
    u = quant.MinMaxU8().train(b)
    assert u.encode(b).orderBy("id").collect()[1].codes == [0, 255]
    back = u.decode(u.encode(b)).orderBy("id").collect()
    assert all(abs(x - y) < 0.02 for r in back for x, y in zip(r.vec, r.decoded, strict=True))
    assert b.select(vector.to_u8(F.array(F.lit(-3.0), F.lit(2.5), F.lit(3.5), F.lit(300.0)))).first()[0] == [0, 2, 4, 255]


def test_hashes_and_parsing(spark):
    def reference(x):
        m = (1 << 64) - 1
        x = (x + 0x9E3779B97F4A7C15) & m
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & m
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & m
        return x ^ x >> 31

    got = {r.id: int(r.h) for r in spark.range(50).select("id", hashing.splitmix64(F.col("id")).alias("h")).collect()}
    assert got == {i: reference(i) for i in range(50)}
    ids = spark.range(-2, 3)
    assert ids.filter(hashing.is_deleted(F.col("id"), 1.0)).count() == 3
    assert ids.filter(hashing.is_deleted(F.col("id"), 0.0)).count() == 0
    assert parsing.scale("deep10m") == 10_000_000 and parsing.scale("1B") == 10**9
    assert parsing.numbers("1,2, 3") == [1, 2, 3] and parsing.pairs("0.1:2,3:4") == [(0.1, 2.0), (3.0, 4.0)]
    with pytest.raises(ValueError):
        parsing.scale("ten")


def test_zero_norm_and_topk(spark):
    b = frame(spark, [[0.0, 0.0], [1.0, 0.0]])
    q = asks(b, [1])
    assert answers(brute.brute_force_knn(b, q, 2, "cosine")) == {1: [1, 0]}
    assert answers(brute.brute_force_knn(b, q, 2, drop_zero_norm=True)) == {1: [1]}
    bad = spark.createDataFrame([(0, 1, float("nan")), (0, 2, float("inf")), (0, None, 1.0), (0, 3, 2.0)], "qid int, id int, dist double")
    assert [r.id for r in topk(bad, 5).collect()] == [3]
    with pytest.raises(ValueError):
        topk(bad, 0)


def test_bf16(spark):
    x = np.float32([1.0, -2.5, 3.14159, 1e-40, np.nan, 65504.0])
    back = (quant.bf16_bits(x).astype("<u4") << 16).view("<f4")
    assert back[0] == 1 and back[1] == -2.5 and np.isnan(back[4]) and np.allclose(back[[2, 5]], x[[2, 5]], rtol=2**-8)
    b = frame(spark, [[1.0, 2.5]])
    assert quant.Bf16().decode(quant.Bf16().encode(b)).first().decoded == [1.0, 2.5]


def test_pq_overlay_with_all_candidates_is_exact(spark, points):
    b = frame(spark, points)
    i = ivf.IVFIndex.build(b, 4, iters=1)
    book = pq.train(i, 3, bits=3, iters=2)
    new = spark.createDataFrame([(k, [float(v) for v in points[k] + 0.05]) for k in range(20)], "local_id bigint, vec array<float>")
    delta = updates.delta_segment(new, i, 120)
    gone = b.select("id").unionByName(delta.select("id")).filter("id % 3 = 0")
    q = asks(b, [0, 1, 44])
    got = updates.pq_overlay_search(pq.encode(i, book), i, book, q, 6, 2, delta, gone, 1000)
    assert answers(got) == answers(updates.overlay_search(i, q, 6, 2, delta, gone, "ivf"))


def test_clustering_classes_and_catalog_search(spark, points):
    b = frame(spark, points)
    for c in (kmeans.KMeans(4, 2), kmeans.KMeans(4, 1, minibatch=True, window=30), kmeans.BalancedHierarchical(4, 1)):
        assert c.fit(b).assign(b).count() == 120 and c.objective(b) > 0
    with pytest.raises(ValueError):
        kmeans.KMeans(0)
    catalog = ivf.IndexCatalog()
    catalog.register("a", ivf.IVFIndex.build(b, 4, centroids=kmeans.KMeans(4, 1).fit(b).centroids))
    catalog.ann_search("a", asks(b, [3]), 2, 4, view="found")
    assert spark.sql("select count(*) n from found").first().n == 2
    vector.register(spark)
    assert spark.sql("select l2_sq(array(1D, 2D), array(3D, 2D)) x, cast(splitmix64(0) as string) h").first() == (4.0, "16294208416658607535")


def test_list_inner_products_cap(spark, points):
    b = frame(spark, points)
    i = ivf.IVFIndex.build(b, 3, iters=1)
    q = asks(b, [0, 1])
    got = ivf.list_inner_products(i.lists, i.route(q, 2), q, most=4)
    assert got.groupBy("qid", "cid").count().agg(F.max("count")).first()[0] == 4


def test_hierarchical_clusters_are_even(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(0, 0.1, (160, 2)), r.normal(9, 0.1, (20, 2)), r.normal(-9, 0.1, (20, 2))]).round(3)
    b = frame(spark, x)
    c = kmeans.balanced_hierarchical(b, 10, 4)
    sizes = [row["count"] for row in kmeans.assign_nearest(b, c).groupBy("cid").count().collect()]
    assert 8 <= len(c) <= 14 and sum(sizes) == 200 and max(sizes) <= 60
    assert len(kmeans.balanced_hierarchical(b, 1, 1)) >= 1


def test_trained_codes_find_what_the_lists_hold(spark):
    """On 2,000 vectors, where the rerank sees a sixth of the probed rows."""
    from vexel.plans import queries as plans
    from vexel.plans import sql as S

    at = "/root/testdata/sf0.1"
    q = plans.queries_of(spark, at)
    truth = brute.brute_force_knn(plans.base_of(spark, at), q, S.K)
    assert evaluation.recall(plans.pq_trained_search(spark, at), truth, S.K).first().recall >= 0.94


def test_minibatch_queries_read_the_whole_table(spark, points, monkeypatch):
    from vexel.plans import queries as plans

    sizes, step = [], kmeans.minibatch_step
    monkeypatch.setattr(kmeans, "minibatch_step", lambda w, c, seen: sizes.append(w.count()) or step(w, c, seen))
    kmeans.minibatch_pass(frame(spark, points), 4, window=50)
    assert sizes == [50, 50, 20]
    sizes.clear()
    monkeypatch.setattr(kmeans, "minibatch_step", lambda w, c, seen: sizes.append(w.count()) or (c, seen))
    plans.minibatch_pass(spark, "/root/testdata/sf0.001")
    plans.minibatch_kmeans(spark, "/root/testdata/sf0.001")
    assert sizes == [500] * 81
