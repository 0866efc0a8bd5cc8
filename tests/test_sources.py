"""Binary formats: round trips, faults, conversions."""

from __future__ import annotations

import json
import struct

import numpy as np
import pytest

from vexel.operators import brute, ivf, pq
from vexel.sources import vectors as V

X = np.array([[0, 1, 255], [7, 8, 9], [3, 3, 3], [250, 0, 4]], float)


def frame(spark, x=X):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<float>")


@pytest.mark.parametrize("kind", ["fvecs", "ivecs", "bvecs", "u8bin", "fbin"])
def test_round_trip(spark, tmp_path, kind):
    p = str(tmp_path / f"x.{kind}")
    assert V.write_vectors(frame(spark), p, kind) == 4
    got = V.read_vectors(spark, p, rows=2)
    assert got.rdd.getNumPartitions() == 2
    assert [r.vec for r in got.orderBy("id").collect()] == X.tolist()
    assert V.read_vectors(spark, p, max_n=3).count() == 3
    assert V.shape(p, kind)[:2] == (4, 3)


def test_faults(spark, tmp_path):
    p = tmp_path / "x.fvecs"
    V.write_vectors(frame(spark), str(p), "fvecs")
    data = p.read_bytes()
    p.write_bytes(data[:-1])
    with pytest.raises(Exception, match="multiple"):
        V.read_vectors(spark, str(p)).count()
    p.write_bytes(data[:16] + struct.pack("<i", 2) + data[20:])
    with pytest.raises(Exception, match="another number"):
        V.read_vectors(spark, str(p)).collect()
    u = tmp_path / "x.u8bin"
    V.write_vectors(frame(spark), str(u), "u8bin")
    u.write_bytes(u.read_bytes()[:-4])
    assert V.read_vectors(spark, str(u)).count() == 2  # what is whole of a file that was cut
    f = tmp_path / "x.fbin"
    V.write_vectors(frame(spark), str(f), "fbin")
    f.write_bytes(f.read_bytes()[:-4])
    with pytest.raises(Exception, match="3 of 4 rows"):
        V.read_vectors(spark, str(f)).count()
    e = tmp_path / "e.fvecs"
    e.write_bytes(b"")
    assert V.read_vectors(spark, str(e)).count() == 0


def test_truth_and_conversions(spark, tmp_path):
    b = frame(spark)
    q = b.selectExpr("id as qid", "vec as q")
    t = brute.brute_force_knn(b, q, 3)
    p = str(tmp_path / "t.gt")
    assert V.write_truth(t, p, 3) == 4
    assert sorted(V.read_truth(spark, p, 2).collect()) == sorted((r.qid, r.rank, r.id) for r in t.filter("rank <= 2").collect())
    with pytest.raises(ValueError):
        V.read_truth(spark, p, 9)
    V.write_vectors(b, str(tmp_path / "x.bvecs"), "bvecs")
    assert V.bvecs_to_u8bin(spark, str(tmp_path / "x.bvecs"), str(tmp_path / "x.u8bin")) == 4
    V.write_vectors(frame(spark, X / 2 - 1), str(tmp_path / "x.fbin"), "fbin")
    assert V.fbin_to_u8bin(spark, str(tmp_path / "x.fbin"), str(tmp_path / "y.u8bin")) == (-1.0, 126.5)
    assert V.read_vectors(spark, str(tmp_path / "y.u8bin")).orderBy("id").first().vec == [0, 1, 255]


def test_index_files(spark, tmp_path):
    b = frame(spark, np.random.default_rng(0).normal(size=(40, 5)))
    i = ivf.IVFIndex.build(b, 3, iters=1)
    at = lambda n: str(tmp_path / n)
    V.write_centroids(i.centroids, at("c"))
    assert np.allclose(V.read_centroids(at("c")), i.centroids, atol=1e-6)
    assert V.write_assign(i.lists, at("a")) == 40
    assert sorted(V.read_assign(spark, at("a")).collect()) == sorted((r.id, r.cid) for r in i.lists.collect())
    for m in (5, 2):
        book = pq.train(i, m, bits=3, iters=2)
        V.write_codebook(book.words, at("w"))
        assert all(np.allclose(x, y, atol=1e-6) for x, y in zip(V.read_codebook(at("w")), book.words, strict=True))
        codes = pq.encode(i, book)
        assert V.write_codes(codes, at("k")) == 40
        assert V.read_codes(at("k")).tolist() == [r.codes for r in codes.orderBy("cid", "id").collect()]


def test_results_and_random_rows(spark, tmp_path):
    p = str(tmp_path / "r.csv")
    V.append_csv(p, {"a": 1, "b": 2})
    V.append_csv(p, {"a": 3, "b": 4})
    assert open(p).read().split() == ["a,b", "1,2", "3,4"]
    V.write_metrics(str(tmp_path / "m.json"), {"x": 1})
    assert json.load(open(tmp_path / "m.json")) == {"x": 1}
    r = V.random_vectors(spark, 50, 4, 9)
    assert sorted(r.collect()) == sorted(V.random_vectors(spark, 50, 4, 9).repartition(7).collect())
    assert all(-1 <= v <= 1 for x in r.collect() for v in x.vec)
    assert V.read_rows(r, r.filter("id < 3").select("id")).count() == 3
