"""Residual product quantisation: subspaces, codebooks, codes, asymmetric distances, exact rerank."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.functions.vector import distance
from vexel.operators.ivf import IVFIndex
from vexel.operators.kernels import candidates, exact, matrix, nearest
from vexel.operators.kmeans import DIGITS, added, start_order, start_place
from vexel.operators.topk import topk

#: Residuals that training reads at most (its documented sample).
SAMPLE = 4_000_000
RERANK = 512
#: Queries whose candidates travel at once: with RERANK candidates each, some 8 MB.
RERANK_BLOCK = 1024
#: Queries whose best codes a task holds, those of them that are asked at once, and pairs that are measured at once.
ADC_BLOCK, ASKED, PAIRS = 4096, 256, 1 << 16


def subdims(dim: int, m: int) -> list[int]:
    """Widths of m subspaces; the first dim % m are wider by one."""
    if not 0 < m <= dim:
        raise ValueError(f"{m} subspaces of {dim} values")
    return [dim // m + (i < dim % m) for i in range(m)]


@dataclass
class Codebook:
    """words[m]: [K, width of subspace m]."""

    words: list[np.ndarray]

    @property
    def edges(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([w.shape[1] for w in self.words])])

    @property
    def m(self) -> int:
        return len(self.words)

    def encode(self, x: np.ndarray) -> np.ndarray:
        e = self.edges
        return np.stack([nearest(x[:, e[i] : e[i + 1]], w)[0] for i, w in enumerate(self.words)], axis=1).astype(np.uint8 if len(self.words[0]) <= 256 else np.int16)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], axis=1)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of a residual query to every word: [m, K]."""
        e = self.edges
        return np.stack([((w - x[e[i] : e[i + 1]]) ** 2).sum(1) for i, w in enumerate(self.words)])

    def measured(self, q: np.ndarray, centroids: np.ndarray, r: np.ndarray, cid: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of pairs: query r with a row of list cid and these codes; as tables() has them, added up
        from the first subspace to the last."""
        e, out = self.edges, np.zeros(len(r))
        for a in range(0, len(r), PAIRS):
            rest = q[r[a : a + PAIRS]] - centroids[cid[a : a + PAIRS]]
            for i, w in enumerate(self.words):
                code, x = codes[a : a + PAIRS, i], rest[:, e[i] : e[i + 1]]
                if w.shape[1] < 8:  # few values: sum() takes them one after the other, too
                    out[a : a + PAIRS] += reduce(np.add, ((w[:, j][code] - x[:, j]) ** 2 for j in range(w.shape[1])))
                else:
                    out[a : a + PAIRS] += ((w[code] - x) ** 2).sum(1)
        return out

    def frame(self, spark) -> DataFrame:
        rows = [(i, c, w[c].tolist()) for i, w in enumerate(self.words) for c in range(len(w))]
        return spark.createDataFrame(rows, "m int, code int, cw array<double>")

    @classmethod
    def of(cls, df: DataFrame) -> Codebook:
        words: dict[int, list] = {}
        for r in df.orderBy("m", "code").collect():
            words.setdefault(r.m, []).append(r.cw)
        return cls([np.array(words[i], np.float64) for i in sorted(words)])


def residuals(index: IVFIndex) -> DataFrame:
    """id, cid, res. The centroids come along in the task; nothing is joined."""
    shared = index.lists.sparkSession.sparkContext.broadcast(index.centroids)

    def work(batches):
        c = shared.value
        for b in batches:
            r = matrix(b.column(2), c.shape[1]) - c[b.column(1).to_numpy()] if b.num_rows else np.empty((0, c.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(r.ravel()), c.shape[1]).cast(pa.list_(pa.float64()))], names=["id", "cid", "res"])

    return index.lists.select(F.col("id").cast("long").alias("id"), "cid", "vec").mapInArrow(work, "id bigint, cid int, res array<double>")


def sampled_codebook(index: IVFIndex, m: int, k: int, seed: int = 0) -> Codebook:
    """Words are the residuals of the first k ids in the hash order: training of no iteration."""
    return _first_words(residuals(index), m, k, seed)


def _first_words(rows: DataFrame, m: int, k: int, seed: int) -> Codebook:
    rows = rows.orderBy(start_order(F.col("id"), seed), "id").limit(k).collect()
    if len(rows) < k:
        raise ValueError(f"{k} words need as many rows")
    x = np.array([r.res for r in sorted(rows, key=lambda r: (start_place(r.id, seed), r.id))])
    e = np.concatenate([[0], np.cumsum(subdims(x.shape[1], m))])
    return Codebook([x[:, e[i] : e[i + 1]] for i in range(m)])


def train(index: IVFIndex, m: int, bits: int = 8, iters: int = 25, seed: int = 0, sample: int = SAMPLE) -> Codebook:
    """k-means in all subspaces at once: one pass over the residuals for each iteration, in which every task adds up its
    own rows by subspace and word, and only these sums meet. Words start as the first residuals in the hash order; one
    that no row is nearest to stays. Beyond `sample` residuals about so many are read, chosen by a hash of their ids."""
    rows, n = residuals(index), index.lists.count()
    if n > sample:
        rows = rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)) < sample)
    rows = rows.select("id", "res").persist()
    try:
        book = _first_words(rows, m, min(1 << bits, n), seed)
        for _ in range(iters):
            book = _train_step(rows, book)
    finally:
        rows.unpersist()
    return book


def _train_step(rows: DataFrame, book: Codebook) -> Codebook:
    shared = rows.sparkSession.sparkContext.broadcast(book)

    def work(batches):
        book = shared.value
        e, k = book.edges, len(book.words[0])
        n, total = np.zeros((book.m, k), np.int64), [np.zeros_like(w) for w in book.words]
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(0), int(e[-1]))
            codes = book.encode(x).astype(np.int64)
            for i in range(book.m):
                np.add.at(total[i], codes[:, i], x[:, e[i] : e[i + 1]])
                n[i] += np.bincount(codes[:, i], minlength=k)
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(book.m), pa.int32()), pa.array([x.tobytes() for x in n], pa.binary()), pa.array([x.tobytes() for x in total], pa.binary())], names=["block", "n", "total"])

    words = [w.copy() for w in book.words]
    for r in added(rows.select("res").mapInArrow(work, "block int, n binary, total binary")).collect():
        n, total = np.frombuffer(r.n, "<i8"), np.frombuffer(r.total, "<f8").reshape(words[r.block].shape)
        live = n > 0
        words[r.block][live] = np.round(total[live] / n[live, None], DIGITS)
    return Codebook(words)


def encode(index: IVFIndex, book: Codebook) -> DataFrame:
    """id, cid, codes (array of smallint)."""
    shared = index.lists.sparkSession.sparkContext.broadcast(book)

    def work(batches):
        for b in batches:
            codes = shared.value.encode(matrix(b.column(2))) if b.num_rows else np.empty((0, shared.value.m))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(codes.astype(np.int16).ravel()), shared.value.m).cast(pa.list_(pa.int16()))], names=["id", "cid", "codes"])

    return residuals(index).mapInArrow(work, "id bigint, cid int, codes array<smallint>")


def adc(codes: DataFrame, index: IVFIndex, book: Codebook, queries: DataFrame, probes: DataFrame, n: int) -> DataFrame:
    """qid, rank, id, dist: the n best codes by asymmetric distance, exactly the n best. A code stands for its list's
    centroid and its words; a matrix product with those rules out pairs, the rest is added up subspace by subspace where
    the list's rows are. Only codes are read, and n rows a query leave a task."""
    from vexel.operators.brute import query_blocks

    spark, parts = codes.sparkSession, []
    for ids, q in query_blocks(queries, ADC_BLOCK):
        mine = probes.filter(F.col("qid").between(int(ids.min()), int(ids.max()))).select(F.col("qid").cast("long").alias("qid"), "cid").toArrow()
        at = np.minimum(np.searchsorted(ids, mine.column("qid").to_numpy()), len(ids) - 1)
        ok = ids[at] == mine.column("qid").to_numpy()
        asks = np.zeros((len(ids), index.nlist), bool)
        asks[at[ok], mine.column("cid").to_numpy()[ok]] = True
        shared = spark.sparkContext.broadcast((ids, q, asks, index.centroids, book))

        def work(batches, shared=shared):
            ids, q, asks, c, book = shared.value
            best: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))] * -(-len(q) // ASKED)
            for b in batches:
                if not b.num_rows:
                    continue
                own, cid = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
                x = matrix(b.column(2), book.m).astype(np.int64)
                near = c[cid] + book.decode(x)
                for i, a in enumerate(range(0, len(q), ASKED)):
                    rows = np.flatnonzero(asks[a : a + ASKED].any(0)[cid])
                    if not len(rows):
                        continue
                    r, v = candidates(q[a : a + ASKED], near[rows], n, "l2", asks[a : a + ASKED][:, cid[rows]])
                    v = rows[v]
                    d = book.measured(q[a : a + ASKED], c, r, cid[v], x[v])
                    ok = np.isfinite(d)
                    r, j, d = (np.concatenate([y, z]) for y, z in zip(best[i], (r[ok], own[v[ok]], d[ok]), strict=True))
                    o = np.lexsort((j, d, r))
                    o = o[np.arange(len(o)) - np.searchsorted(r[o], r[o]) < n]
                    best[i] = r[o], j[o], d[o]
            for i, (r, j, d) in enumerate(best):
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i * ASKED + r]), pa.array(j), pa.array(d)], names=["qid", "id", "dist"])

        probed = spark.createDataFrame(pa.table({"cid": pa.array(np.flatnonzero(asks.any(0)), pa.int32())}))
        touched = codes.join(F.broadcast(probed), "cid", "left_semi")
        parts.append(touched.select(F.col("id").cast("long").alias("id"), "cid", "codes").mapInArrow(work, "qid bigint, id bigint, dist double"))
    if not parts:
        return spark.createDataFrame([], "qid bigint, rank int, id bigint, dist double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return topk(found, n).select("qid", "rank", "id", "dist")


def adc_sql(codes: DataFrame, index: IVFIndex, book: Codebook, queries: DataFrame, probes: DataFrame, n: int) -> DataFrame:
    """The same in joins: codes against words, added up from the first subspace to the last, so that equal codes are equally
    far in any run."""
    from vexel.functions.vector import l2_distance
    from vexel.operators.kmeans import centroid_frame

    spark, e = codes.sparkSession, book.edges.tolist()
    c = F.broadcast(centroid_frame(spark, index.centroids))
    qr = probes.select("qid", "cid").join(queries, "qid").join(c, "cid").select("qid", "cid", F.zip_with("q", "c", lambda x, y: x.cast("double") - y).alias("r"))
    cut = F.explode(F.array(*(F.struct(F.lit(i).alias("m"), F.slice("r", e[i] + 1, e[i + 1] - e[i]).alias("x")) for i in range(book.m)))).alias("s")
    lut = qr.select("qid", "cid", cut).join(F.broadcast(book.frame(spark)), F.col("s.m") == F.col("m")).select("qid", "cid", "m", "code", l2_distance("s.x", "cw").alias("d"))
    each = codes.select("id", "cid", F.posexplode("codes").alias("m", "code"))
    parts = [F.max(F.when(F.col("m") == i, F.col("d"))).alias(f"_d{i}") for i in range(book.m)]
    total = reduce(lambda a, b: a + b, (F.col(f"_d{i}") for i in range(book.m)))
    return topk(each.join(lut, ["cid", "m", "code"]).groupBy("qid", "id").agg(*parts).select("qid", "id", total.alias("dist")), n).select("qid", "rank", "id", "dist")


def rerank(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Exact distances of distinct candidates, which are computed once. Block by block of queries, their candidates are sent to where the vectors
    are, RERANK_BLOCK queries times their candidates at once; vectors are not moved, and only k rows a query leave a batch."""
    from vexel.operators.brute import query_blocks

    spark, parts = base.sparkSession, []
    candidates = candidates.select(F.col("qid").cast("long").alias("qid"), F.col("id").cast("long").alias("id")).distinct().persist()
    for qids, q in query_blocks(queries, RERANK_BLOCK):
        mine = candidates.filter(F.col("qid").between(int(qids.min()), int(qids.max()))).toArrow()
        at = np.minimum(np.searchsorted(qids, mine.column("qid").to_numpy()), len(qids) - 1)
        ok = qids[at] == mine.column("qid").to_numpy()
        own, row = mine.column("id").to_numpy()[ok], at[ok]
        o = np.argsort(own, kind="stable")
        shared = spark.sparkContext.broadcast((qids, q, own[o], row[o]))

        def work(batches, shared=shared):
            qids, q, wanted, row = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                own = b.column(0).to_numpy(zero_copy_only=False)
                first, last = np.searchsorted(wanted, own), np.searchsorted(wanted, own, "right")
                n = last - first
                which = np.repeat(np.arange(len(own)), n)
                asks = row[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
                if len(which):
                    v = matrix(b.column(1).take(pa.array(np.flatnonzero(n))), q.shape[1])
                    place = np.cumsum(n > 0) - 1
                    d = exact(q[asks], v[place[which]], metric)
                    o = np.lexsort((own[which], d, asks))
                    asks, ids, d = asks[o], own[which][o], d[o]
                    best = np.arange(len(asks)) - np.searchsorted(asks, asks) < k
                    yield pa.RecordBatch.from_arrays([pa.array(qids[asks[best]]), pa.array(ids[best]), pa.array(d[best])], names=["qid", "id", "dist"])

        parts.append(base.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(work, "qid bigint, id bigint, dist double"))
    candidates.unpersist()
    if not parts:
        return spark.createDataFrame([], "qid bigint, rank int, id bigint, dist double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return topk(found, k).select("qid", "rank", "id", "dist")


def pq_search(codes: DataFrame, index: IVFIndex, book: Codebook, queries: DataFrame, k: int, nprobe: int, rerank_n: int = RERANK) -> DataFrame:
    """Candidates by codes, then exact distances within the shards of the probed lists."""
    probes, codes = index.route(queries, nprobe), codes.persist()
    try:
        found = adc(codes, index, book, queries, probes, max(rerank_n, k))
        return rerank(found, index._shards_of(probes), queries, k, index.metric)
    finally:
        codes.unpersist()


__all__ = ["Codebook", "adc", "adc_sql", "encode", "pq_search", "rerank", "residuals", "sampled_codebook", "subdims", "train"]
