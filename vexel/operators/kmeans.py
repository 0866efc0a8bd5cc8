"""k-means over DataFrames: rows stay distributed, centroids (k x dim) travel.

Always Euclidean. A fixed number of iterations and one assignment at the end. Ties go to the lower centroid; an empty
cluster keeps its centroid. Means are rounded to nine places each iteration, so that the order of summation, which
differs between runs and engines, cannot change a later assignment."""

from __future__ import annotations

from abc import ABC, abstractmethod
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel.operators.kernels import matrix, nearest

#: Fixed values of the starting order, small enough for any engine's integers.
_A, _P = 7919, 10007
DIGITS = 9
#: Rows of one minibatch.
WINDOW = 32768


#: Bytes of sums in one row on their way between tasks.
PIECE = 8192


def start_order(id_: Column, seed: int | Column = 0) -> Column:
    """Places 0 to 10,006; remainders are taken first, so that ids of any size do not overflow."""
    shift = F.lit(seed % _P) if isinstance(seed, int) else F.pmod(seed.cast("long"), F.lit(_P))
    return ((F.pmod(id_, F.lit(_P)) + shift) * _A) % _P


def start_place(id_: int, seed: int = 0) -> int:
    """start_order() of one id."""
    return ((id_ + seed) * _A) % _P


def init_sample(base: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """k distinct rows, first in a hash order."""
    rows = base.select("id", "vec").orderBy(start_order(F.col("id"), seed), "id").limit(k).collect()
    if len(rows) < k:
        raise ValueError(f"{k} clusters need as many rows; there are {len(rows)}")
    rows.sort(key=lambda r: (start_place(r.id, seed), r.id))
    return np.array([r.vec for r in rows], np.float64)


def centroid_frame(spark: SparkSession, c: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"cid": pa.array(range(len(c)), pa.int32()), "c": pa.array(c.tolist(), pa.list_(pa.float64()))}))


def centroid_matrix(df: DataFrame) -> np.ndarray:
    return np.array([r.c for r in df.orderBy("cid").collect()], np.float64)


def assign_nearest(base: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cid and cdist (squared) to every row."""
    at, shared = base.columns.index("vec"), base.sparkSession.sparkContext.broadcast(centroids)

    def work(batches):
        c = shared.value
        for b in batches:
            a, d = nearest(matrix(b.column(at), c.shape[1]), c) if b.num_rows else (np.empty(0), np.empty(0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(a.astype(np.int32)), pa.array(d.astype(np.float64))], names=[*b.schema.names, "cid", "cdist"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(work, f"{schema}, cid int, cdist double")


def assign_nearest_sql(base: DataFrame, centroids: DataFrame) -> DataFrame:
    """The same in column expressions."""
    from vexel.functions.vector import l2_distance

    d = base.crossJoin(F.broadcast(centroids)).groupBy(*[c for c in base.columns if c != "vec"])
    return d.agg(F.first("vec").alias("vec"), F.min(F.struct(l2_distance("vec", "c").alias("d"), "cid")).alias("_m")).select(*base.columns, F.col("_m.cid").alias("cid"), F.col("_m.d").alias("cdist"))


def packed_sums(pieces, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    """One row for each piece (block, rows of n and total) that has counts: block, n, total, as bytes."""
    live = [(b, x) for b, x in pieces if n[x].any()]
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in live], pa.int32()), pa.array([n[x].astype("<i8").tobytes() for _, x in live], pa.binary()), pa.array([total[x].astype("<f8").tobytes() for _, x in live], pa.binary())],
        names=["block", "n", "total"],
    )


def added(parts: DataFrame) -> DataFrame:
    """block, n, total: the sums of all tasks, added up as arrays. One exchange; a task holds the totals of its own blocks
    and one batch."""

    def work(batches):
        of: dict[int, tuple] = {}
        for b in batches:
            for block, n, total in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, total = np.frombuffer(n, "<i8"), np.frombuffer(total, "<f8")
                of[block] = (of[block][0] + n, of[block][1] + total) if block in of else (n, total)
        yield pa.RecordBatch.from_arrays([pa.array(list(of), pa.int32()), pa.array([x.tobytes() for x, _ in of.values()], pa.binary()), pa.array([x.tobytes() for _, x in of.values()], pa.binary())], names=["block", "n", "total"])

    return parts.repartition("block").mapInArrow(work, "block int, n binary, total binary")


def sums(base: DataFrame, centroids: np.ndarray, owner: np.ndarray | None = None) -> DataFrame:
    """block, n, total: rows and sums of vectors for each block of centroids (those from block * width(dim) on). Each
    task adds up its own rows. With owner, a row looks only among the centroids that its own cid owns."""
    shared = base.sparkSession.sparkContext.broadcast((centroids, owner))

    def work(batches):
        c, owner = shared.value
        total, n, w = np.zeros_like(c), np.zeros(len(c), np.int64), width(c.shape[1])
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column(0), c.shape[1])
            if owner is None:
                a, _ = nearest(v, c)
            else:
                cid, a = b.column(1).to_numpy(zero_copy_only=False), np.empty(len(v), np.int64)
                for one in np.unique(cid).tolist():
                    own, rows = np.flatnonzero(owner == one), np.flatnonzero(cid == one)
                    a[rows] = own[nearest(v[rows], c[own])[0]]
            np.add.at(total, a, v)
            n += np.bincount(a, minlength=len(c))
        yield packed_sums(((i, slice(i * w, (i + 1) * w)) for i in range(-(-len(c) // w))), n, total)

    columns = ["vec"] if owner is None else ["vec", "cid"]
    return added(base.select(*columns).mapInArrow(work, "block int, n binary, total binary"))


def width(dim: int) -> int:
    """Centroids in a block."""
    return max(1, PIECE // (8 * dim))


def cluster_sums(base: DataFrame, centroids: np.ndarray, owner: np.ndarray | None = None):
    """(cid, n, sum of vectors) of every cluster that has rows."""
    w, dim = width(centroids.shape[1]), centroids.shape[1]
    for r in sums(base, centroids, owner).toLocalIterator():
        n, total = np.frombuffer(r.n, "<i8"), np.frombuffer(r.total, "<f8").reshape(-1, dim)
        for i in np.flatnonzero(n).tolist():
            yield r.block * w + i, int(n[i]), total[i]


def lloyd_step(base: DataFrame, centroids: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
    out = centroids.copy()
    for cid, n, total in cluster_sums(base, centroids, owner):
        out[cid] = np.array([round(x / n, DIGITS) for x in total.tolist()])
    return out


def lloyd(base: DataFrame, k: int, iters: int = 20, seed: int = 0, start: np.ndarray | None = None) -> np.ndarray:
    c = init_sample(base, k, seed) if start is None else start
    for _ in range(iters):
        c = lloyd_step(base, c)
    return c


def minibatch_step(window: DataFrame, centroids: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One minibatch: a centroid moves by 1 / (rows seen + 1) towards the mean of its rows."""
    out, seen = centroids.copy(), seen.copy()
    for cid, n, total in cluster_sums(window, centroids):
        rate = 1.0 / (seen[cid] + 1.0)
        out[cid] = np.round((1.0 - rate) * out[cid] + rate * (total / n), DIGITS)
        seen[cid] += n
    return out, seen


def minibatch(base: DataFrame, k: int, iters: int = 20, seed: int = 0, window: int = WINDOW) -> np.ndarray:
    """4 * iters windows of consecutive ids, each from a random place. Ids are expected to be dense."""
    low, high = base.agg(F.min("id"), F.max("id")).first()
    c, seen, rng = init_sample(base, k, seed), np.zeros(k, np.int64), np.random.default_rng(seed)
    for _ in range(4 * iters):
        a = int(rng.integers(low, max(low, high - window + 1) + 1))
        c, seen = minibatch_step(base.filter(F.col("id").between(a, a + window - 1)), c, seen)
    return c


def minibatch_pass(base: DataFrame, k: int, seed: int = 0, window: int = WINDOW) -> np.ndarray:
    """Every row once: consecutive windows of ids, from the first id to the last."""
    low, high = base.agg(F.min("id"), F.max("id")).first()
    c, seen = init_sample(base, k, seed), np.zeros(k, np.int64)
    for a in range(low, high + 1, window):
        c, seen = minibatch_step(base.filter(F.col("id").between(a, a + window - 1)), c, seen)
    return c


def subset(base: DataFrame, k: int, train_n: int, iters: int = 20, seed: int = 0) -> np.ndarray:
    """Trained on the first train_n ids alone."""
    return lloyd(base.filter(F.col("id") < train_n), k, iters, seed)


def balanced_hierarchical(base: DataFrame, m: int, iters: int = 20, seed: int = 0, alpha: float = 1.0) -> np.ndarray:
    """About m centroids for clusters of even size: ceil(sqrt(m)) first; each that has more than its share of the
    training rows is split in as many as its rows call for. All are split at once, by rows that stay where they are."""
    rows = base if alpha >= 1 else base.orderBy(start_order(F.col("id"), seed), "id").limit(max(1, round(alpha * base.count())))
    n = rows.count()
    if not n:
        raise ValueError("no rows")
    first = lloyd(rows, min(n, max(2, ceil(sqrt(m)))), iters, seed)
    share = max(1, ceil(n / m))
    near = assign_nearest(rows.select("id", "vec"), first).select("id", "vec", "cid").persist()
    sizes = {r.cid: r["count"] for r in near.groupBy("cid").count().collect()}
    split = {c: ceil(s * m / n) for c, s in sizes.items() if s > share and ceil(s * m / n) > 1}
    parts: dict[int, list] = {}
    if split:
        large = near.filter(F.col("cid").isin(list(split)))
        order = Window.partitionBy("cid").orderBy(start_order(F.col("id"), F.col("cid") + seed), "id")
        chosen = large.withColumn("sub", F.row_number().over(order)).filter(F.col("sub") <= max(split.values())).orderBy("cid", "sub").collect()
        chosen = [r for r in chosen if r["sub"] <= split[r.cid]]
        owner, c = np.array([r.cid for r in chosen]), np.array([r.vec for r in chosen], np.float64)
        for _ in range(iters):
            c = lloyd_step(large, c, owner)
        for o, x in zip(owner.tolist(), c.tolist(), strict=True):
            parts.setdefault(o, []).append(x)
    near.unpersist()
    out = [x for c in sorted(sizes) for x in parts.get(c, [first[c].tolist()])]
    return np.round(np.array(out, np.float64), DIGITS)


def objective(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("cdist").alias("objective"))


class Clustering(ABC):
    """Extension point: anything that finds centroids for rows (id, vec)."""

    centroids: np.ndarray

    @abstractmethod
    def fit(self, base: DataFrame) -> Clustering: ...

    def assign(self, base: DataFrame) -> DataFrame:
        return assign_nearest(base, self.centroids)

    def objective(self, base: DataFrame) -> float:
        return objective(self.assign(base.select("id", "vec"))).first()["objective"] or 0.0


class KMeans(Clustering):
    def __init__(self, k: int, iters: int = 20, seed: int = 0, minibatch: bool = False, window: int = WINDOW):
        if k <= 0 or iters < 0:
            raise ValueError(f"{k} clusters, {iters} iterations")
        self.k, self.iters, self.seed, self.minibatch, self.window = k, iters, seed, minibatch, window

    def fit(self, base: DataFrame) -> KMeans:
        self.centroids = minibatch(base, self.k, self.iters, self.seed, self.window) if self.minibatch else lloyd(base, self.k, self.iters, self.seed)
        return self


class BalancedHierarchical(Clustering):
    def __init__(self, m: int, iters: int = 20, seed: int = 0, alpha: float = 1.0):
        if m <= 0 or not 0 < alpha <= 1:
            raise ValueError(f"{m} clusters, a share of {alpha}")
        self.m, self.iters, self.seed, self.alpha = m, iters, seed, alpha

    def fit(self, base: DataFrame) -> BalancedHierarchical:
        self.centroids = balanced_hierarchical(base, self.m, self.iters, self.seed, self.alpha)
        return self
