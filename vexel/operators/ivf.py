"""Inverted-file index: k-means lists, routing to the nearest lists, exact scan of those lists."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel.functions.vector import distance, inner_product
from vexel.operators import kmeans, layout
from vexel.operators.brute import QUERY_BLOCK, pairs_batch, query_blocks, uniform
from vexel.operators.kernels import candidates, exact, matrix, products, shortlist
from vexel.operators.quant import MinMaxU8
from vexel.operators.topk import topk

#: Directories into which a saved index is dealt; within one, files are sorted by list.
SHARDS = 256


#: Of the equi-join: queries in a group, groups that share a list, rows of a list in a group.
ASKING, SALTS, LISTED = 4096, 8, 32768
#: Deleted ids that are sent to all tasks at most, 8 bytes each; more are joined.
SENT_IDS = 1_000_000
#: Of the saved form; another one is built anew.
VERSION = 2


def without(rows: DataFrame, deleted: DataFrame | Column | None, most: int = SENT_IDS) -> DataFrame:
    """The rows whose id is not deleted. A rule (a column over id) is a filter. A table of ids goes to the rows if a count
    finds few enough, so that vectors stay where they are; more are joined by id."""
    if deleted is None:
        return rows
    if isinstance(deleted, Column):
        return rows.filter(~deleted)
    gone = deleted.select("id")
    few = gone.limit(most + 1).count() <= most
    return rows.join(F.broadcast(gone) if few else gone, "id", "left_anti")


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of a file or folder: names, lengths and times of its files, in whatever store Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, todo = [], [at]
    while todo:
        for x in files.listStatus(todo.pop()):
            if x.isDirectory():
                todo.append(x.getPath())
            else:
                found.append((x.getPath().getName(), x.getLen(), x.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


def route(queries: DataFrame, centroids: np.ndarray, nprobe: int, metric: str = "l2") -> DataFrame:
    """qid, probe_rank, cid, coarse_dist: the nprobe nearest lists of each query, ties to the lower list."""
    if not 0 < nprobe <= len(centroids):
        raise ValueError(f"nprobe {nprobe}: 1 to {len(centroids)}")
    distance(metric, F.lit(None), F.lit(None))
    shared = queries.sparkSession.sparkContext.broadcast(centroids)

    def work(batches):
        c = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            q = matrix(b.column(1), c.shape[1])
            step = max(1, (1 << 22) // len(c))
            for a in range(0, len(q), step):
                d = products(q[a : a + step], c, metric)
                if nprobe < len(c):
                    edge = np.partition(d, nprobe - 1, axis=1)[:, nprobe - 1 : nprobe]
                    r, cid = np.nonzero(d <= edge + 1e-9 * np.abs(edge) + 1e-12)
                else:
                    r, cid = np.nonzero(np.ones_like(d, bool))
                d = exact(q[a + r], c[cid], metric)
                o = np.lexsort((cid, d, r))
                r, cid, d = r[o], cid[o], d[o]
                rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
                ok = rank <= nprobe
                qid = b.column(0).to_numpy()[a + r[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(rank[ok].astype(np.int32)), pa.array(cid[ok].astype(np.int32)), pa.array(d[ok])], names=["qid", "probe_rank", "cid", "coarse_dist"])

    return queries.select(F.col("qid").cast("long").alias("qid"), "q").mapInArrow(work, "qid bigint, probe_rank int, cid int, coarse_dist double")


def route_sql(queries: DataFrame, centroids: DataFrame, nprobe: int, metric: str = "l2") -> DataFrame:
    d = queries.crossJoin(F.broadcast(centroids)).select("qid", F.col("cid").alias("id"), distance(metric, "q", "c").alias("dist"))
    return topk(d, nprobe, rank="probe_rank").select("qid", "probe_rank", F.col("id").alias("cid"), F.col("dist").alias("coarse_dist"))


def scan(lists: DataFrame, probes: DataFrame, queries: DataFrame, k: int, metric: str = "l2", impl: str = "arrow", block: int = QUERY_BLOCK) -> DataFrame:
    """qid, rank, id, dist: the k best rows of each query's probed lists. lists: id, cid, vec.

    "arrow": a block of queries and its probes is broadcast; rows of lists that nobody probes are pruned by a join that
    Spark can turn into partition pruning; the others are scored list by list and only k rows a query leave a batch.
    "sql": an equi-join by list, for query sets of any size, measured in column expressions. Queries that ask a list go to
    it about ASKING at a time, so that a vector is copied once for each group of them, and the rows of a list are dealt over
    SALTS or more groups, LISTED rows in each. Pairs of a group that a matrix product rules out are not measured."""
    if impl == "sql":
        if not uniform((lists, "vec"), (queries, "q")):
            pairs = probes.select("qid", "cid").join(queries.select("qid", "q"), "qid").join(lists.select("id", "cid", "vec"), "cid")
        else:
            pairs = _likely_by_list(lists, probes, queries, k, metric)
        return topk(pairs.select("qid", "id", distance(metric, "q", "vec").alias("dist")), k).select("qid", "rank", "id", "dist")
    if impl != "arrow":
        raise ValueError(f"impl {impl!r}: arrow or sql")
    spark, parts = lists.sparkSession, []
    for ids, q in query_blocks(queries, block):
        mine = probes.filter(F.col("qid").between(int(ids.min()), int(ids.max()))).select("qid", "cid").toArrow()
        at = np.searchsorted(ids, mine.column("qid").to_numpy())
        at = np.minimum(at, len(ids) - 1)
        ok = ids[at] == mine.column("qid").to_numpy()
        cid, row = mine.column("cid").to_numpy()[ok], at[ok]
        o = np.argsort(cid, kind="stable")
        cid, row = cid[o], row[o]
        names = np.unique(cid)
        asks = dict(zip(names.tolist(), np.split(row, np.searchsorted(cid, names[1:])), strict=True))
        shared = spark.sparkContext.broadcast((ids, q, asks))

        def work(batches, shared=shared):
            ids, q, asks = shared.value
            for b in batches:
                own, cids = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
                order = np.argsort(cids, kind="stable")
                edges = np.flatnonzero(np.concatenate([[True], np.diff(cids[order]) != 0, [True]])) if len(order) else [0]
                v = matrix(b.column(2), q.shape[1]) if len(order) else None
                for x, y in zip(edges, edges[1:], strict=False):
                    rows = order[x:y]
                    asking = asks.get(int(cids[rows[0]]))
                    if asking is not None:
                        r, i, d = shortlist(q[asking], v[rows], own[rows], k, metric)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[asking[r]]), pa.array(i), pa.array(d)], names=["qid", "id", "dist"])

        probed = spark.createDataFrame(pa.table({"cid": pa.array(names, pa.int32())}))
        touched = lists.join(F.broadcast(probed), "cid", "left_semi")  # nlist rows of four bytes at most
        parts.append(touched.select(F.col("id").cast("long").alias("id"), "cid", "vec").mapInArrow(work, "qid bigint, id bigint, dist double"))
    if not parts:
        return spark.createDataFrame([], "qid bigint, rank int, id bigint, dist double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return topk(found, k).select("qid", "rank", "id", "dist")


def _likely_by_list(lists: DataFrame, probes: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """qid, q, id, vec: the pairs of probed lists that may be among a query's k best."""
    most = lambda df: df.groupBy("cid").count().agg(F.max("count")).first()[0] or 1
    groups, salts = -(-most(probes) // ASKING), max(SALTS, -(-most(lists) // LISTED))
    deal = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = probes.select("qid", "cid").join(queries.select(F.col("qid").cast("long").alias("qid"), F.col("q").cast("array<double>").alias("q")), "qid")
    asks = asks.withColumn("_g", deal("qid", groups)).withColumn("_salt", every(salts)).select("cid", "_salt", "_g", "qid", "q")
    rows = lists.select("cid", deal("id", salts).alias("_salt"), "id", "vec").withColumn("_g", every(groups))
    kind = lists.schema["id"].dataType.simpleString()

    def work(rows: pa.Table, asks: pa.Table):
        if not rows.num_rows or not asks.num_rows:
            return
        q, v = matrix(asks.column("q")), matrix(rows.column("vec"))
        qids, ids = asks.column("qid").to_numpy(), rows.column("id").combine_chunks()
        r, c = candidates(q, v, k, metric)
        for a in range(0, len(r), 8192):
            yield pairs_batch(qids, q, ids, v, r[a : a + 8192], c[a : a + 8192])

    def joined(rows: pa.Table, asks: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(work(rows, asks)), schema=pa.schema([("qid", pa.int64()), ("q", pa.list_(pa.float64())), ("id", rows.schema.field("id").type), ("vec", pa.list_(pa.float64()))]))

    key = ["cid", "_salt", "_g"]
    return rows.groupBy(*key).cogroup(asks.groupBy(*key)).applyInArrow(joined, f"qid bigint, q array<double>, id {kind}, vec array<double>")


def list_inner_products(lists: DataFrame, probes: DataFrame, queries: DataFrame, most: int | None = None) -> DataFrame:
    """qid, cid, id, ip of every row of the probed lists; `most`: the first so many rows of a list, by id."""
    pairs = probes.select("qid", "cid").join(queries.select("qid", "q"), "qid").join(lists.select("id", "cid", "vec"), "cid")
    if most is not None:
        first = Window.partitionBy("qid", "cid").orderBy("id")
        pairs = pairs.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most)
    return pairs.select("qid", "cid", "id", inner_product("q", "vec").alias("ip"))


@dataclass
class IVFIndex:
    """centroids [nlist, dim]; lists: id, cid, vec (and pos where positions are asked for)."""

    centroids: np.ndarray
    lists: DataFrame
    metric: str = "l2"
    meta: dict = field(default_factory=dict)

    @property
    def nlist(self) -> int:
        return len(self.centroids)

    @classmethod
    def build(cls, base: DataFrame, nlist: int, metric: str = "l2", method: str = "lloyd", iters: int = 20, seed: int = 0, centroids: np.ndarray | None = None, **how) -> IVFIndex:
        """base: id, vec. method: lloyd, minibatch, subset (train_n), hierarchical (alpha); or centroids as given."""
        distance(metric, F.lit(None), F.lit(None))
        train = {"lloyd": kmeans.lloyd, "minibatch": kmeans.minibatch, "subset": kmeans.subset, "hierarchical": kmeans.balanced_hierarchical}
        if centroids is None:
            if method not in train:
                raise ValueError(f"method {method!r}: one of {', '.join(train)}")
            centroids = train[method](base, nlist, iters=iters, seed=seed, **how)
        return cls(centroids, kmeans.assign_nearest(base.select("id", "vec"), centroids).select("id", "cid", "vec"), metric, {"method": method, "iters": iters, "seed": seed})

    def save(self, path: str, fingerprint: str = "") -> None:
        """Lists dealt into shards by list number and sorted, so that a search opens the shards of its lists alone."""
        per = max(1, -(-self.nlist // SHARDS))
        dealt = self.lists.withColumn("shard", F.floor(F.col("cid") / per).cast("int"))
        dealt.repartition("shard").sortWithinPartitions("shard", "cid", "id").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/lists")
        spark = self.lists.sparkSession
        kmeans.centroid_frame(spark, self.centroids).coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        meta = self.meta | {"metric": self.metric, "nlist": self.nlist, "dim": int(self.centroids.shape[1]), "per": per, "version": VERSION, "fingerprint": fingerprint, "written": time.time()}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, fingerprint: str | None = None) -> IVFIndex:
        """Refuses an index whose fingerprint is not the given one, so that a stale one is built anew."""
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        if fingerprint is not None and meta["fingerprint"] != fingerprint:
            raise ValueError("the index was built from other data")
        return cls(kmeans.centroid_matrix(spark.read.parquet(f"{path}/centroids")), spark.read.parquet(f"{path}/lists"), meta["metric"], meta)

    @classmethod
    def cached(cls, spark: SparkSession, path: str, source: str, build: Callable[[], IVFIndex]) -> tuple[IVFIndex, bool]:
        """The index saved at path if it was built, by this form's version, from the source file or folder as it is now:
        same names, lengths and times. Otherwise build() is saved there. True if it was built."""
        mark = f"{VERSION}:{fingerprint(spark, source)}"
        try:
            return cls.load(spark, path, mark), False
        except (ValueError, AnalysisException):
            build().save(path, mark)
            return cls.load(spark, path, mark), True

    @classmethod
    def from_files(cls, spark: SparkSession, base: str, centroids: str, assign: str, kind: str = "auto", metric: str = "l2") -> IVFIndex:
        """From dumps: vectors, centroids, and the list of each row. Rows read their lists where they are; nothing is joined."""
        from vexel.sources import vectors as files

        c = files.read_centroids(centroids)
        rows = files.with_assign(files.read_vectors(spark, base, kind), assign)
        return cls(c, rows.select("id", "cid", F.col("vec").cast("array<float>").alias("vec")), metric, {"method": "dump"})

    def append(self, rows: DataFrame) -> IVFIndex:
        """Rows go to their nearest lists; centroids stay."""
        new = kmeans.assign_nearest(rows.select("id", "vec"), self.centroids).select("id", "cid", "vec")
        return IVFIndex(self.centroids, self.lists.select("id", "cid", "vec").unionByName(new), self.metric, self.meta)

    def persist(self) -> IVFIndex:
        self.lists = self.lists.persist()
        return self

    def route(self, queries: DataFrame, nprobe: int) -> DataFrame:
        return route(queries, self.centroids, nprobe, self.metric)

    def _shards_of(self, probes: DataFrame) -> DataFrame:
        if "shard" not in self.lists.columns:
            return self.lists
        per = self.meta["per"]
        shards = [r.s for r in probes.select(F.floor(F.col("cid") / per).cast("int").alias("s")).distinct().collect()]  # SHARDS at most
        return self.lists.filter(F.col("shard").isin(shards))

    def search_bytes(self, codec: MinMaxU8, queries: DataFrame, k: int, nprobe: int, deleted: DataFrame | Column | None = None) -> DataFrame:
        """qid, rank, id, dist (bigint): as search() by l2, over lists and queries in bytes. Sums of squares of bytes are
        whole numbers far below 2 to the 53, so that the products are exact. Deleted rows are left out before ranking."""
        probes = self.route(queries, nprobe)
        lists = without(self._shards_of(probes).select("id", "cid", "vec"), deleted)
        lists = codec.encode(lists).select("id", "cid", F.col("codes").alias("vec"))
        asked = codec.encode(queries.select("qid", F.col("q").alias("vec"))).select("qid", F.col("codes").alias("q"))
        return scan(lists, probes, asked, k).withColumn("dist", F.col("dist").cast("long"))

    def search(self, queries: DataFrame, k: int, nprobe: int, impl: str = "arrow", layout_kind: str = "lists", returns: str = "id", deleted: DataFrame | Column | None = None) -> DataFrame:
        """qid, rank, id (or pos), dist. deleted: ids (or a rule over id) that do not count; they are left out before ranking.
        layout_kind "blocks" scans balanced blocks, with the same answers."""
        probes = self.route(queries, nprobe)
        lists = self._shards_of(probes).select("id", "cid", "vec")
        lists = without(lists, deleted)
        if layout_kind == "blocks":
            lists = layout.rebalance(lists, layout.choose_bcs(layout.cluster_info(lists, self.nlist), 0.3)).repartition("cid", "block_no").select("id", "cid", "vec")
        if returns == "pos":
            place = layout.positions(lists.select("id", "cid"), layout.cluster_info(self.lists, self.nlist)).select("id", "pos")
            return scan(lists, probes, queries, k, self.metric, impl).join(place, "id").select("qid", "rank", "pos", "dist")
        return scan(lists, probes, queries, k, self.metric, impl)


class IndexCatalog:
    """Named indexes of a session. A name that is registered again is replaced, and what it held is freed."""

    def __init__(self, most: int = 64):
        self._of, self.most = {}, most

    def register(self, name: str, index: IVFIndex) -> None:
        if name not in self._of and len(self._of) >= self.most:
            raise ValueError(f"{self.most} indexes are registered already")
        self.unregister(name)
        self._of[name] = index

    def load(self, spark: SparkSession, name: str, path: str, fingerprint: str | None = None) -> bool:
        """Loads a saved index under a name, unless one is there already: then nothing happens, and False."""
        if name in self._of:
            return False
        self.register(name, IVFIndex.load(spark, path, fingerprint))
        return True

    def get(self, name: str) -> IVFIndex:
        if name not in self._of:
            raise KeyError(f"no index {name!r}")
        return self._of[name]

    def unregister(self, name: str) -> None:
        if (old := self._of.pop(name, None)) is not None:
            old.lists.unpersist()

    def names(self) -> list[str]:
        return sorted(self._of)

    def ann_search(self, name: str, queries: DataFrame, k: int, nprobe: int, view: str | None = None, **how) -> DataFrame:
        """A search of a registered index; `view` also names the answer for SQL."""
        out = self.get(name).search(queries, k, nprobe, **how)
        if view:
            out.createOrReplaceTempView(view)
        return out
