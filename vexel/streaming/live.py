"""A live index: a stream of inserts and deletes over a published one, in Structured Streaming.

Each micro-batch becomes one immutable version: inserted rows with their lists, and tombstones. A version is named by
its batch, and writing it again replaces it, so a batch that is retried counts once. A search reads the versions up to
the one it names, and never sees half a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from vexel.operators import kmeans
from vexel.operators.ivf import IVFIndex, without
from vexel.operators.updates import overlay_search

EVENTS = "seq bigint, op string, id bigint, vec array<float>"


class LiveIndex:
    """root: a folder that driver and executors share. Events: seq, op (insert, delete), id, vec."""

    def __init__(self, spark: SparkSession, index: IVFIndex, root: str):
        self.spark, self.index, self.root = spark, index, root.rstrip("/")

    def apply(self, events: DataFrame, version: int) -> None:
        """For foreachBatch: within a batch the last event of an id holds."""
        last = Window.partitionBy("id").orderBy(F.col("seq").desc())
        e = events.filter("op in ('insert', 'delete') and id is not null").withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
        new = kmeans.assign_nearest(e.filter("op = 'insert'").select("id", "vec", "seq"), self.index.centroids)
        new.select("id", "cid", "vec", "seq").write.mode("overwrite").parquet(f"{self.root}/inserted/version={version}")
        e.select("id", "op", "seq").write.mode("overwrite").parquet(f"{self.root}/touched/version={version}")

    def start(self, events: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        w = events.writeStream.foreachBatch(lambda df, n: self.apply(df, n)).option("checkpointLocation", checkpoint)
        return w.trigger(**(trigger or {"availableNow": True})).start()

    def snapshot(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(inserted rows that count, ids of the published index that do not): an id that was touched is no longer the
        published one's, and its newest insert counts unless a later delete took it away."""
        upto = F.lit(True) if version is None else F.col("version") <= version
        touched = self.spark.read.parquet(f"{self.root}/touched").filter(upto)
        newest = touched.groupBy("id").agg(F.max(F.struct("version", "seq", "op")).alias("e")).select("id", "e.*")
        rows = self.spark.read.parquet(f"{self.root}/inserted").filter(upto)
        live = rows.join(newest.filter("op = 'insert'").select("id", "version"), ["id", "version"], "left_semi").select("id", "cid", "vec", "seq")
        return live, newest.select("id")

    def search(self, queries: DataFrame, k: int, nprobe: int, version: int | None = None, mode: str = "flat") -> DataFrame:
        live, gone = self.snapshot(version)
        return overlay_search(IVFIndex(self.index.centroids, without(self.index.lists, gone), self.index.metric, self.index.meta), queries, k, nprobe, live, None, mode)
