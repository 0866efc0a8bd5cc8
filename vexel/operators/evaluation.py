"""Recall, latencies, and what inserts do to the ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.operators.topk import distinct_topk


def recall(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """k, hits, total, recall: shares of the k true neighbours among the k found; k is cut to what the truth has."""
    t = truth.filter(F.col("rank") <= k).select("qid", "id")
    hits = result.filter(F.col("rank") <= k).select("qid", "id").join(t, ["qid", "id"], "left_semi")
    return t.agg(F.count("*").alias("total")).crossJoin(hits.agg(F.count("*").alias("hits"))).select(F.lit(k).alias("k"), "hits", "total", F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(0.0).alias("recall"))


def recalls(result: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    out = recall(result, truth, ks[0])
    for k in ks[1:]:
        out = out.unionByName(recall(result, truth, k))
    return out


def surviving_truth(truth: DataFrame, deleted: DataFrame, k: int) -> DataFrame:
    """The first k true neighbours that are not deleted, ranked anew; refuses queries that have fewer."""
    left = truth.join(deleted.select("id"), "id", "left_anti")
    kept = distinct_topk(left, k).select("qid", "rank", "id", "dist")
    short = truth.select("qid").distinct().join(kept.groupBy("qid").count(), "qid", "left").filter(F.coalesce("count", F.lit(0)) < k)
    if not short.isEmpty():
        raise ValueError(f"some queries have fewer than {k} neighbours that are not deleted")
    return kept


def update_truth(truth: DataFrame, k: int, copies: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Targets under updates: the inserted copy of the query first, if there is one (copies: qid, id), then the old
    neighbours that survive, k at most."""
    left = truth if deleted is None else truth.join(deleted.select("id"), "id", "left_anti")
    rows = left.select("qid", "id", "dist")
    if copies is not None:
        rows = rows.unionByName(copies.select("qid", "id", F.lit(-1.0).alias("dist")))
    return distinct_topk(rows, k).select("qid", "rank", "id")


def insert_aware_truth(truth: DataFrame, delta: DataFrame, k: int) -> DataFrame:
    """The k nearest of old neighbours and inserted rows. delta: qid, id, dist of a brute-force search of the inserts."""
    return distinct_topk(truth.select("qid", "id", "dist").unionByName(delta.select("qid", "id", "dist")), k).select("qid", "rank", "id", "dist")


def insert_impact(truth: DataFrame, n_base: int, n_queries: int, k: int) -> DataFrame:
    """What inserts (ids from n_base on) take of a truth that knows them."""
    new = truth.filter((F.col("id") >= n_base) & (F.col("rank") <= k))
    return new.agg(
        F.countDistinct("qid").alias("affected_queries"), F.count("*").alias("insert_slots"),
        F.coalesce(F.min("rank"), F.lit(-1)).cast("long").alias("rank_min"), F.coalesce(F.avg("rank"), F.lit(0.0)).alias("rank_avg"),
    ).withColumn("affected_ratio", F.col("affected_queries") / n_queries).withColumn("slot_ratio", F.col("insert_slots") / (n_queries * k))


def copy_misses(delta_result: DataFrame, copies: DataFrame) -> DataFrame:
    """How many inserted copies of queries (qid, id) were not found."""
    return copies.join(delta_result.select("qid", "id"), ["qid", "id"], "left_anti").agg(F.count("*").alias("misses"))


def percentiles(latencies: DataFrame, column: str, ps: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Linear interpolation between the nearest ranks."""
    return latencies.agg(*(F.percentile(column, p).alias(f"p{p * 100:g}") for p in ps), F.avg(column).alias("mean"), F.count(column).alias("n"))


def probe_counts(probes: DataFrame, info: DataFrame, chunk: int) -> DataFrame:
    """qid, lists, chunks (of at most `chunk` rows of one list), rows: what the probed lists of each query come to."""
    sizes = info.select("cid", "count", F.ceil(F.col("count") / chunk).cast("long").alias("c"))
    p = probes.join(F.broadcast(sizes), "cid")  # one row for each list
    return p.groupBy("qid").agg(F.count("*").alias("lists"), F.sum("c").alias("chunks"), F.sum("count").alias("rows"))


def throughput(n_queries: int, total_ms: float) -> float:
    return n_queries / total_ms * 1000 if total_ms > 0 else 0.0


def checksum(result: DataFrame) -> DataFrame:
    """Sum of distance times rank."""
    return result.agg(F.sum(F.col("dist") * F.col("rank")).alias("checksum"))
