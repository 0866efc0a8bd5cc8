"""The one ordering rule: by distance, then by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def topk(df: DataFrame, k: int, by: str = "qid", dist: str = "dist", id_col: str = "id", largest: bool = False, rank: str = "rank") -> DataFrame:
    """The k best rows of each query, ranked from 1. Spark keeps only k rows a query on each side of the exchange."""
    if k <= 0:
        raise ValueError(f"k {k}")
    ok = df.filter(F.col(dist).isNotNull() & ~F.isnan(dist) & (F.abs(F.col(dist)) < float("inf")) & F.col(id_col).isNotNull())
    order = [F.col(dist).desc() if largest else F.col(dist).asc(), F.col(id_col).asc()]
    return ok.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col(rank) <= k)


def distinct_topk(df: DataFrame, k: int, by: str = "qid", **names) -> DataFrame:
    """As topk, with each id once, at its least distance."""
    dist, id_col = names.get("dist", "dist"), names.get("id_col", "id")
    return topk(df.groupBy(by, id_col).agg(F.min(dist).alias(dist)), k, by, **names)


def padded(result: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """A dense result: every query has ranks 1 to k, and missing ones are (-1, infinity)."""
    grid = queries.select("qid").withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return grid.join(result, ["qid", "rank"], "left").select("qid", "rank", F.coalesce("id", F.lit(-1)).cast("long").alias("id"), F.coalesce("dist", F.lit(float("inf"))).alias("dist"))
