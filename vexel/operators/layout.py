"""Cluster-major layout: counts, offsets, positions, and balanced blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cluster_info(assigned: DataFrame, nlist: int) -> DataFrame:
    """cid, count, offset; empty clusters too. One row per cluster goes through the window."""
    counts = assigned.groupBy("cid").agg(F.count("*").alias("count"))
    every = assigned.sparkSession.range(nlist).select(F.col("id").cast("int").alias("cid"))
    c = every.join(counts, "cid", "left").select("cid", F.coalesce("count", F.lit(0)).alias("count"))
    w = Window.orderBy("cid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.select("cid", "count", (F.sum("count").over(w) - F.col("count")).cast("long").alias("offset"))


def positions(assigned: DataFrame, info: DataFrame) -> DataFrame:
    """Adds pos: the place in the order (cid, id). Ranked cluster by cluster, then shifted by the cluster's offset."""
    w = Window.partitionBy("cid").orderBy("id")
    inside = assigned.withColumn("_n", F.row_number().over(w) - 1)
    return inside.join(info.select("cid", "offset"), "cid").withColumn("pos", F.col("offset") + F.col("_n")).drop("_n", "offset")


def cluster_major(assigned: DataFrame, partitions: int | None = None) -> DataFrame:
    """The physical layout: rows of a cluster together, sorted."""
    dealt = assigned.repartition(partitions, "cid") if partitions else assigned.repartition("cid")
    return dealt.sortWithinPartitions("cid", "id")


def _unit(total: int, base: int | None) -> int:
    return base or (256 * 64 if total > 100_000_000 else 256)


def compute_bcs(sizes: list[int], ratio: float, base: int | None = None, most_blocks: int = 11) -> int:
    """Rows of a balanced block: the largest multiple of `base`, up to the mean cluster size, for which block sizes
    spread by no more than `ratio`, or blocks outnumber the clusters by `most_blocks`; `base` if there is none.

    A cluster of s rows gives s // size whole blocks and one of s % size, so that the number of blocks and the sum of
    their squares follow from the counts: all candidates are reckoned at once and no block is listed."""
    s = np.asarray(sizes, np.int64)
    base = _unit(int(s.sum()), base)
    tries = base * np.arange(1, max(1, int(s.sum()) // max(1, len(s)) // base) + 1)
    whole, rest = s[:, None] // tries, s[:, None] % tries
    n, squares = (whole + (rest > 0)).sum(0), (whole * tries**2.0 + rest**2.0).sum(0)
    spread = np.sqrt(np.maximum(0, squares - float(s.sum()) ** 2 / np.maximum(n, 1)) / np.maximum(n - 1, 1))
    return int(tries[(spread <= ratio * tries) | (n > most_blocks * len(s))].max(initial=base))


def block_spreads(info: DataFrame, base: int | None = None) -> DataFrame:
    """bcs, blocks, spread (sample standard deviation of block sizes) of every candidate size, from cluster counts."""
    r = info.agg(F.count("*").alias("n"), F.sum("count").alias("total")).first()
    base = _unit(r.total or 0, base)
    top = base * max(1, (r.total or 0) // max(1, r.n) // base)
    each = info.select("count", F.explode(F.sequence(*(F.lit(x).cast("long") for x in (base, top, base)))).alias("bcs"))
    whole, rest = F.floor(F.col("count") / F.col("bcs")), F.col("count") % F.col("bcs")
    m = each.groupBy("bcs").agg(
        F.sum(whole + (rest > 0).cast("long")).alias("blocks"), F.sum("count").cast("double").alias("rows"),
        F.sum(whole * F.pow("bcs", F.lit(2)) + F.pow(rest, F.lit(2))).alias("squares"),
    )
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") - F.col("rows") * F.col("rows") / F.greatest(F.col("blocks"), F.lit(1))) / F.greatest(F.col("blocks") - 1, F.lit(1)))
    return m.select("bcs", "blocks", spread.alias("spread"))


def choose_bcs(info: DataFrame, ratio: float, base: int | None = None, most_blocks: int = 11) -> int:
    """compute_bcs() of counts that stay where they are."""
    clusters = info.count()
    good = block_spreads(info, base).filter((F.col("spread") <= ratio * F.col("bcs")) | (F.col("blocks") > most_blocks * clusters))
    return good.agg(F.max("bcs")).first()[0] or _unit(info.agg(F.sum("count")).first()[0] or 0, base)


def rebalance(assigned: DataFrame, bcs: int) -> DataFrame:
    """Adds block_no (within the cluster): slices of bcs rows in id order."""
    w = Window.partitionBy("cid").orderBy("id")
    return assigned.withColumn("block_no", F.floor((F.row_number().over(w) - 1) / bcs).cast("int"))


def blocks(info: DataFrame, bcs: int) -> DataFrame:
    """cid, block_id (over all clusters), block_no, size, offset: from counts alone."""
    n = F.ceil(F.col("count") / bcs)
    w = Window.orderBy("cid").rowsBetween(Window.unboundedPreceding, -1)
    b = info.withColumn("_first", F.coalesce(F.sum(n).over(w), F.lit(0))).filter("count > 0").withColumn("block_no", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    return b.select("cid", (F.col("_first") + F.col("block_no")).cast("long").alias("block_id"), "block_no", F.least(F.lit(bcs), F.col("count") - F.col("block_no") * bcs).cast("long").alias("size"), (F.col("offset") + F.col("block_no") * bcs).cast("long").alias("offset"))


#: What block_faults() looks for.
CHECKS = ("no clusters", "bad block size", "negative count", "row total differs", "block count differs", "block numbers not dense", "empty or oversized block", "block sizes of a cluster do not add up", "blocks overlap or leave gaps", "rows outside their block")


def block_faults(info: DataFrame, block_table: DataFrame, assigned: DataFrame, bcs: int) -> DataFrame:
    """check, violations: the invariants of a block layout, each as a count."""
    spark = info.sparkSession
    one = lambda i, df: df.agg(F.lit(CHECKS[i]).alias("check"), F.count("*").alias("violations"))
    ok = spark.range(1)
    per = block_table.groupBy("cid").agg(F.count("*").alias("n"), F.sum("size").alias("rows"), F.max("block_no").alias("last"))
    both = info.join(per, "cid", "left").na.fill(0, ["n", "rows"])
    all_ = block_table.agg(F.count("*").alias("n"), F.min("block_id").alias("lo"), F.max("block_id").alias("hi"), F.countDistinct("block_id").alias("d"))
    totals = info.agg(F.sum("count").alias("a")).crossJoin(assigned.agg(F.count("*").alias("b")))
    w = Window.orderBy("offset")
    gaps = block_table.withColumn("next", F.lead("offset").over(w)).filter("next is not null and next <> offset + size")
    placed = rebalance(assigned, bcs).groupBy("cid", "block_no").agg(F.count("*").alias("have"))
    wrong = placed.join(block_table, ["cid", "block_no"], "full").filter("coalesce(have, 0) <> coalesce(size, 0)")
    found = [
        one(0, info.agg(F.count("*").alias("n")).filter("n = 0")), one(1, ok.filter(F.lit(bcs <= 0))), one(2, info.filter("count < 0")),
        one(3, totals.filter("a <> b")), one(4, both.filter(F.col("n") != F.ceil(F.col("count") / bcs))),
        one(5, all_.filter("n > 0 and (lo <> 0 or hi <> n - 1 or d <> n)")), one(6, block_table.filter((F.col("size") <= 0) | (F.col("size") > bcs))),
        one(7, both.filter("rows <> count")), one(8, gaps), one(9, wrong),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
