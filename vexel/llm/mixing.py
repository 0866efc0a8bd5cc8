"""Mixing sources to target weights by a low-discrepancy schedule.

Point n of the golden-ratio sequence falls into one source's stretch of the cumulative shares; that source gets slot n,
which is its r-th slot so far. Each source's documents, shuffled by a keyed hash, form one stream of words that starts
over at its end, and slot r takes words [r * block, (r + 1) * block) of it. The join of slots and blocks is one to one,
and what no slot takes is not in the mix.

There are as many points as all sources need slots for their targets. A source that has its slots gives further ones up;
one that lacks some when the points are used up gets closing slots after them, source by source. Its last slot is cut at
the target, so a source's words differ from its target by less than one.

Shares: sources by code point (null last) weigh 5, 2, 1, repeating. A target stops at `limit` times its source's size,
and what is over goes to the others by weight until none is above. As a stream of `limit` rounds at most, no document
is taken more than `limit` times.

Hot sources are dealt into slices: a task sorts one slice, and only slice totals are summed over a source. Null texts
have no words; empty sources have the target 0. Rows that repeat an id are documents of their own. A table without
words gives targets of 0. Reruns agree, as the order depends on ids and the seed alone. Further columns are ignored.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel.llm.common import cut, running_sum

WEIGHTS = (5, 2, 1)
LIMIT = 3
BLOCK = 4096
GOLDEN = 0.6180339887498949
#: Cells of [0, 1) by which points meet the sources' stretches.
CELLS = 4096
#: Slots in a slice of the ranking; documents in a slice of a stream, about.
SLICE = 65536


def n_words(text: Column) -> Column:
    """Runs of bytes other than blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, rank, target from (source, size) rows. One row per source goes through one task."""
    total = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name, everywhere = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    s = total.withColumn("rank", (F.row_number().over(by_name) - 1).cast("long"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", (F.col("source_size") * limit).cast("double")).withColumn("fill", F.col("cap") / F.col("weight"))
    before = Window.orderBy("fill", "rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "rank", "level"))).over(everywhere)["level"])
    return s.select("source", "source_size", "rank", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def slots(shares: DataFrame, n: int) -> DataFrame:
    """n slots: slot, rank (its source), r (which slot of that source it is)."""
    spark = shares.sparkSession
    w = Window.orderBy("rank")
    all_ = F.sum("target").over(Window.partitionBy())
    s = shares.filter("target > 0").withColumn("hi", F.sum("target").over(w) / all_).withColumn("lo", F.coalesce(F.lag("hi").over(w), F.lit(0.0)))
    s = s.withColumn("hi", F.when(F.lead("hi").over(w).isNull(), 1.0).otherwise(F.col("hi")))
    cells = s.select("rank", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    x = (F.col("id") + 0.5) * GOLDEN
    points = spark.range(n).select(F.col("id").alias("slot"), (x - F.floor(x)).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    dealt = points.join(cells, "cell").filter("u >= lo and u < hi").select("slot", "rank", F.lit(1).alias("one"), F.floor(F.col("slot") / SLICE).alias("slice"))
    return running_sum(dealt, ["rank"], ["slot"], "one", "slice", "r").select("slot", "rank", "r")


def schedule(shares: DataFrame, block: int) -> DataFrame:
    """slot, rank, r, words: each source's slots, as many as its target needs, in the order of the mix. Slots that the
    sequence gives come first; closing ones follow."""
    need = shares.select("rank", F.floor("target").cast("long").alias("whole")).withColumn("need", F.ceil(F.col("whole") / block).cast("long"))
    n = need.agg(F.coalesce(F.sum("need"), F.lit(0)).alias("n")).first()["n"]
    dealt = cut(slots(shares, n).join(need, "rank").filter("r < need").select("slot", "rank", "r", "whole"))
    have = dealt.groupBy("rank").agg(F.count("*").alias("have"))
    lacking = need.join(have, "rank", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < need")
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    lacking = lacking.withColumn("_at", n + F.coalesce(F.sum(F.col("need") - F.col("have")).over(before), F.lit(0)))
    closing = lacking.withColumn("r", F.explode(F.sequence("have", F.col("need") - 1))).select((F.col("_at") + F.col("r") - F.col("have")).alias("slot"), "rank", "r", "whole")
    return dealt.unionByName(closing).select("slot", "rank", "r", F.least(F.lit(block), F.col("whole") - F.col("r") * block).alias("words"))


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, block: int = BLOCK, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(rows, pieces). rows: tag, doc_id, size, source_size, target for each document.
    pieces: tag, slot, rank, r, first_word, words: what each slot takes of each document."""
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")).withColumn("tag", F.monotonically_increasing_id()))
    shares = cut(targets(rows, weights, limit))
    rows = rows.join(shares.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    taken = schedule(shares, block).withColumnRenamed("words", "_room")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    digits = max(2, ceil(log(max(1, rows.count() / SLICE), 16)))  # a slice of the order; its length changes no place
    stream = rows.filter("size > 0").withColumn("key", key).withColumn("slice", F.substring("key", 1, digits))
    stream = running_sum(stream, ["rank"], ["key", "doc_id", "size"], "size", "slice", "at")
    rounds = stream.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(limit - 1))))
    rounds = rounds.withColumn("start", (F.col("round") * F.col("source_size") + F.col("at")).cast("long")).withColumn("stop", F.col("start") + F.col("size"))
    rounds = rounds.filter(F.col("start") < F.floor("target"))  # beyond, no source has a slot
    pieces = rounds.withColumn("r", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))))
    pieces = pieces.select("tag", "rank", "r", "start", "stop").join(taken, ["rank", "r"]).withColumn("_from", F.greatest("start", F.col("r") * block))
    pieces = pieces.withColumn("words", F.least("stop", F.col("r") * block + F.col("_room")) - F.col("_from")).filter("words > 0")
    return rows, pieces.select("tag", "slot", "rank", "r", (F.col("_from") - F.col("start")).alias("first_word"), "words")


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_slots, first_slot (null if nothing is taken): one row per document."""
    rows, pieces = mixed_blocks(docs, **parameters)
    taken = pieces.groupBy("tag").agg(F.sum("words").alias("taken"), F.countDistinct("slot").alias("n_slots"), F.min("slot").alias("first_slot"))
    out = rows.join(taken, "tag", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), "first_slot")


#: DuckDB: the same shares; a stream's words in closed form; the schedule's slots beside them.
SQL = r"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) size, row_number() over () tag from {documents}),
t as (select source, cast(sum(size) as bigint) source_size from d group by source),
w as (select *, cast([5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as double) weight, row_number() over (order by source nulls last) - 1 rank from t),
c as (select *, cast(source_size * 3 as double) cap, cast(source_size * 3 as double) / weight fill from w),
l as (select *, ((select sum(cast(source_size as double)) from c) - coalesce(sum(cap) over b, 0.0)) / ((select sum(weight) from c) - coalesce(sum(weight) over b, 0.0)) lev
      from c window b as (order by fill, rank rows between unbounded preceding and 1 preceding)),
s as (select source, source_size, rank, least(cap, (select lev from l where lev <= fill order by fill, rank limit 1) * weight) target from l),
p as (select d.tag, d.doc_id, d.size, s.rank, s.source_size, s.target, cast(floor(s.target) as bigint) words,
        cast(coalesce(sum(d.size) over (partition by d.source order by md5(concat('mix:', cast(d.doc_id as varchar))), d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as bigint) pos
      from d join s on d.source is not distinct from s.source),
e as (select rank, cast(ceil(floor(target) / 4096) as bigint) need from s),
h as (select rank, sum(target) over (order by rank) / (select sum(target) from s) hi from s where target > 0),
z as (select rank, coalesce(lag(hi) over (order by rank), 0.0) lo, case when lead(hi) over (order by rank) is null then 1.0 else hi end hi from h),
u as (select i slot, (i + 0.5) * 0.6180339887498949 - floor((i + 0.5) * 0.6180339887498949) u from (select unnest(range(cast((select sum(need) from e) as bigint))) i)),
g as (select slot, z.rank, row_number() over (partition by z.rank order by slot) - 1 r from u join z on u >= lo and u < hi),
k as (select slot, g.rank, r from g join e using (rank) where r < need),
m as (select e.rank, need, coalesce(have, 0) have, coalesce(sum(need - coalesce(have, 0)) over (order by e.rank rows between unbounded preceding and 1 preceding), 0) ahead from e left join (select rank, count(*) have from k group by rank) using (rank)),
q as (select * from k union all select cast((select sum(need) from e) + ahead + r - have as bigint), rank, r from (select *, unnest(range(have, need)) r from m)),
x as (select tag, rank, n * source_size + pos a, least(n * source_size + pos + size, words) b from p, range(3) o(n) where size > 0 and n * source_size + pos < words),
y as (select tag, count(distinct slot) n_slots, min(slot) first_slot from (select *, unnest(range(a // 4096, (b - 1) // 4096 + 1)) r from x) join q using (rank, r) group by tag)
select doc_id, size, source_size, target,
  cast(case when source_size = 0 then 0 else (words // source_size) * size + greatest(0, least(size, words % source_size - pos)) end as bigint) taken,
  coalesce(n_slots, 0) n_slots, first_slot from p left join y using (tag)
"""
