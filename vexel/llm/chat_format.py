"""Chat formatting by multi-party perspective rotation, in DataFrame operations alone.

For every participant of a conversation the whole dialogue is rendered once more, with that speaker as the assistant,
all others as named users, and a mask over what the assistant says. System turns stay system turns in each rendering.

    <|im_start|>system\n...<|im_end|>\n
    <|im_start|>user name=NAME\n...<|im_end|>\n
    <|im_start|>assistant\n...<|im_end|>\n          masked: from the first character of the text to the end of <|im_end|>

Texts and names cannot forge markers: a backslash becomes two and "<|" becomes "<\\|"; in names a line end becomes "\\n".

A rendering longer than `part_turns` turns goes on in further parts, by turn number; mask places count from the start of
their row. Turns are ordered by (turn, role, text), null turns in a part of their own, -1. A part that holds more than
`part_turns` rows, as turn numbers repeat or are null, is ordered by (turn, digest of role and text, role, text) and goes
on in further pieces of `part_turns` rows. So no row of the result, and no group that is collected, holds more turns than
that, whatever the key.

A null role is the participant "unknown"; a null text is empty. A conversation of system turns alone has no
participant and no row. Rows without conv_id form one conversation. Repeated rows are repeated turns. Further columns
are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PART_TURNS = 256
#: Turns of an oversized part that one task numbers, about.
SLICE = 65536
SYSTEM = "system"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def _among(t: DataFrame, large: DataFrame, how: str) -> DataFrame:
    own = large.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"))
    return t.join(own, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), how)


def _pieces(t: DataFrame, large: DataFrame, most: int, part_turns: int) -> DataFrame:
    """Turns of oversized parts, numbered: piece is their number over part_turns. A part is numbered in slices by turn
    and the first digits of a digest, of which `most` rows call for so many; only the slices' counts are summed over it."""
    t = _among(t, large, "left_semi").withColumn("_h", F.md5(F.concat("role", F.lit("\0"), "text")))
    t = t.withColumn("_slice", F.substring("_h", 1, max(1, ceil(log(max(1, most / SLICE), 16)))))
    where = ["conv_id", "part", "turn", "_slice"]
    sizes = t.groupBy(*where).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("conv_id", "part").orderBy("turn", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*(F.col(c).alias(f"_of_{c}") for c in where), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    t = t.join(sizes, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in where)))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*where).orderBy("_h", "role", "text")) - 1
    return t.withColumn("piece", F.floor(place / part_turns).cast("long")).withColumn("order", F.struct("turn", "_h")).select("conv_id", "turn", "role", "text", "part", "piece", "order")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, participant, part, piece, n_turns, n_masked (turns), dialogue, mask ("start:stop,...", code points)."""
    t = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), _escaped(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
    ).withColumn("part", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long"))
    people = t.filter(F.col("role") != SYSTEM).groupBy(F.col("conv_id").alias("_conv")).agg(F.array_sort(F.collect_set("role")).alias("people"))
    large = t.groupBy("conv_id", "part").count().filter(F.col("count") > part_turns)
    most = large.agg(F.max("count")).first()[0]
    usual = t.withColumn("piece", F.lit(0).cast("long")).withColumn("order", F.struct("turn", F.lit("").alias("_h")))
    if most is not None:
        usual = _among(usual, large, "left_anti").unionByName(_pieces(t, large, most, part_turns))
    parts = usual.groupBy("conv_id", "part", "piece").agg(F.array_sort(F.collect_list(F.struct("order", "role", "text"))).alias("turns"))
    each = parts.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "part", "piece", "turns", F.explode("people").alias("participant"))

    def head(x: Column) -> Column:
        name = F.replace(_escaped(x["role"]), F.lit("\n"), F.lit("\\n"))
        who = F.when(x["role"] == SYSTEM, F.lit(SYSTEM)).when(x["role"] == F.col("participant"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name))
        return F.concat(F.lit("<|im_start|>"), who, F.lit("\n"))

    made = F.transform("turns", lambda x: F.struct(head(x).alias("head"), F.concat(x["text"], F.lit("<|im_end|>")).alias("body"), (x["role"] == F.col("participant")).alias("own")))
    each = each.select("conv_id", "participant", "part", "piece", made.alias("made"))
    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("mask"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["head"])
        stop = start + F.length(x["body"])
        place = F.concat_ws(":", start.cast("string"), stop.cast("string"))
        return F.struct((stop + 1).alias("at"), F.when(x["own"], F.concat(a["mask"], F.array(place))).otherwise(a["mask"]).alias("mask"))

    return each.select(
        "conv_id", "participant", "part", "piece", F.size("made").cast("long").alias("n_turns"),
        F.size(F.filter("made", lambda x: x["own"])).cast("long").alias("n_masked"),
        F.array_join(F.transform("made", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("dialogue"),
        F.array_join(F.aggregate("made", begin, step)["mask"], ",").alias("mask"),
    )


#: DuckDB: segments by turn, their ends by a running sum; oversized parts numbered anew.
SQL = r"""
with r as (select conv_id, turn, coalesce(role, 'unknown') as who, replace(replace(coalesce(text, ''), '\', '\\'), '<|', '<\|') as said, coalesce(turn // 256, -1) as part from {conversations}),
c as (select *, case when count(*) over (partition by conv_id, part) > 256 then md5(encode(who) || '\x00'::blob || encode(said)) else '' end as tie from r),
t as (select * exclude (tie), tie, case when tie = '' then 0 else (row_number() over (partition by conv_id, part order by turn nulls first, tie, who, said) - 1) // 256 end as piece from c),
p as (select distinct conv_id, who as participant from t where who <> 'system'),
s as (select t.conv_id, p.participant, t.part, t.piece, t.turn, t.tie, t.who, t.said, t.who = p.participant as own, row_number() over () as n,
        '<|im_start|>' || case when t.who = 'system' then 'system' when t.who = p.participant then 'assistant' else 'user name=' || replace(replace(replace(t.who, '\', '\\'), '<|', '<\|'), chr(10), '\n') end || chr(10) as head
      from t join p on t.conv_id is not distinct from p.conv_id),
e as (select *, sum(length(head) + length(said) + 11) over (partition by conv_id, participant, part, piece order by turn nulls first, tie, who, said, n) as stop from s)
select conv_id, participant, cast(part as bigint) as part, cast(piece as bigint) as piece, count(*) as n_turns, count(*) filter (own) as n_masked,
  string_agg(head || said || '<|im_end|>' || chr(10), '' order by turn nulls first, tie, who, said, n) as dialogue,
  coalesce(string_agg(cast(stop - 11 - length(said) as bigint)::varchar || ':' || cast(stop - 1 as bigint)::varchar, ',' order by turn nulls first, tie, who, said, n) filter (own), '') as mask
from e group by conv_id, participant, part, piece
"""
