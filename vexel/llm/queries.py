"""The opN queries, as (spark, sf_dir) -> DataFrame, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm import chat_format, decontaminate, exact_dedup, jaccard_join, line_dedup, mixing, secrets, suffix_dedup, token_counts, toxicity
from vexel.llm.common import cut, documents, remove, shared_dir

#: Where the public vocabularies lie.
TOKENIZERS = "/opt/tokenizers"


def tidied_and_restored(docs: DataFrame, versions: dict, root: str) -> token_counts.TokenRollup:
    """A rollup after three batches, each of which comes twice and counts once. load: all documents. tidy: texts with runs
    of spaces are revised to one space each, and of equal texts all but that of the smallest doc_id are deleted. restore:
    what tidy has touched is inserted and revised to its whole text again, so that the totals are those of the load.
    Rows without an id, and rows that repeat one, are counted by the load and not touched: a change names one document."""
    rollup = token_counts.TokenRollup(docs.sparkSession, root)
    counted = cut(token_counts.count_tokens(docs, versions))
    alone = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n = 1").select("doc_id")
    text = F.coalesce("text", F.lit(""))
    named = docs.filter("doc_id is not null").select("doc_id", F.sha2(text, 256).alias("h")).join(alone, "doc_id", "left_semi")
    first = named.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = cut(named.join(first, "h").filter("doc_id <> first").select("doc_id"))
    single = docs.filter("doc_id is not null").filter(text.rlike(r"\x20\x20")).withColumn("text", F.regexp_replace("text", r"\x20\x20+", " "))
    revised = token_counts.count_tokens(single, versions).join(alone, "doc_id", "left_semi").join(copies, "doc_id", "left_anti")
    revised = cut(revised.drop(token_counts.ROW).withColumn("op", F.lit("revise")))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("source", "string"), ("lang", "string"), ("tokens", "long"))]
    deleted = copies.select("doc_id", F.explode(F.array(*map(F.lit, versions))).alias("tokenizer"), *none, F.lit("delete").alias("op"))
    touched = copies.unionByName(revised.select("doc_id").distinct())
    restored = counted.drop(token_counts.ROW).join(touched, "doc_id", "left_semi").withColumn("op", F.lit("insert"))
    for name, changes in (("load", counted), ("tidy", revised.unionByName(deleted)), ("restore", restored)):
        for _ in range(2):
            rollup.commit(name, changes, set_aside=True)
    return rollup


def op1_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """All documents under two tokenizer versions, after a load, revisions and deletes, and a batch that restores them."""
    versions = {"words-v1": token_counts.count_words, "byte_bpe_50k-v1": token_counts.byte_pair(f"{tokenizers}/byte_bpe_50k.tiktoken")}
    root = f"{shared_dir(spark)}/token_rollup/{uuid.uuid4().hex}"
    out = cut(tidied_and_restored(documents(spark, sf_dir), versions, root).totals())
    remove(spark, root)
    return out


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).drop("n_chunks")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op5_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(documents(spark, sf_dir)))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.line_dedup(documents(spark, sf_dir)))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(documents(spark, sf_dir)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.digest(toxicity.score_texts(docs, model))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_exact_dedup, op3_mix_sources, op4_decontaminate, op5_chat_rotation, op6_secret_scan, op7_line_dedup, op8_suffix_dedup, op9_toxicity, op10_jaccard_join)}

SQL = {
    "op6_secret_scan": secrets.sql(),
    "op2_exact_dedup": r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') t from documents)
select doc_id, min(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size, doc_id = min(doc_id) over (partition by t) kept, sha256(t) text_sha256 from n
""",
    "op4_decontaminate": r"""
with lower_ as (select 0 b, doc_id id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents
  union all select 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
w as (select b, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') words from lower_),
i as (select id item_id, words, least(10, len(words)) size from w where b = 1 and len(words) > 0),
iw as (select distinct item_id, size, array_to_string(words[p : p + size - 1], ' ') win from (select *, unnest(range(1, len(words) - size + 2)) p from i)),
dw as (select id doc_id, p, size, array_to_string(words[p : p + size - 1], ' ') win from
  (select id, words, size, unnest(range(1, len(words) - size + 2)) p from w, (select distinct size from i) where b = 0)),
h as (select doc_id, p, size, item_id from dw join iw using (size, win)),
hw as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + size)) q from h) group by doc_id),
hi as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, cast(item_id as varchar) item_id from h) group by doc_id)
select w.id doc_id, cast(len(words) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, n_hit is not null contaminated
from w left join hw on hw.doc_id = w.id left join hi on hi.doc_id = w.id where b = 0
""",
    "op3_mix_sources": mixing.SQL.format(documents="documents"),
    "op5_chat_rotation": chat_format.SQL.format(conversations="conversations"),
    "op7_line_dedup": r"""
with x as (select doc_id, string_split(coalesce(text, ''), chr(10)) lines from documents),
l as (select doc_id, unnest(lines) line, generate_subscripts(lines, 1) n from x),
k as (select doc_id, n, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10),
m as (select k.*, c.key is not null gone from k left join c using (key))
select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by n) filter (not gone), '')) kept_sha256 from m group by doc_id
""",
    "op8_suffix_dedup": r"""
with h as (select doc_id, hex(encode(coalesce(text, ''))) x, cast(strlen(coalesce(text, '')) as bigint) n from documents),
w as (select doc_id, p, substr(x, 2 * p + 1, 100) s from (select *, unnest(range(0, n - 49)) p from h where n >= 50)),
c as (select doc_id, p from (select *, min(doc_id) over (partition by s) m from w) where doc_id > m),
i as (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end fresh from c),
r as (select doc_id, min(p) a, max(p) + 50 b from (select *, sum(fresh) over (partition by doc_id order by p) g from i) group by doc_id, g),
k as (select *, lag(b, 1, 0) over (partition by doc_id order by a) before from r),
o as (select k.doc_id, sum(b - a) n_removed, count(*) n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(max(x), 2 * max(b) + 1) kept from k join h using (doc_id) group by k.doc_id)
select h.doc_id, n n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(o.kept, h.x))) kept_sha256 from h left join o using (doc_id)
""",
    "op10_jaccard_join": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') words from documents),
g as (select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
  else list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' ')) end) shingle from w),
n as (select doc_id, count(*) n from g group by doc_id),
i as (select x.doc_id a, y.doc_id b, count(*) both_ from g x join g y on x.shingle = y.shingle and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
l as (select a, b from i join n p on p.doc_id = a join n q on q.doc_id = b where 100 * both_ >= 85 * (p.n + q.n - both_)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from r join e on r.b = e.a)
select w.doc_id, coalesce(max(n.n), 0) n_shingles, min(r.b) component_id from w join r on r.a = w.doc_id left join n on n.doc_id = w.doc_id group by w.doc_id
""",
}
