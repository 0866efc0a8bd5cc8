"""Registered queries over the driver's tables: one for each operator, over the whole `embeddings` table.

The query set is every row whose id is divisible by twenty, searched against all rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel.functions import hashing, vector
from vexel.operators import brute, evaluation, ivf, kmeans, layout, pq, quant, updates
from vexel.operators.topk import distinct_topk, padded, topk
from vexel.plans import sql as S
from vexel.sources import vectors as files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def base_of(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def queries_of(spark: SparkSession, d: str) -> DataFrame:
    return base_of(spark, d).filter(F.col("id") % S.EVERY == 0).select(F.col("id").alias("qid"), F.col("vec").alias("q"))


def both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return base_of(spark, d).select("id", "vec"), queries_of(spark, d)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names or ("dist",)})


def built(spark: SparkSession, d: str, metric: str = "l2") -> ivf.IVFIndex:
    return ivf.IVFIndex.build(base_of(spark, d), S.NLIST, metric, iters=S.ITERS)


def shared(spark: SparkSession) -> str:
    """A folder of this run that driver and executors share. Where spark.checkpoint.dir is unset and all run in one
    machine, as in tests, a folder of our own; on a cluster that would lose data and is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="vexel-")
    return f"{root}/{uuid.uuid4().hex}"


def folder(spark: SparkSession) -> str:
    """shared(), made."""
    store, at = files.store_of(path := shared(spark))
    store.create_dir(at, recursive=True)
    return path


# Scalar vector functions


@query("select vec_id id, round(sqrt(" + S.dot("embedding", "embedding") + "), 6) norm from embeddings")
def l2_norm(spark, d):
    return base_of(spark, d).select("id", F.round(vector.l2_norm("vec"), 6).alias("norm"))


@query("select vec_id id, round(" + S.dot("embedding", "embedding") + ", 6) norm2 from embeddings")
def l2_squared(spark, d):
    return base_of(spark, d).select("id", F.round(vector.l2_squared("vec"), 6).alias("norm2"))


def _pairs(spark, d) -> DataFrame:
    b, q = both(spark, d)
    return b.crossJoin(brute.small(q))  # a stated query set


@query(f"with {S.BASE} select qid, id, round({S.dot('q', 'vec')}, 6) ip from b, q")
def inner_product(spark, d):
    return _pairs(spark, d).select("qid", "id", F.round(vector.inner_product("q", "vec"), 6).alias("ip"))


@query(f"with {S.BASE} select qid, id, round({S.l2('q', 'vec')}, 6) dist from b, q")
def l2_distance(spark, d):
    return rounded(brute.all_pairs(*both(spark, d), {"dist": "l2"}))


@query(f"with {S.BASE} select qid, id, round({S.cosine('q', 'vec')}, 6) dist from b, q")
def cosine_distance(spark, d):
    return rounded(brute.all_pairs(*both(spark, d), {"dist": "cosine"}))


@query(f"with {S.BASE} select qid, id, round({S.l2('q', 'vec')}, 6) l2, round({S.dot('q', 'vec')}, 6) ip, round(sqrt({S.dot('vec', 'vec')}), 6) norm, round({S.cosine('q', 'vec')}, 6) cos from b, q")
def sql_functions(spark, d):
    b, q = both(spark, d)
    vector.register_pairs(spark, q)
    b.select(F.col("id").cast("long").alias("id"), "vec").createOrReplaceTempView("vexel_rows")
    return spark.sql("select qid, id, round(l2, 6) l2, round(ip, 6) ip, round(norm, 6) norm, round(cos, 6) cos from vexel_distances(table(select id, vec from vexel_rows))")


@query("select vec_id id, list_transform(embedding, lambda x: round_even(greatest(0.0, least(255.0, x::double * 100)), 0)::smallint) codes from embeddings".replace("list_transform", "array_to_string(list_transform", 1).replace("::smallint) codes", "::smallint), ',') codes"))
def query_to_u8(spark, d):
    scaled = F.transform("vec", lambda x: x.cast("double") * 100)
    return base_of(spark, d).select("id", F.array_join(vector.to_u8(scaled), ",").alias("codes"))


_U8 = S.U8


@query(f"with {_U8} select id, array_to_string(codes, ',') codes from u")
def u8_quantize(spark, d):
    b = base_of(spark, d)
    return quant.MinMaxU8().train(b).encode(b).select("id", F.array_join("codes", ",").alias("codes"))


@query(f"with {_U8} select x.id qid, y.id id, list_sum(list_transform(list_zip(x.codes, y.codes), lambda v: (v[1]::bigint - v[2]::bigint) * (v[1]::bigint - v[2]::bigint)))::bigint dist from u x, u y where x.id % {S.EVERY} = 0")
def u8_l2(spark, d):
    b = base_of(spark, d)
    u = quant.MinMaxU8().train(b).encode(b).select("id", "codes")
    q = u.filter(F.col("id") % S.EVERY == 0).select(F.col("id").alias("qid"), F.col("codes").alias("q"))
    found = brute.all_pairs(u.select("id", F.col("codes").alias("vec")), q, {"dist": "l2"})  # whole numbers, exact in doubles
    return found.select("qid", "id", F.col("dist").cast("long").alias("dist"))


@query("select min(list_min(embedding))::double lo, max(list_max(embedding))::double hi from embeddings")
def min_max(spark, d):
    return base_of(spark, d).agg(F.min(F.array_min("vec")).cast("double").alias("lo"), F.max(F.array_max("vec")).cast("double").alias("hi"))


@query(f"with {S.index()} select id, cid, round({S.dot('res', 'res')}, 6) norm2 from (select id, l.cid, list_transform(list_zip(vec, c), lambda x: x[1]::double - x[2]::double) res from lists l join c{S.ITERS} using (cid))")
def residual(spark, d):
    i = built(spark, d)
    c = F.broadcast(kmeans.centroid_frame(spark, i.centroids))
    return i.lists.join(c, "cid").select("id", "cid", F.round(vector.l2_squared(vector.residual("vec", "c")), 6).alias("norm2"))


_HALF = S.floating("x", -14, 10)
_SHIFTED = "list_transform(embedding, lambda x: (x::double - 0.1) * 2.0)"


@query(f"select vec_id id, {S.codes_and_error(_SHIFTED, _HALF[0], f'({_HALF[1]}::float / 2.0::float + 0.1::float)')} from embeddings")
def fp16_linear(spark, d):
    """Codes in half precision and what they decode to."""
    z = quant.Fp16Linear(2.0, 0.1)
    out = z.decode(z.encode(base_of(spark, d).select("id", "vec")))
    return out.select("id", F.hex("codes").alias("codes"), F.round(vector.l2_distance("vec", "decoded"), 9).alias("error"))


_MEANS = "(select list(x order by p) from (select p, round(avg(x), 9)::float x from (select unnest(embedding)::double x, generate_subscripts(embedding, 1) p from embeddings) group by p))"
_CENTRED = "list_transform(list_zip(embedding, mean), lambda v: v[1]::double - v[2]::double)"
_BACK = f"list_transform(list_zip({_CENTRED}, mean), lambda v: {S.floating('v[1]', -14, 10)[1]}::float + v[2])"


@query(f"select id, codes, round({S.l2('embedding', 'back')}, 9) error from (select vec_id id, embedding, {S.codes_and_error(_CENTRED, _HALF[0], '0.0')}, {_BACK} back from (select *, {_MEANS} mean from embeddings))".replace(f", round({S.l2('embedding', f'list_transform({_CENTRED}, lambda x: 0.0)')}, 9) error, {_BACK} back", f", {_BACK} back"))
def fp16_centred(spark, d):
    """What is left after the mean, in half precision, and what it decodes to."""
    b = base_of(spark, d).select("id", "vec")
    z = quant.Fp16Centred().train(b)
    return z.decode(z.encode(b)).select("id", F.hex("codes").alias("codes"), F.round(vector.l2_distance("vec", "decoded"), 9).alias("error"))


_BRAIN = S.floating("x", -126, 7)


@query(f"select vec_id id, {S.codes_and_error('list_transform(embedding, lambda x: x::double)', _BRAIN[0], f'{_BRAIN[1]}::float')} from embeddings")
def bf16_codes(spark, d):
    """Brain-float codes and what they decode to."""
    z = quant.Bf16()
    out = z.decode(z.encode(base_of(spark, d).select("id", "vec")))
    return out.select("id", F.hex("codes").alias("codes"), F.round(vector.l2_distance("vec", "decoded"), 9).alias("error"))


@query(f"select id, h::varchar h from {S.splitmixed('(select vec_id id from embeddings)')}")
def splitmix64(spark, d):
    return base_of(spark, d).select("id", hashing.splitmix64(F.col("id")).cast("string").alias("h"))


@query(f"select id from {S.splitmixed('(select vec_id id from embeddings)')} where h::uhugeint < {int(0.2 * ((1 << 64) - 1))}::uhugeint")
def deleted_ids(spark, d):
    return updates.tombstones(base_of(spark, d), 0.2)


@query(f"select vec_id id, (((vec_id::uhugeint * 11400714819323198485::uhugeint) % {S.MASK}::uhugeint) % {S.NLIST})::int cid from embeddings")
def hashed_lists(spark, d):
    return base_of(spark, d).select("id", hashing.hashed_list(F.col("id"), S.NLIST).alias("cid"))


_SALTS = [hashing.GOLDEN * (m + 1) & hashing.FULL for m in range(4)]
_CODES = ", ".join(f"s{m} as (select id, h from {S.splitmixed(f'(select xor(vec_id::ubigint, {x}::ubigint) id from embeddings)')})" for m, x in enumerate(_SALTS))


@query(f"with {_CODES} select vec_id id, " + ", ".join(f"(s{m}.h & 255::ubigint)::smallint code{m}" for m in range(4)) + " from embeddings " + " ".join(f"join s{m} on s{m}.id = xor(vec_id::ubigint, {x}::ubigint)" for m, x in enumerate(_SALTS)))
def synthetic_codes(spark, d):
    return base_of(spark, d).select("id", *(hashing.synthetic_code(F.col("id"), m).alias(f"code{m}") for m in range(4)))


# Nearest neighbours


@query(f"with {S.BASE}, r as ({S.knn()}) {S.result('r')}")
def knn_l2(spark, d):
    return rounded(brute.brute_force_knn(*both(spark, d), S.K))


@query(f"with {S.BASE}, r as ({S.knn()}) {S.result('r')}")
def knn_l2_sql(spark, d):
    return rounded(brute.brute_force_knn(*both(spark, d), S.K, impl="sql"))


@query(f"with {S.BASE}, r as ({S.knn('cosine')}) {S.result('r')}")
def knn_cosine(spark, d):
    return rounded(brute.brute_force_knn(*both(spark, d), S.K, "cosine"))


@query(f"with {S.BASE}, r as ({S.knn(where='label = 3')}) {S.result('r')}")
def knn_filtered(spark, d):
    return rounded(brute.brute_force_knn(base_of(spark, d).filter("label = 3"), queries_of(spark, d), S.K))


@query(f"with {S.BASE}, r as ({S.knn(where='id <> qid')}) {S.result('r')}")
def knn_excluding_self(spark, d):
    return rounded(brute.brute_force_knn(*both(spark, d), S.K, exclude_self=True))


@query(f"with {S.BASE}, r as ({S.knn(k=100)}) {S.result('r')}")
def groundtruth(spark, d):
    return rounded(brute.brute_force_knn(*both(spark, d), 100))


@query(f"with {S.BASE}, r as ({S.ranked('select qid, id, ' + S.dot('q', 'vec') + ' dist from b, q', S.K, order='dist desc, id')}) {S.result('r')}")
def select_k_largest(spark, d):
    return rounded(brute.largest_k(*both(spark, d), S.K))


@query(f"with {S.BASE}, r as ({S.knn(where='(id + qid) % 3 <> 0')}) {S.result('r')}")
def masked_knn(spark, d):
    b, q = both(spark, d)
    slots = b.select("id").crossJoin(brute.small(q.select("qid"))).select("qid", F.when((F.col("id") + F.col("qid")) % 3 == 0, -1).otherwise(F.col("id")).alias("id"))
    return rounded(brute.masked_knn(b, slots, q, S.K))


@query(f"with {S.BASE}, r as ({S.knn()}), s as (select r1.qid qid, r1.id nearest, b1.label = b2.label same from r r1 join b b1 on b1.id = r1.qid join b b2 on b2.id = r1.id) select qid, count(*) n, count(*) filter (same) same_label from s group by qid")
def label_agreement(spark, d):
    b = base_of(spark, d).select("id", "label")
    r = brute.brute_force_knn(*both(spark, d), S.K)
    x = r.join(b.select(F.col("id").alias("qid"), F.col("label").alias("l1")), "qid").join(b.withColumnRenamed("label", "l2"), "id")
    return x.groupBy("qid").agg(F.count("*").alias("n"), F.count_if(F.col("l1") == F.col("l2")).alias("same_label"))


# k-means


def _centroid_rows(spark, c) -> DataFrame:
    return kmeans.centroid_frame(spark, c).select("cid", F.posexplode("c").alias("pos", "x")).select("cid", "pos", F.round("x", 6).alias("x"))


def _centroid_sql(iters: int, rows: str = "b") -> str:
    return f"with {S.trained(iters, rows)} select cid, (p - 1)::int pos, round(x, 6) x from (select cid, unnest(c) x, generate_subscripts(c, 1) p from c{iters})"


@query(_centroid_sql(0))
def kmeans_init(spark, d):
    return _centroid_rows(spark, kmeans.init_sample(base_of(spark, d), S.NLIST))


@query(_centroid_sql(1))
def kmeans_step(spark, d):
    b = base_of(spark, d)
    return _centroid_rows(spark, kmeans.lloyd_step(b, kmeans.init_sample(b, S.NLIST)))


@query(_centroid_sql(S.ITERS))
def kmeans_3iter(spark, d):
    return _centroid_rows(spark, kmeans.lloyd(base_of(spark, d), S.NLIST, S.ITERS))


@query(f"with {S.index()} select id, cid, round(cdist, 6) cdist from lists")
def kmeans_assign(spark, d):
    b = base_of(spark, d).select("id", "vec")
    return rounded(kmeans.assign_nearest(b, kmeans.lloyd(b, S.NLIST, S.ITERS)).select("id", "cid", "cdist"), "cdist")


@query(f"with {S.trained(0)}, {S.nearest('lists', 'c0')} select id, cid, round(cdist, 6) cdist from lists")
def kmeans_assign_sql(spark, d):
    b = base_of(spark, d).select("id", "vec")
    return rounded(kmeans.assign_nearest_sql(b, kmeans.centroid_frame(spark, kmeans.init_sample(b, S.NLIST))).select("id", "cid", "cdist"), "cdist")


@query(f"with {S.index()} select round(sum(cdist), 6) objective from lists")
def kmeans_objective(spark, d):
    b = base_of(spark, d)
    return rounded(kmeans.objective(kmeans.assign_nearest(b, kmeans.lloyd(b, S.NLIST, S.ITERS))), "objective")


@query(_centroid_sql(S.ITERS, "id < 200"))
def subset_kmeans(spark, d):
    return _centroid_rows(spark, kmeans.subset(base_of(spark, d), S.NLIST, 200, S.ITERS))


_BATCH = ", ".join([
    S.trained(0), "w0 as (select id, vec from b where id between 0 and 127)", S.nearest("a0", "c0", "w0"),
    "m0 as materialized (select o.cid, coalesce(n.c, o.c) c, coalesce(n.n, 0) seen from c0 o left join (select cid, max(n) n, list(x order by p) c from (select cid, p, count(*) n, round(avg(x), 9) x from (select cid, unnest(vec)::double x, generate_subscripts(vec, 1) p from a0) group by cid, p) group by cid) n using (cid))",
    "w1 as (select id, vec from b where id between 128 and 255)", S.nearest("a1", "m0", "w1"),
    "m1 as materialized (select o.cid, p, round((1.0 - 1.0 / (seen + 1.0)) * c[p] + (1.0 / (seen + 1.0)) * coalesce(x, c[p]), 9) x from (select cid, c, seen, unnest(range(1, len(c) + 1)) p from m0) o left join (select cid, p, avg(x) x from (select cid, unnest(vec)::double x, generate_subscripts(vec, 1) p from a1) group by cid, p) n using (cid, p))",
])


@query(f"with {_BATCH} select cid, (p - 1)::int pos, round(x, 6) x from m1")
def minibatch_steps(spark, d):
    """Two windows, each of 128 consecutive ids."""
    b = base_of(spark, d)
    c, seen = kmeans.init_sample(b, S.NLIST), [0] * S.NLIST
    import numpy as np

    c, seen = kmeans.minibatch_step(b.filter("id between 0 and 127"), c, np.array(seen))
    return _centroid_rows(spark, kmeans.minibatch_step(b.filter("id between 128 and 255"), c, seen)[0])


def _rows_of(c: str) -> str:
    return f"select cid, (p - 1)::int pos, round(x, 6) x from (select cid, unnest(c) x, generate_subscripts(c, 1) p from {c})"


@query(f"with {S.minibatch(80)} {_rows_of('m80')}")
def minibatch_kmeans(spark, d):
    """Eighty windows of 32,768 ids. The SQL holds for tables of one window, where each of them is the whole table."""
    return _centroid_rows(spark, kmeans.minibatch(base_of(spark, d), S.NLIST))


@query(f"with {S.minibatch(1)} {_rows_of('m1')}")
def minibatch_pass(spark, d):
    """Consecutive windows that cover the table. The SQL holds for tables of one window."""
    return _centroid_rows(spark, kmeans.minibatch_pass(base_of(spark, d), S.NLIST))


@query(f"with {S.trained(S.ITERS, 'id < 200')}, {S.nearest('lists', f'c{S.ITERS}')} select id, cid, round(cdist, 6) cdist from lists")
def subset_assign(spark, d):
    """All rows, to the centroids that the first rows have trained."""
    b = base_of(spark, d).select("id", "vec")
    return rounded(kmeans.assign_nearest(b, kmeans.subset(b, S.NLIST, 200, S.ITERS)).select("id", "cid", "cdist"), "cdist")


@query(f"with {S.hierarchical()} {_rows_of('h')}")
def hierarchical_kmeans(spark, d):
    return _centroid_rows(spark, kmeans.balanced_hierarchical(base_of(spark, d), S.NLIST, iters=S.ITERS))


# Layout


@query(f'with {S.index()}, {S.blocks()} select cid, n "count", o "offset" from o')
def cluster_info(spark, d):
    return layout.cluster_info(built(spark, d).lists, S.NLIST)


@query(f"with {S.index()} select id, cid, row_number() over (order by cid, id) - 1 pos from lists")
def cluster_positions(spark, d):
    i = built(spark, d)
    return layout.positions(i.lists, layout.cluster_info(i.lists, S.NLIST)).select("id", "cid", "pos")


@query(f"with {S.index()}, {S.blocks()} select * from blocks")
def bcs_blocks(spark, d):
    return layout.blocks(layout.cluster_info(built(spark, d).lists, S.NLIST), S.BCS)


@query(f"with {S.index()} select cid, id, ((row_number() over (partition by cid order by id) - 1) // {S.BCS})::int block_no from lists")
def bcs_rebalance(spark, d):
    return layout.rebalance(built(spark, d).lists, S.BCS).select("cid", "id", "block_no")


@query(f"with {S.index()}, {S.blocks()} select round(stddev_samp(size), 6) spread from blocks")
def bcs_spread(spark, d):
    b = layout.blocks(layout.cluster_info(built(spark, d).lists, S.NLIST), S.BCS)
    return b.agg(F.round(F.stddev_samp("size"), 6).alias("spread"))


@query("select unnest([" + ", ".join(f"'{c}'" for c in layout.CHECKS) + ']) "check", 0::bigint violations')
def block_validate(spark, d):
    i = built(spark, d)
    info = layout.cluster_info(i.lists, S.NLIST)
    return layout.block_faults(info, layout.blocks(info, S.BCS), i.lists, S.BCS)


# Inverted-file search


@query(f"with {S.index()}, {S.probes()} select qid, probe_rank, id cid, round(dist, 6) coarse_dist from probes")
def ivf_route(spark, d):
    return rounded(built(spark, d).route(queries_of(spark, d), S.NPROBE), "coarse_dist")


@query(f"with {S.index()}, {S.probes(metric='cosine')} select qid, probe_rank, id cid, round(dist, 6) coarse_dist from probes")
def ivf_route_sql(spark, d):
    i = built(spark, d)
    return rounded(ivf.route_sql(queries_of(spark, d), kmeans.centroid_frame(spark, i.centroids), S.NPROBE, "cosine"), "coarse_dist")


@query(f"with {S.index()}, {S.probes()}, r as ({S.searched()}) {S.result('r')}")
def ivf_search_l2(spark, d):
    return rounded(built(spark, d).search(queries_of(spark, d), S.K, S.NPROBE))


@query(f"with {S.index()}, {S.probes(metric='cosine')}, r as ({S.searched('cosine')}) {S.result('r')}")
def ivf_search_cosine(spark, d):
    return rounded(built(spark, d, "cosine").search(queries_of(spark, d), S.K, S.NPROBE))


@query(f"with {S.index()}, {S.probes()}, r as ({S.searched()}) {S.result('r')}")
def ivf_scan(spark, d):
    """The equi-join form, for query sets of any size."""
    i, q = built(spark, d), queries_of(spark, d)
    return rounded(ivf.scan(i.lists, i.route(q, S.NPROBE), q, S.K, impl="sql"))


@query(f"with {S.index()}, {S.probes()}, r as ({S.searched()}) {S.result('r')}")
def ivf_search_blocks(spark, d):
    return rounded(built(spark, d).search(queries_of(spark, d), S.K, S.NPROBE, layout_kind="blocks"))


@query(f"with {S.index()}, {S.probes()}, r as ({S.searched()}), p as (select id, row_number() over (order by cid, id) - 1 pos from lists) select qid, rank, pos, round(dist, 6) dist from r join p using (id)")
def ivf_search_positions(spark, d):
    return rounded(built(spark, d).search(queries_of(spark, d), S.K, S.NPROBE, returns="pos"))


@query(f"with {S.BASE}, r as ({S.knn()}) {S.result('r')}")
def ivf_full_probe(spark, d):
    return rounded(built(spark, d).search(queries_of(spark, d), S.K, S.NLIST))


@query(f"with {S.index()}, {S.probes()}, r as ({S.searched()}) {S.result('r')}")
def ivf_saved_index(spark, d):
    """Written, read again and searched in its shards."""
    at = shared(spark)
    built(spark, d).save(at, "v1")
    return rounded(ivf.IVFIndex.load(spark, at, "v1").search(queries_of(spark, d), S.K, S.NPROBE))


@query(f"with {S.index()}, {S.probes(2)} select qid, p.id cid, l.id, round({S.dot('q', 'vec')}, 6) ip from probes p join q using (qid) join lists l on l.cid = p.id")
def list_inner_products(spark, d):
    i, q = built(spark, d), queries_of(spark, d)
    return rounded(ivf.list_inner_products(i.lists, i.route(q, 2), q), "ip")


@query(f"with {S.index()}, {S.probes(1)}, r as ({S.searched(k=100)}), g as (select qid, unnest(range(1, 101))::int rank from q) select qid, rank, coalesce(id, -1)::bigint id, coalesce(round(dist, 6), 'infinity'::double) dist from g left join r using (qid, rank)")
def ivf_search_padded(spark, d):
    q = queries_of(spark, d)
    return padded(rounded(built(spark, d).search(q, 100, 1)), q, 100)


_TRUTH = f"gt as materialized ({S.knn(k=100)})"


def _recall_sql(found: str, ks: tuple[int, ...]) -> str:
    one = lambda k: f"select {k}::int k, count(r.id) hits, count(*) total, count(r.id) / count(*) recall from (select * from gt where rank <= {k}) g left join (select * from {found} where rank <= {k}) r using (qid, id)"
    return " union all ".join(map(one, ks))


@query(f"with {S.index()}, {S.probes()}, {_TRUTH}, r as materialized ({S.searched(k=100)}) {_recall_sql('r', (1, 10, 100))}")
def recall_at_k(spark, d):
    q = queries_of(spark, d)
    return evaluation.recalls(built(spark, d).search(q, 100, S.NPROBE), brute.brute_force_knn(base_of(spark, d), q, 100))


_SWEEP = (1, 2, 4, 8, 16)


@query(" union all ".join(f"select {n}::int nprobe, * from (with {S.index()}, {S.probes(n)}, {_TRUTH}, r as materialized ({S.searched()}) {_recall_sql('r', (10,))})" for n in _SWEEP))
def recall_sweep(spark, d):
    q = queries_of(spark, d)
    i, truth, out = built(spark, d), brute.brute_force_knn(base_of(spark, d), q, 10), None
    at = shared(spark)
    i.save(at)
    i = ivf.IVFIndex.load(spark, at)
    for n in _SWEEP:
        one = evaluation.recall(i.search(q, 10, n), truth, 10).select(F.lit(n).alias("nprobe"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# Product quantisation


def _quantised(spark, d):
    i = built(spark, d)
    book = pq.sampled_codebook(i, S.M, S.WORDS)
    return i, book, pq.encode(i, book)


@query(f"with {S.index()}, {S.codes()} select id, cid, string_agg(code::varchar, ',' order by m) codes from codes group by id, cid")
def pq_encode(spark, d):
    return _quantised(spark, d)[2].select("id", "cid", F.array_join("codes", ",").alias("codes"))


@query(f"with {S.index()}, {S.probes()}, {S.codes()}, {S.adc()} select qid, rank, id, round(dist, 6) dist from cand")
def pq_adc(spark, d):
    i, book, codes = _quantised(spark, d)
    q = queries_of(spark, d)
    return rounded(pq.adc(codes, i, book, q, i.route(q, S.NPROBE), S.RERANK))


@query(f"with {S.index()}, {S.probes()}, {S.codes()}, {S.adc()} select qid, rank, id, round(dist, 6) dist from cand")
def pq_adc_sql(spark, d):
    i, book, codes = _quantised(spark, d)
    q = queries_of(spark, d)
    return rounded(pq.adc_sql(codes, i, book, q, i.route(q, S.NPROBE), S.RERANK))


_PQ = f"with {S.index()}, {S.probes()}, {S.codes()}, {S.adc()}, r as materialized ({S.ranked('select qid, id, ' + S.l2('q', 'vec') + ' dist from (select distinct qid, id from cand) join q using (qid) join b using (id)', S.K)})"


@query(f"{_PQ} {S.result('r')}")
def pq_search_rerank(spark, d):
    i, book, codes = _quantised(spark, d)
    return rounded(pq.pq_search(codes, i, book, queries_of(spark, d), S.K, S.NPROBE, S.RERANK))


@query(f"{_PQ}, {_TRUTH} {_recall_sql('r', (1, 10))}")
def pq_recall(spark, d):
    i, book, codes = _quantised(spark, d)
    q = queries_of(spark, d)
    return evaluation.recalls(pq.pq_search(codes, i, book, q, S.K, S.NPROBE, S.RERANK), brute.brute_force_knn(base_of(spark, d), q, 100), (1, 10))


def _trained(spark, d):
    """Trained words, fine enough that the best RERANK codes hold the nearest rows of any number of probed ones."""
    i = built(spark, d)
    book = pq.train(i, 30, bits=8, iters=5)
    return i, book, pq.encode(i, book)


@query()
def pq_trained_search(spark, d):
    """Trained words in thirty subspaces of uneven width."""
    i, book, codes = _trained(spark, d)
    return rounded(pq.pq_search(codes, i, book, queries_of(spark, d), S.K, S.NPROBE, S.RERANK))


@query()
def pq_overlay(spark, d):
    """Trained codes under inserts and deletes, reranked."""
    i, book, codes = _trained(spark, d)
    delta = _delta(spark, d, i)
    gone = base_of(spark, d).select("id").unionByName(delta.select("id")).filter("id % 7 = 0")
    return rounded(updates.pq_overlay_search(codes, i, book, queries_of(spark, d), S.K, S.NPROBE, delta, gone, S.RERANK))


# Updates


def _delta(spark, d, index) -> DataFrame:
    b = base_of(spark, d)
    n = b.count()
    w = Window.orderBy("id")
    new = b.filter("id % 10 = 3").select((F.row_number().over(w) - 1).cast("long").alias("local_id"), F.transform("vec", lambda x: (x.cast("double") + 0.01).cast("float")).alias("vec"))
    return updates.delta_segment(new, index, n)


_ALL = f"with {S.index()}, {S.DELTA}, {S.probes()}"


def _overlay_sql(main: str, delta: str, inserted: bool = True) -> str:
    add = f" union all select qid, id, {S.l2('q', 'vec')} dist from delta, q where {delta}" if inserted else ""
    m = f"select qid, l.id, {S.l2('q', 'vec')} dist from probes p join q using (qid) join lists l on l.cid = p.id where {main}"
    return f"{_ALL}, r as ({S.ranked(m + add, S.K)}) {S.result('r')}"


@query(_overlay_sql("true", "true"))
def overlay_insert(spark, d):
    i = built(spark, d)
    return rounded(updates.overlay_search(i, queries_of(spark, d), S.K, S.NPROBE, _delta(spark, d, i)))


@query(_overlay_sql("l.id % 7 <> 0", "", False))
def overlay_delete(spark, d):
    i = built(spark, d)
    return rounded(updates.overlay_search(i, queries_of(spark, d), S.K, S.NPROBE, None, base_of(spark, d).filter("id % 7 = 0").select("id")))


@query(_overlay_sql("l.id % 7 <> 0", "id % 7 <> 0"))
def overlay_mixed(spark, d):
    i = built(spark, d)
    delta = _delta(spark, d, i)
    gone = base_of(spark, d).select("id").unionByName(delta.select("id")).filter("id % 7 = 0")
    return rounded(updates.overlay_search(i, queries_of(spark, d), S.K, S.NPROBE, delta, gone))


@query(f"{_ALL}, {S.nearest('dl', f'c{S.ITERS}', 'delta')}, r as ({S.ranked(f"select qid, dl.id, {S.l2('q', 'vec')} dist from probes p join q using (qid) join dl on dl.cid = p.id", S.K)}) {S.result('r')}")
def delta_search_ivf(spark, d):
    i, q = built(spark, d), queries_of(spark, d)
    return rounded(updates.search_delta(_delta(spark, d, i), q, S.K, i, i.route(q, S.NPROBE), "ivf"))


@query(f"with {S.index()}, {S.probes()}, gone as (select id from {S.splitmixed('(select vec_id id from embeddings)')} where h::uhugeint < {int(0.2 * ((1 << 64) - 1))}::uhugeint), r as ({S.searched(where='l.id not in (select id from gone)')}) {S.result('r')}")
def delete_then_search(spark, d):
    i = built(spark, d)
    return rounded(i.search(queries_of(spark, d), S.K, S.NPROBE, deleted=updates.tombstones(base_of(spark, d), 0.2)))


_INSERTED = f"{S.BASE}, {S.DELTA}, nt as materialized ({S.ranked(f"select qid, id, {S.l2('q', 'vec')} dist from (select id, vec from b union all select id, vec from delta), q", S.K)})"


def _new_truth(spark, d, index) -> DataFrame:
    b, q = both(spark, d)
    return evaluation.insert_aware_truth(brute.brute_force_knn(b, q, S.K), brute.brute_force_knn(_delta(spark, d, index), q, S.K), S.K)


@query(f"with {_INSERTED} select count(distinct qid) affected_queries, count(*) insert_slots, coalesce(min(rank), -1)::bigint rank_min, coalesce(avg(rank), 0.0) rank_avg, count(distinct qid) / (select count(*) from q) affected_ratio, count(*) / ((select count(*) from q) * {S.K}) slot_ratio from nt where id >= {S.N_BASE}")
def insert_impact(spark, d):
    return evaluation.insert_impact(_new_truth(spark, d, built(spark, d)), base_of(spark, d).count(), queries_of(spark, d).count(), S.K)


@query(f"{_ALL}, nt as materialized ({S.ranked(f"select qid, id, {S.l2('q', 'vec')} dist from (select id, vec from b union all select id, vec from delta), q", S.K)}), r as materialized ({S.ranked(f"select qid, l.id, {S.l2('q', 'vec')} dist from probes p join q using (qid) join lists l on l.cid = p.id union all select qid, id, {S.l2('q', 'vec')} dist from delta, q", S.K)}), gt as (select * from nt) {_recall_sql('r', (S.K,))}")
def insert_aware_recall(spark, d):
    i = built(spark, d)
    found = updates.overlay_search(i, queries_of(spark, d), S.K, S.NPROBE, _delta(spark, d, i))
    return evaluation.recall(found, _new_truth(spark, d, i), S.K)


@query(f"with {S.index()}, {S.probes()}, r as materialized ({S.searched(where='l.id % 7 <> 0')}), gt as materialized (select qid, id, row_number() over (partition by qid order by dist, id) rank from ({S.knn(k=100)}) where id % 7 <> 0) {_recall_sql('r', (S.K,))}")
def delete_aware_recall(spark, d):
    q, gone = queries_of(spark, d), base_of(spark, d).filter("id % 7 = 0").select("id")
    truth = evaluation.surviving_truth(brute.brute_force_knn(base_of(spark, d), q, 100), gone, S.K)
    return evaluation.recall(built(spark, d).search(q, S.K, S.NPROBE, deleted=gone), truth, S.K)


@query(f"with {S.BASE}, gt as ({S.knn(k=100)}), t as (select qid, id, dist from gt where id % 7 <> 0 union all select qid, {S.N_BASE} + qid, -1.0 from q) select qid, rank, id from ({S.ranked('select * from t', S.K)})")
def update_targets(spark, d):
    q, n = queries_of(spark, d), base_of(spark, d).count()
    copies = q.select("qid", (F.col("qid") + n).alias("id"))
    return evaluation.update_truth(brute.brute_force_knn(base_of(spark, d), q, 100), S.K, copies, base_of(spark, d).filter("id % 7 = 0").select("id"))


@query("select 0::bigint misses")
def query_copy_misses(spark, d):
    """Every query is inserted once; a search of the inserts must find each copy."""
    b, q = both(spark, d)
    n = b.count()
    top = n  # local ids are the queries' own
    delta = updates.delta_vectors(b, q, top, "query-copy", n, 64).filter(F.col("vec")[0] != updates.FAR).select((F.col("local_id") + n).alias("id"), "vec")
    return evaluation.copy_misses(brute.brute_force_knn(delta, q, S.K), q.select("qid", (F.col("qid") + n).alias("id")))


def _replay_sql(events: list[updates.Event], inserts: str, steps: int, batch: str) -> str:
    """One branch for each query event, against the state that the events before it left. Places are multiples of batch."""
    parts, step, ratio = [], 0, 0.0
    for e in events:
        if e.kind == "insert":
            step += 1
        elif e.kind == "delete":
            ratio = e.delete_to
        else:
            asked = f"qid between {e.qb} * {batch} and {e.qb + e.qn} * {batch} - 1"
            alive = f"l.id not in (select id from hashes where h::uhugeint < {int(ratio * ((1 << 64) - 1))}::uhugeint)" if ratio else "true"
            main = f"select qid, l.id, {S.l2('q', 'vec')} dist from probes p join q using (qid) join lists l on l.cid = p.id where {asked} and {alive}"
            new = f"select qid, id, {S.l2('q', 'vec')} dist from delta, q where {asked} and id < {S.N_BASE} + ceil({inserts} * {step} / {steps})"
            parts.append(f"select {e.seq}::int seq, qid, rank, id, round(dist, 6) dist from ({S.ranked(f'{main} union all {new}', S.K)})")
    return f"{_ALL}, hashes as materialized (select * from {S.splitmixed('(select vec_id id from embeddings)')}) " + " union all ".join(parts)


#: For a table of an even number of rows: two batches of queries, two steps of inserts and of deletes.
_EVENTS = updates.mixed_events(2, 1, 2, 0.2, 2, seed=7)


@query(_replay_sql(_EVENTS, "(select count(*) from delta)", 2, f"({S.N_BASE} // 2)"))
def mixed_replay(spark, d):
    """A seeded interleaving of query batches, inserts and deletes, each batch against the state before it."""
    i, (b, q) = built(spark, d), both(spark, d)
    n = b.count()
    delta = _delta(spark, d, i)
    events = updates.mixed_events(n, n // 2, delta.count(), 0.2, 2, seed=7)
    return rounded(updates.replay(events, i, b, q, delta, S.K, S.NPROBE, n))


@query(f"with {S.BASE}, r as ({S.knn()}), x as (select qid, id, dist from r where rank <= 6 union all select qid, id, dist from r where rank > 3) select qid, rank, id, round(dist, 6) dist from ({S.ranked('select qid, id, min(dist) dist from x group by qid, id', S.K)})")
def merge_without_repeats(spark, d):
    r = brute.brute_force_knn(*both(spark, d), S.K)
    x = r.filter("rank <= 6").unionByName(r.filter("rank > 3"))
    return rounded(distinct_topk(x, S.K).select("qid", "rank", "id", "dist"))


# Evaluation


@query(f"with {S.BASE}, r as ({S.knn()}) select round(sum(dist * rank), 4) checksum from r")
def result_checksum(spark, d):
    return evaluation.checksum(brute.brute_force_knn(*both(spark, d), S.K)).select(F.round("checksum", 4).alias("checksum"))


@query("select round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.9), 6) p90, round(quantile_cont(value, 0.99), 6) p99, round(avg(value), 6) mean, count(value) n from events")
def latency_percentiles(spark, d):
    out = evaluation.percentiles(spark.read.parquet(f"{d}/events.parquet"), "value")
    return rounded(out, "p50", "p90", "p99", "mean")


@query("select event_id, user_id, row_number() over (partition by user_id order by ts, event_id)::int seq, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id)::bigint done from events")
def event_replay_order(spark, d):
    """The order in which a replay applies each user's events, and the state it has reached."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", "user_id", F.row_number().over(w).alias("seq"), F.sum((F.col("event_type") == "purchase").cast("long")).over(w).alias("done"))


from vexel.plans import files as _files, growth as _growth  # noqa: E402,F401  they add theirs to QUERIES and SQL
