"""Registered queries over vector and index files: the table is written in each format, read again, and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from vexel.functions import parsing, vector
from vexel.operators import brute, evaluation, ivf, kmeans, layout, pq, quant
from vexel.plans import sql as S
from vexel.plans.queries import base_of, built, folder, queries_of, query, rounded, shared
from vexel.sources import vectors as V

_PLACED = f"select place id, round({S.dot('embedding', 'embedding')}, 6) norm2, round(embedding[1]::double, 6) first, round(embedding[len(embedding)]::double, 6) last from {S.PLACE}"
_BYTES = f"with {S.U8} select row_number() over (order by id) - 1 id, array_to_string(codes, ',') codes from u"


def _written(spark, d, kind, rows=None, parts=False):
    """A file, or a folder of parts, of the table."""
    at = f"{folder(spark)}/base.{kind}"
    (V.write_parts if parts else V.write_vectors)(base_of(spark, d) if rows is None else rows, at, kind)
    return at


def _bytes(spark, d):
    b = base_of(spark, d).select("id", "vec")
    return quant.MinMaxU8().train(b).encode(b).select("id", F.col("codes").alias("vec"))


def _ends(rows):
    return rows.select("id", F.round(vector.l2_squared("vec"), 6).alias("norm2"), *(F.round(F.element_at("vec", k).cast("double"), 6).alias(n) for k, n in ((1, "first"), (-1, "last"))))


def _joined(rows):
    return rows.select("id", F.array_join("vec", ",").alias("codes"))


@query(_PLACED)
def file_fvecs(spark, d):
    return _ends(V.read_vectors(spark, _written(spark, d, "fvecs"), rows=100))


@query(_PLACED)
def file_fbin(spark, d):
    return _ends(V.read_vectors(spark, _written(spark, d, "fbin"), rows=100))


@query(_PLACED)
def file_parts(spark, d):
    """A folder of files that the tasks wrote."""
    return _ends(V.read_vectors(spark, _written(spark, d, "fbin", parts=True)))


@query(f"select place id, array_to_string(list_transform(embedding, lambda x: round_even(x::double * 1000, 0)::int), ',') codes from {S.PLACE}")
def file_ivecs(spark, d):
    rows = base_of(spark, d).select("id", F.transform("vec", lambda x: F.bround(x.cast("double") * 1000).cast("int")).alias("vec"))
    return _joined(V.read_vectors(spark, _written(spark, d, "ivecs", rows)))


@query(_BYTES)
def file_bvecs(spark, d):
    return _joined(V.read_vectors(spark, _written(spark, d, "bvecs", _bytes(spark, d))))


@query(_BYTES)
def file_u8bin(spark, d):
    return _joined(V.read_vectors(spark, _written(spark, d, "u8bin", _bytes(spark, d), parts=True)))


@query(f"{_PLACED} where place < 100")
def file_first_rows(spark, d):
    """The reader's max_n."""
    return _ends(V.read_vectors(spark, _written(spark, d, "fvecs"), max_n=100))


@query(f"{_PLACED} where vec_id % {S.EVERY} = 0")
def file_stated_rows(spark, d):
    """The rows of a stated set of ids."""
    return _ends(V.read_rows(V.read_vectors(spark, _written(spark, d, "fbin")), queries_of(spark, d).select(F.col("qid").alias("id"))))


@query("select kind, count(*)::bigint n, max(len(embedding))::bigint dim, skip::bigint skip, (max(len(embedding)) * width + own)::bigint width from embeddings, (values ('fvecs', 0, 4, 4), ('fbin', 8, 4, 0), ('u8bin', 8, 1, 0)) k(kind, skip, width, own) group by kind, skip, width, own")
def file_shapes(spark, d):
    """What the headers say: rows, values, bytes before the first row, bytes of a row."""
    out = [(k, *V.shape(_written(spark, d, k, _bytes(spark, d) if k == "u8bin" else None), k)) for k in ("fvecs", "fbin", "u8bin")]
    return spark.createDataFrame(out, "kind string, n bigint, dim bigint, skip bigint, width bigint")


_NAMES = ("a/base.fvecs", "truth.ivecs", "x.bvecs", "y.U8BIN", "z.fbin", "t.gt", "no-ending", "dots.in.name.dat")


@query("select name, case when regexp_matches(lower(name), '\\.(fvecs|ivecs|bvecs|u8bin|fbin|gt)$') then regexp_extract(lower(name), '\\.([a-z0-9]+)$', 1) else 'u8bin' end kind from (select unnest([" + ", ".join(f"'{n}'" for n in _NAMES) + "]) as name)")
def file_formats(spark, d):
    return spark.createDataFrame([(n, V.infer_format(n)) for n in _NAMES], "name string, kind string")


@query(f"with {S.BASE}, r as ({S.knn(k=100)}) select dense_rank() over (order by qid) - 1 qid, rank, id from r where rank <= {S.K}")
def file_truth(spark, d):
    """A hundred neighbours of each query are written, ten are read."""
    at = f"{folder(spark)}/truth.gt"
    V.write_truth(brute.brute_force_knn(base_of(spark, d), queries_of(spark, d), 100), at, 100)
    return V.read_truth(spark, at, S.K)


@query(_BYTES)
def file_bvecs_to_u8bin(spark, d):
    source = _written(spark, d, "bvecs", _bytes(spark, d))
    V.bvecs_to_u8bin(spark, source, f"{source}.u8bin")
    return _joined(V.read_vectors(spark, f"{source}.u8bin"))


@query(f"{_BYTES.replace(' codes from u', ' codes, lo, hi from u, lims')}")
def file_fbin_to_u8bin(spark, d):
    """Bytes between the least and greatest of the rows, which the .scale file keeps."""
    source = _written(spark, d, "fbin")
    V.fbin_to_u8bin(spark, source, f"{source}.u8bin")
    lo, hi, _ = map(float, V.slice_of(f"{source}.u8bin.scale", 0, 999).split())
    return _joined(V.read_vectors(spark, f"{source}.u8bin")).select("*", F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))


@query(f"with {S.trained()} select cid, (p - 1)::int pos, round(x::float::double, 6) x from (select cid, unnest(c) x, generate_subscripts(c, 1) p from c{S.ITERS})")
def file_centroids(spark, d):
    at = f"{folder(spark)}/centroids.fbin"
    V.write_centroids(built(spark, d).centroids, at)
    return kmeans.centroid_frame(spark, V.read_centroids(at)).select("cid", F.posexplode("c").alias("pos", "x")).select("cid", "pos", F.round("x", 6).alias("x"))


@query(f"with {S.index()} select row_number() over (order by id) - 1 id, cid from lists")
def file_assign(spark, d):
    at = f"{folder(spark)}/assign"
    V.write_assign(built(spark, d).lists, at)
    return V.read_assign(spark, at)


def _words(book_sql: str) -> str:
    return f"select m, code, (p - 1)::int pos, round(x::float::double, 6) x from (select m, code, unnest(cw) x, generate_subscripts(cw, 1) p from {book_sql})"


def _book_file(spark, words):
    at = f"{folder(spark)}/codebook"
    V.write_codebook(words, at)
    return pq.Codebook(V.read_codebook(at)).frame(spark).select("m", "code", F.posexplode("cw").alias("pos", "x")).select("m", "code", "pos", F.round("x", 6).alias("x"))


@query(f"with {S.index()}, {S.codes()} {_words('words')}")
def file_codebook(spark, d):
    return _book_file(spark, pq.sampled_codebook(built(spark, d), S.M, S.WORDS).words)


@query(f"with {S.index()}, {S.pq_trained(7, 8, 0)} {_words('words0')}")
def file_codebook_uneven(spark, d):
    """Seven subspaces of ten and nine values."""
    return _book_file(spark, pq.sampled_codebook(built(spark, d), 7, 8).words)


@query(f"with {S.index()}, {S.codes()} select row_number() over (order by cid, id) - 1 pos, codes from (select id, cid, string_agg(code::varchar, ',' order by m) codes from codes group by id, cid)")
def file_codes(spark, d):
    i = built(spark, d)
    at = f"{folder(spark)}/codes"
    V.write_codes(pq.encode(i, pq.sampled_codebook(i, S.M, S.WORDS)), at)
    return V.code_rows(spark, at).select("pos", F.array_join("codes", ",").alias("codes"))


def _dumps(spark, d, kind, rows=None):
    i, at = built(spark, d), folder(spark)
    names = f"{at}/base.{kind}", f"{at}/centroids", f"{at}/assign"
    V.write_vectors(base_of(spark, d) if rows is None else rows, names[0], kind)
    V.write_centroids(i.centroids, names[1])
    V.write_assign(i.lists, names[2])
    return names


_ROUNDED = f"cf as (select cid, list_transform(c, lambda x: x::float::double) c from c{S.ITERS}), probes as materialized ({S.ranked(f'select qid, cid id, {S.l2('q', 'c')} dist from q, cf', S.NPROBE, rank='probe_rank')})"


@query(f"with {S.index()}, {_ROUNDED}, r as ({S.searched()}) {S.result('r')}")
def index_from_dumps(spark, d):
    """Vectors, centroids and lists from files, searched."""
    return rounded(ivf.IVFIndex.from_files(spark, *_dumps(spark, d, "fbin")).search(queries_of(spark, d), S.K, S.NPROBE))


@query(f"with {S.index()} select row_number() over (order by cid, id) - 1 pos, id, cid, round({S.dot('vec', 'vec')}, 6) norm2 from lists")
def load_clustered_floats(spark, d):
    base, _, assign = _dumps(spark, d, "fbin")
    rows = V.load_clustered(spark, base, assign)
    return layout.positions(rows, layout.cluster_info(rows, S.NLIST)).select("pos", "id", "cid", F.round(vector.l2_squared("vec"), 6).alias("norm2"))


@query(f"with {S.index()}, {S.U8} select row_number() over (order by cid, id) - 1 pos, id, cid, array_to_string(codes, ',') codes from lists join u using (id)")
def load_clustered_bytes(spark, d):
    base, _, assign = _dumps(spark, d, "u8bin", _bytes(spark, d))
    rows = V.load_clustered(spark, base, assign, keep_bytes=True)
    return layout.positions(rows, layout.cluster_info(rows, S.NLIST)).select("pos", "id", "cid", F.array_join("vec", ",").alias("codes"))


@query("select id, pos::int pos, round((('0x' || substr(md5(concat_ws(':', id, 5, pos + 1)), 1, 6))::bigint / 8388608.0 - 1)::float::double, 6) x from (select unnest(range(200)) id), (select unnest(range(16)) pos)")
def random_rows(spark, d):
    """Uniform vectors of a seed."""
    return V.random_vectors(spark, 200, 16, 5).select("id", F.posexplode("vec").alias("pos", "x")).select("id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


@query("select event_type, count(*) queries, round(sum(value), 3) total_ms, round(count(*) / sum(value) * 1000, 3) qps from events group by event_type")
def file_results(spark, d):
    """Result rows as they are appended to a CSV file, its header written once, and read again."""
    at = f"{folder(spark)}/results.csv"
    rows = spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("ms"))
    for r in rows.orderBy("event_type").collect():  # one row for each kind of event
        V.append_csv(V.store_of(at)[1], {"event_type": r.event_type, "queries": r.n, "total_ms": round(r.ms, 3), "qps": round(evaluation.throughput(r.n, r.ms), 3)})
    return spark.read.csv(at, header=True, schema="event_type string, queries bigint, total_ms double, qps double")


@query("select count(*) rows, count(distinct user_id) users, round(avg(value), 6) mean from events")
def file_metrics(spark, d):
    """Figures as JSON, written twice, the second time in place of the first."""
    at = f"{folder(spark)}/metrics.json"
    r = spark.read.parquet(f"{d}/events.parquet").agg(F.count("*").alias("rows"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean")).first()
    for figures in ({"rows": -1}, r.asDict()):
        V.write_metrics(at, figures)
    return spark.read.schema("rows bigint, users bigint, mean double").json(at, multiLine=True)


_SCALES, _LISTS = ("sift1m", "deep10m", "SPACEV1B", "250k", "77", "big_ann_2m"), ("1,2, 3", "0.1:0.2,0:0.5", "8")


@query("select name, regexp_extract(lower(name), '([0-9]+)[kmb]?$', 1)::bigint * case right(lower(name), 1) when 'k' then 1000 when 'm' then 1000000 when 'b' then 1000000000 else 1 end n from (select unnest([" + ", ".join(f"'{x}'" for x in _SCALES) + "]) as name)")
def parsed_scales(spark, d):
    return spark.createDataFrame([(x, parsing.scale(x)) for x in _SCALES], "name string, n bigint")


@query("select t as \"text\", place::int place, trim(split_part(x, ':', 1))::double a, case when contains(x, ':') then trim(split_part(x, ':', 2))::double end b from (select t, unnest(string_split(t, ',')) x, unnest(range(len(string_split(t, ',')))) place from (select unnest([" + ", ".join(f"'{x}'" for x in _LISTS) + "]) t))")
def parsed_lists(spark, d):
    rows = []
    for x in _LISTS:
        rows += [(x, i, *p) for i, p in enumerate(parsing.pairs(x))] if ":" in x else [(x, i, float(n), None) for i, n in enumerate(parsing.numbers(x))]
    return spark.createDataFrame(rows, "text string, place int, a double, b double")


_FOUND = f"with {S.index()}, {S.probes()}, r as ({S.searched()})"


@query(f"{_FOUND} select qid, rank, id, round(dist, 6) dist, true first, false again from r")
def catalog_search(spark, d):
    """A saved index is loaded once under its name; a second time nothing happens."""
    at, names = shared(spark), ivf.IndexCatalog()
    built(spark, d).save(at)
    loaded = [names.load(spark, "one", at) for _ in range(2)]
    found = rounded(names.ann_search("one", queries_of(spark, d), S.K, S.NPROBE, view="vexel_found"))
    return found.select("*", F.lit(loaded[0]).alias("first"), F.lit(loaded[1]).alias("again"))


@query(f"{_FOUND} select qid, rank, id, round(dist, 6) dist, 'true,false,true' as made from r")
def index_cache(spark, d):
    """Saved, found again, and built anew once its source has changed."""
    at, source = shared(spark), shared(spark)
    base_of(spark, d).write.parquet(source)
    build = lambda: ivf.IVFIndex.build(spark.read.parquet(source), S.NLIST, iters=S.ITERS)
    made = [ivf.IVFIndex.cached(spark, at, source, build)[1] for _ in range(2)]
    base_of(spark, d).repartition(3).write.mode("overwrite").parquet(source)
    i, again = ivf.IVFIndex.cached(spark, at, source, build)
    return rounded(i.search(queries_of(spark, d), S.K, S.NPROBE)).select("*", F.lit(",".join(str(x).lower() for x in (*made, again))).alias("made"))


@query(f"{_FOUND} {S.result('r')}")
def index_persisted(spark, d):
    i = built(spark, d).persist()
    try:
        found = rounded(i.search(queries_of(spark, d), S.K, S.NPROBE)).toArrow()  # k rows for each query
    finally:
        i.lists.unpersist()
    return spark.createDataFrame(found)
