"""Registered queries of training, layout choice, byte lists, appends, and what inserts and deletes change."""

from __future__ import annotations

from pyspark.sql import functions as F

from vexel.operators import brute, evaluation, ivf, kmeans, layout, pq, quant, updates
from vexel.operators.topk import topk
from vexel.plans import sql as S
from vexel.plans.queries import _ALL, _centroid_rows, _delta, _replay_sql, base_of, both, built, queries_of, query, rounded


@query(f"with {S.index()}, t as (select round(sum(cdist), 6) objective from lists) select cid, (p - 1)::int pos, round(x, 6) x, objective from (select cid, unnest(c) x, generate_subscripts(c, 1) p from c{S.ITERS}), t")
def clustering_fit(spark, d):
    """The class: fit, centroids, objective."""
    k = kmeans.KMeans(S.NLIST, S.ITERS).fit(base_of(spark, d))
    return _centroid_rows(spark, k.centroids).withColumn("objective", F.round(F.lit(k.objective(base_of(spark, d))), 6))


_UNIT, _RATIO, _MOST = 4, 0.12, 11
_SPREADS = f"""sz as (select cid, count(l.id) n from (select unnest(range({S.NLIST}))::int cid) left join lists l using (cid) group by cid),
  tries as (select unnest(range({_UNIT}, greatest({_UNIT}, (select sum(n) // count(*) from sz) // {_UNIT} * {_UNIT})::bigint + 1, {_UNIT})) bcs),
  pieces as (select bcs, least(bcs, n - j * bcs) size from (select bcs, n, unnest(range(ceil(n / bcs)::bigint)) j from sz, tries)),
  spreads as (select bcs, count(*) blocks, case when count(*) > 1 then stddev_samp(size) else 0.0 end spread from pieces group by bcs)"""


@query(f"with {S.index()}, {_SPREADS} select bcs, blocks, round(spread, 6) spread from spreads")
def bcs_spreads(spark, d):
    """Number and spread of the blocks that every candidate size gives."""
    return rounded(layout.block_spreads(layout.cluster_info(built(spark, d).lists, S.NLIST), _UNIT), "spread")


@query(f"with {S.index()}, {_SPREADS} select coalesce(max(bcs), {_UNIT})::bigint bcs from spreads where spread / bcs <= {_RATIO} or blocks > {_MOST} * {S.NLIST}")
def bcs_choice(spark, d):
    info = layout.cluster_info(built(spark, d).lists, S.NLIST)
    return spark.createDataFrame([(layout.choose_bcs(info, _RATIO, _UNIT, _MOST),)], "bcs bigint")


_BROKEN = f"broken as (select cid, block_id, block_no, size + case when block_no = 0 then 1 else 0 end size, \"offset\" from blocks where block_no <> 1)"
_FAULTS = {
    "no clusters": "0", "bad block size": "0", "negative count": "0", "row total differs": "0",
    "block count differs": f"(select count(*) from i left join (select cid, count(*) c from broken group by cid) using (cid) where coalesce(c, 0) <> ceil(n / {S.BCS}))",
    "block numbers not dense": "(select count(*) from (select min(block_id) a, max(block_id) z, count(*) n from broken) where n > 0 and (a <> 0 or z <> n - 1))",
    "empty or oversized block": f"(select count(*) from broken where size <= 0 or size > {S.BCS})",
    "block sizes of a cluster do not add up": "(select count(*) from i left join (select cid, sum(size) s from broken group by cid) using (cid) where coalesce(s, 0) <> n)",
    "blocks overlap or leave gaps": '(select count(*) from (select *, lead("offset") over (order by "offset") next from broken) where next <> "offset" + size)',
    "rows outside their block": "(select count(*) from blocks b full join broken x using (cid, block_no) where coalesce(b.size, 0) <> coalesce(x.size, 0))",
}


@query(f"with {S.index()}, {S.blocks()}, {_BROKEN} " + " union all ".join(f"select '{k}' \"check\", {v}::bigint violations" for k, v in _FAULTS.items()))
def block_validate_broken(spark, d):
    """First blocks one row too large, second ones missing: what each check finds."""
    i = built(spark, d)
    info = layout.cluster_info(i.lists, S.NLIST)
    wrong = layout.blocks(info, S.BCS).filter("block_no <> 1").withColumn("size", F.col("size") + F.when(F.col("block_no") == 0, 1).otherwise(0))
    return layout.block_faults(info, wrong, i.lists, S.BCS)


@query(f"with {S.index()}, {S.probes()}, {S.blocks()} select qid, count(*) lists, sum(ceil(n / {S.BCS}))::bigint chunks, sum(n)::bigint as rows from probes p join i on i.cid = p.id group by qid")
def probe_counts(spark, d):
    i = built(spark, d)
    return evaluation.probe_counts(i.route(queries_of(spark, d), S.NPROBE), layout.cluster_info(i.lists, S.NLIST), S.BCS)


def _bytes_sql(where: str = "true") -> str:
    pairs = f"select qid, l.id, {S.l2_int('x.codes', 'y.codes')} dist from probes p join lists l on l.cid = p.id join u x on x.id = p.qid join u y on y.id = l.id where {where}"
    return f"with {S.index()}, {S.probes()}, {S.U8} select qid, rank, id, dist from ({S.ranked(pairs, S.K)})"


def _codec(spark, d):
    return quant.MinMaxU8().train(base_of(spark, d))


@query(_bytes_sql())
def ivf_search_bytes(spark, d):
    """Lists and queries in bytes, distances in whole numbers."""
    return built(spark, d).search_bytes(_codec(spark, d), queries_of(spark, d), S.K, S.NPROBE)


@query(_bytes_sql("l.id % 7 <> 0"))
def ivf_search_bytes_deleted(spark, d):
    gone = base_of(spark, d).filter("id % 7 = 0").select("id")
    return built(spark, d).search_bytes(_codec(spark, d), queries_of(spark, d), S.K, S.NPROBE, gone)


@query(f"with {S.trained(S.ITERS, 'id % 5 <> 0')}, {S.nearest('lists', f'c{S.ITERS}')}, {S.probes()}, r as ({S.searched()}) {S.result('r')}")
def index_append(spark, d):
    """Built from four rows in five; the fifth is appended; all are searched."""
    b = base_of(spark, d)
    i = ivf.IVFIndex.build(b.filter("id % 5 <> 0"), S.NLIST, iters=S.ITERS).append(b.filter("id % 5 = 0"))
    return rounded(i.search(queries_of(spark, d), S.K, S.NPROBE))


def _trained_sql(m: int) -> str:
    return f"with {S.index()}, {S.pq_trained(m, S.WORDS, 2)} select m, code, (p - 1)::int pos, round(x, 6) x from (select m, code, unnest(cw) x, generate_subscripts(cw, 1) p from words2)"


def _trained_words(spark, d, m):
    book = pq.train(built(spark, d), m, bits=4, iters=2)
    return book.frame(spark).select("m", "code", F.posexplode("cw").alias("pos", "x")).select("m", "code", "pos", F.round("x", 6).alias("x"))


@query(_trained_sql(S.M))
def pq_train(spark, d):
    return _trained_words(spark, d, S.M)


@query(_trained_sql(7))
def pq_train_uneven(spark, d):
    """Subspaces of ten and nine values."""
    return _trained_words(spark, d, 7)


_DELTA_CODES = f"""{S.nearest('dl', f'c{S.ITERS}', 'delta')}, dr as (select id, dl.cid, list_transform(list_zip(vec, c), lambda x: x[1]::double - x[2]::double) res from dl join c{S.ITERS} using (cid)),
  dc as (select id, cid, m, res[m * (len(res) // {S.M}) + 1 : (m + 1) * (len(res) // {S.M})] x from dr, (select unnest(range({S.M}))::int m)),
  dcodes as materialized (select id, cid, m, code from (select id, cid, dc.m, code, row_number() over (partition by id, dc.m order by {S.l2('x', 'cw')}, code) n from dc join words on words.m = dc.m) where n = 1)"""


@query(f"{_ALL}, {S.codes()}, {_DELTA_CODES} select id, cid, string_agg(code::varchar, ',' order by m) codes from dcodes group by id, cid")
def pq_delta_segment(spark, d):
    """Inserted rows, encoded like the published ones."""
    i = built(spark, d)
    delta = _delta(spark, d, i)
    codes = pq.encode(ivf.IVFIndex(i.centroids, delta.select("id", "cid", "vec")), pq.sampled_codebook(i, S.M, S.WORDS))
    return codes.select("id", "cid", F.array_join("codes", ",").alias("codes"))


def _candidates(codes: str) -> str:
    return f"select * from ({S.ranked(f'select qid, id, sum(d) dist from {codes} join lut using (cid, m, code) where id % 7 <> 0 group by qid, id', S.RERANK)})"


_LIVE = "(select id, vec from b union all select id, vec from delta)"


@query(f"{_ALL}, {S.codes()}, {_DELTA_CODES}, {S.adc()}, both_ as materialized (select qid, id from ({_candidates('codes')}) union select qid, id from ({_candidates('dcodes')})), r as ({S.ranked(f"select qid, id, {S.l2('q', 'vec')} dist from both_ join q using (qid) join {_LIVE} using (id)", S.K)}) {S.result('r')}")
def pq_overlay_sampled(spark, d):
    """Codes of published and inserted rows under deletes, reranked."""
    i = built(spark, d)
    book, delta = pq.sampled_codebook(i, S.M, S.WORDS), _delta(spark, d, i)
    return rounded(updates.pq_overlay_search(pq.encode(i, book), i, book, queries_of(spark, d), S.K, S.NPROBE, delta, F.col("id") % 7 == 0, S.RERANK))


_MADE = {
    "far": f"select local_id, list_transform(range(64), lambda x: {updates.FAR}) vec, null::bigint source_id from (select unnest(range(40)) local_id)",
    "query-copy": "select qid local_id, list_transform(q, lambda x: x::double) vec, null::bigint source_id from q where qid < 40",
    "main-sample": "select row_number() over (order by id) - 1 local_id, list_transform(vec, lambda x: x::double) vec, id source_id from b where id % 7 <> 0 qualify row_number() over (order by id) <= 40",
    "random-main-sample": f"select row_number() over (order by k, h, id) - 1 local_id, list_transform(vec, lambda x: x::double) vec, id source_id from (select *, id <> 9 % {S.N_BASE} k, ('0x' || substr(md5(concat_ws(':', id, 9)), 1, 15))::bigint h from b where id % 7 <> 0) qualify row_number() over (order by k, h, id) <= 40",
    "random-u8": "select local_id, list_transform(range(64), lambda i: ('0x' || substr(md5(concat_ws(':', local_id, 9, i + 1)), 1, 2))::bigint::double) vec, null::bigint source_id from (select unnest(range(40)) local_id)",
}
_COPIES = f"select local_id, coalesce(x.vec, f.vec) vec, null::bigint source_id from ({_MADE['far']}) f left join ({_MADE['query-copy']}) x using (local_id)"


@query(f"with {S.BASE} " + " union all ".join(f"select '{k}' as mode, local_id, round({S.dot('vec', 'vec')}, 4) norm2, source_id from ({_COPIES if k == 'query-copy' else v})" for k, v in _MADE.items()))
def delta_modes(spark, d):
    """Forty inserted rows of each mode."""
    b, q = both(spark, d)
    n, kept = b.count(), b.filter("id % 7 = 0").select("id")
    out = None
    for mode in _MADE:
        one = updates.delta_vectors(b, q, 40, mode, n, 64, seed=9, protected=kept).select(F.lit(mode).alias("mode"), "local_id", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("norm2"), "source_id")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {S.index()} select {S.N_BASE} + local_id id, coalesce(l.cid, (((local_id::uhugeint * 11400714819323198485::uhugeint) % {S.MASK}::uhugeint) % {S.NLIST})::int) cid from (select unnest(range(40)) local_id) left join lists l on l.id = local_id * 3 and local_id % 4 <> 0")
def delta_source_lists(spark, d):
    """Inserted rows go to the lists of their source rows; those without a source, to a hashed one."""
    i, n = built(spark, d), base_of(spark, d).count()
    new = spark.range(40).select(F.col("id").alias("local_id"), F.array(F.lit(0.0)).cast("array<float>").alias("vec"), F.when(F.col("id") % 4 != 0, F.col("id") * 3).alias("source_id"))
    return updates.delta_segment(new, i, n, "source").select("id", "cid")


_STATED = [updates.Event(0, "query", 0, 1), updates.Event(1, "insert", insert_to=1), updates.Event(2, "query", 0, 1), updates.Event(3, "delete", delete_to=0.3), updates.Event(4, "query", 0, 1), updates.Event(5, "insert", insert_to=2), updates.Event(6, "query", 0, 1)]


@query(_replay_sql(_STATED, "(select count(*) from delta)", 2, S.N_BASE))
def replay_stated(spark, d):
    """All queries before and after each of three changes."""
    i, (b, q) = built(spark, d), both(spark, d)
    n, delta = b.count(), _delta(spark, d, i)
    m = delta.count()
    events = [updates.Event(e.seq, e.kind, e.qb * n, e.qn * n, -(-m * e.insert_to // 2), e.delete_to) for e in _STATED]
    return rounded(updates.replay(events, i, b, q, delta, S.K, S.NPROBE, n))


_CELLS, _PROBES = [(0, 0.0), (20, 0.0), (0, 0.2), (20, 0.2)], [4, 12]


def _cell(inserts: int, ratio: float, nprobe: int) -> str:
    gone = f"select id from hashes where h::uhugeint < {int(ratio * ((1 << 64) - 1))}::uhugeint" if ratio else "select id from hashes where false"
    new = f"select qid, id, {S.l2('q', 'vec')} dist from delta, q where id < {S.N_BASE} + {inserts}"
    main = f"select qid, l.id, {S.l2('q', 'vec')} dist from probes p join q using (qid) join lists l on l.cid = p.id where p.probe_rank <= {nprobe} and l.id not in ({gone})"
    truth = f"select qid, id, {S.l2('q', 'vec')} dist from b, q where id not in ({gone})"
    return f"""select {inserts}::int inserts, {ratio}::double deletes, {nprobe}::int nprobe, {S.K}::int k, count(r.id) hits, count(*) total, count(r.id) / count(*) recall
      from ({S.ranked(f'{truth} union all {new}', S.K)}) g left join ({S.ranked(f'{main} union all {new}', S.K)}) r using (qid, id)"""


@query(f"{_ALL}, hashes as materialized (select * from {S.splitmixed('(select vec_id id from embeddings)')}) " + " union all ".join(_cell(*c, n) for c in _CELLS for n in _PROBES))
def update_grid(spark, d):
    """Recall in cells of inserted rows, deleted ratio and number of probes."""
    i, (b, q) = built(spark, d), both(spark, d)
    n = b.count()
    return updates.update_grid(i, b, q, _delta(spark, d, i), _CELLS, _PROBES, S.K, n)


@query(f"with {S.BASE} select count(*) misses from q where qid % 40 = 0")
def query_copy_misses_some(spark, d):
    """Copies of every other query are withheld from the inserts; a search must miss just those."""
    q = queries_of(spark, d)
    n = base_of(spark, d).count()
    held = q.filter("qid % 40 <> 0").select((F.col("qid") + n).alias("id"), F.col("q").alias("vec"))
    return evaluation.copy_misses(brute.brute_force_knn(held, q, S.K), q.select("qid", (F.col("qid") + n).alias("id")))


@query(f"with {S.index()}, {S.probes(2)}, r as ({S.searched()}) {S.result('r')}")
def ivf_search_two_lists(spark, d):
    """Two of sixteen lists: what pruning finds, whatever its recall."""
    i, q = built(spark, d), queries_of(spark, d)
    return rounded(topk(ivf.scan(i.lists, i.route(q, 2), q, S.K).drop("rank"), S.K).select("qid", "rank", "id", "dist"))
