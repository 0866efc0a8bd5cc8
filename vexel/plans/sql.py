"""DuckDB SQL of the vector queries, built from one set of common table expressions."""

from __future__ import annotations

from math import ceil, sqrt

#: Parameters of the registered queries; plans.queries uses the same.
NLIST, ITERS, NPROBE, K, RERANK = 16, 3, 12, 10, 256
M, WORDS, BCS, EVERY = 8, 16, 64, 20


def l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double)))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::double * x[2]::double))"


def cosine(a: str, b: str) -> str:
    n = f"({dot(a, a)} * {dot(b, b)})"
    return f"case when {n} < 1e-24 then 1.0 else 1.0 - greatest(-1.0, least(1.0, {dot(a, b)} / sqrt({n}))) end"


def distance(metric: str, a: str, b: str) -> str:
    return l2(a, b) if metric == "l2" else cosine(a, b)


BASE = f"b as (select vec_id id, embedding vec, label from embeddings), q as (select vec_id qid, embedding q from embeddings where vec_id % {EVERY} = 0)"
START = "(id * 7919) % 10007"


def ranked(pairs: str, k: int, by: str = "qid", rank: str = "rank", order: str = "dist, id") -> str:
    return f"select * from (select *, row_number() over (partition by {by} order by {order})::int {rank} from ({pairs})) where {rank} <= {k}"


def knn(metric: str = "l2", k: int = K, where: str = "true", base: str = "b") -> str:
    return ranked(f"select qid, id, {distance(metric, 'q', 'vec')} dist from {base}, q where {where}", k)


def result(cte: str, columns: str = "qid, rank, id") -> str:
    return f"select {columns}, round(dist, 6) dist from {cte}"


def nearest(name: str, centroids: str, rows: str = "b") -> str:
    return f"{name} as materialized (select id, vec, cid, d cdist from (select id, vec, cid, d, row_number() over (partition by id order by d, cid) n from (select id, vec, cid, {l2('vec', 'c')} d from {rows}, {centroids})) where n = 1)"


def means(name: str, old: str, assigned: str) -> str:
    return f"""{name} as materialized (select o.cid, coalesce(n.c, o.c) c from {old} o left join (select cid, list(x order by p) c from
        (select cid, p, round(avg(x), 9) x from (select cid, unnest(vec)::double x, generate_subscripts(vec, 1) p from {assigned}) group by cid, p) group by cid) n on n.cid = o.cid)"""


def trained(iters: int = ITERS, rows: str = "b", k: int = NLIST) -> str:
    """b, q, and c0 to c<iters>."""
    parts = [BASE] if rows == "b" else [BASE, f"t as (select * from b where {rows})"]
    source = "b" if rows == "b" else "t"
    parts.append(f"c0 as materialized (select (row_number() over (order by {START}, id) - 1)::int cid, list_transform(vec, lambda x: x::double) c from (select * from {source} order by {START}, id limit {k}))")
    for i in range(iters):
        parts += [nearest(f"a{i}", f"c{i}", source), means(f"c{i + 1}", f"c{i}", f"a{i}")]
    return ", ".join(parts)


def index(iters: int = ITERS) -> str:
    """As trained(), with lists(id, vec, cid, cdist)."""
    return f"{trained(iters)}, {nearest('lists', f'c{iters}')}"


def probes(nprobe: int = NPROBE, metric: str = "l2") -> str:
    return f"probes as materialized ({ranked(f'select qid, cid id, {distance(metric, 'q', 'c')} dist from q, c{ITERS}', nprobe, rank='probe_rank')})"


def searched(metric: str = "l2", k: int = K, where: str = "true") -> str:
    return ranked(f"select qid, l.id, {distance(metric, 'q', 'vec')} dist from probes p join q using (qid) join lists l on l.cid = p.id where {where}", k)


def blocks() -> str:
    return f"""i as materialized (select r.range::int cid, count(l.id) n from range({NLIST}) r left join lists l on l.cid = r.range group by r.range),
    o as materialized (select *, cast(sum(n) over (order by cid) - n as bigint) o, cast(coalesce(sum(ceil(n / {BCS})) over (order by cid rows between unbounded preceding and 1 preceding), 0) as bigint) f from i),
    blocks as materialized (select cid, f + j block_id, j::int block_no, least({BCS}, n - j * {BCS})::bigint size, (o + j * {BCS})::bigint "offset" from (select *, unnest(range(ceil(n / {BCS})::bigint)) j from o))"""


def codes() -> str:
    """words(m, code, cw) from sampled residuals; r(id, cid, res); codes(id, cid, m, code)."""
    w = f"list_transform(range(1, {M} + 1), lambda m: res[(m - 1) * (len(res) // {M}) + 1 : m * (len(res) // {M})])"
    return f"""resid as materialized (select id, l.cid, list_transform(list_zip(vec, c), lambda x: x[1]::double - x[2]::double) res from lists l join c{ITERS} using (cid)),
    cut as materialized (select id, cid, unnest({w}) x, unnest(range({M}))::int m from resid),
    words as materialized (select m, code, x cw from cut join (select id, (row_number() over (order by {START}, id) - 1)::int code from (select id from resid order by {START}, id limit {WORDS})) using (id)),
    codes as materialized (select id, cid, m, code from (select id, cid, cut.m, code, row_number() over (partition by id, cut.m order by {l2('x', 'cw')}, code) n from cut join words on words.m = cut.m) where n = 1)"""


def adc(n: int = RERANK) -> str:
    s = f"list_transform(list_zip(q, c), lambda x: x[1]::double - x[2]::double)"
    return f"""qr as materialized (select qid, p.id cid, {s} res from probes p join q using (qid) join c{ITERS} c on c.cid = p.id),
    lut as materialized (select qid, cid, m, code, {l2(f"res[m * (len(res) // {M}) + 1 : (m + 1) * (len(res) // {M})]", "cw")} d from qr, words),
    cand as materialized ({ranked('select qid, id, sum(d) dist from codes join lut using (cid, m, code) group by qid, id', n)})"""


MASK = "18446744073709551616"


def wrap(x: str) -> str:
    return f"(({x})::uhugeint % {MASK}::uhugeint)::ubigint"


def splitmix(id_: str) -> str:
    z0 = wrap(f"{id_}::ubigint::uhugeint + 11400714819323198485::uhugeint")
    z1 = wrap(f"xor({z0}, {z0} >> 30)::uhugeint * 13787848793156543929::uhugeint")
    z2 = wrap(f"xor(y, y >> 27)::uhugeint * 10723151780598845931::uhugeint")
    return z1, z2


def splitmixed(rows: str) -> str:
    """id, h of rows with an id."""
    z1, z2 = splitmix("id")
    return f"(select id, xor(z, z >> 31) h from (select id, {z2} z from (select id, {z1} y from {rows})))"


#: Overlay fixtures: every seventh id is deleted; rows with id % 10 = 3, moved a little, are inserted.
N_BASE = "(select count(*) from embeddings)"
DELTA = f"delta as (select {N_BASE} + (row_number() over (order by id) - 1) id, list_transform(vec, lambda x: (x::double + 0.01)::float) vec from b where id % 10 = 3)"


#: Bytes between the least and greatest element of the table: u(id, codes).
U8 = "lims as (select min(list_min(embedding))::double lo, max(list_max(embedding))::double hi from embeddings), u as (select vec_id id, list_transform(embedding, lambda x: floor(greatest(0.0, least(255.0, (x::double - lo) * (255.0 / (hi - lo)))))::smallint) codes from embeddings, lims)"
#: The place of a row in a file that holds the table by id.
PLACE = "(select *, row_number() over (order by vec_id) - 1 place from embeddings)"


def l2_int(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda v: (v[1]::bigint - v[2]::bigint) * (v[1]::bigint - v[2]::bigint)))::bigint"


def floating(x: str, least: int, digits: int) -> tuple[str, str]:
    """(code, value) of a number in a binary format: exponents from `least` on, that many digits after the first."""
    e = f"(case when {x} = 0 then {least} else greatest({least}, floor(log2(abs({x})))) end)"
    m = f"round_even(abs({x}) / pow(2, {e} - {digits}), 0)"
    sign = 1 << 15
    return f"(case when {x} < 0 then {sign} else 0 end + ({e} - {least}) * {1 << digits} + {m})::int", f"(case when {x} < 0 then -1 else 1 end * {m} * pow(2, {e} - {digits}))"


def codes_and_error(values: str, code: str, decoded: str) -> str:
    """values: list of doubles to encode; code, decoded: of one element x, the latter as float."""
    return f"upper(array_to_string(list_transform({values}, lambda x: format('{{:02x}}{{:02x}}', {code} % 256, {code} // 256)), '')) codes, round({l2('embedding', f'list_transform({values}, lambda x: {decoded})')}, 9) error"


def minibatch(steps: int) -> str:
    """m0 to m<steps>: minibatch steps that each see the whole table, as they do up to one window of rows."""
    parts = [trained(0), "m0 as materialized (select cid, c, 0 seen from c0)"]
    for i in range(steps):
        parts += [
            nearest(f"z{i}", f"m{i}"),
            f"""m{i + 1} as materialized (select o.cid, case when n is null then o.c else list_transform(list_zip(o.c, x), lambda v: round((1.0 - 1.0 / (seen + 1.0)) * v[1] + (1.0 / (seen + 1.0)) * v[2], 9)) end c, seen + coalesce(n, 0) seen from m{i} o
            left join (select cid, max(n) n, list(x order by p) x from (select cid, p, count(*) n, avg(x) x from (select cid, unnest(vec)::double x, generate_subscripts(vec, 1) p from z{i}) group by cid, p) group by cid) n using (cid))""",
        ]
    return ", ".join(parts)


def hierarchical(m: int = NLIST, iters: int = ITERS) -> str:
    """h(cid, c): ceil(sqrt(m)) clusters; those beyond their share are split in as many as their rows call for."""
    first = max(2, ceil(sqrt(m)))
    parts = [
        trained(iters, k=first), nearest("near", f"c{iters}"), "total as (select count(*) n from b)",
        f"sizes as (select cid owner, count(*) s from near group by cid), split as (select owner, ceil(s * {m} / n)::int parts from sizes, total where s > greatest(1, ceil(n / {m})) and ceil(s * {m} / n) > 1)",
        "h0 as materialized (select cid owner, sub, list_transform(vec, lambda x: x::double) c from (select near.*, parts, row_number() over (partition by cid order by ((id + cid) * 7919) % 10007, id) sub from near join split on owner = cid) where sub <= parts)",
    ]
    for i in range(iters):
        parts += [
            f"y{i} as materialized (select id, vec, owner, sub from (select id, vec, owner, sub, row_number() over (partition by id order by {l2('vec', 'c')}, sub) n from near join h{i} on owner = cid) where n = 1)",
            f"""h{i + 1} as materialized (select o.owner, o.sub, coalesce(n.c, o.c) c from h{i} o left join (select owner, sub, list(x order by p) c from
            (select owner, sub, p, round(avg(x), 9) x from (select owner, sub, unnest(vec)::double x, generate_subscripts(vec, 1) p from y{i}) group by owner, sub, p) group by owner, sub) n using (owner, sub))""",
        ]
    parts.append(f"h as (select (row_number() over (order by owner, sub) - 1)::int cid, c from (select * from h{iters} union all select cid, 0, c from c{iters} where cid in (select owner from sizes) and cid not in (select owner from split)))")
    return ", ".join(parts)


def pq_trained(m: int, k: int, iters: int) -> str:
    """As codes(): resid, cut, and words0 to words<iters>(m, code, cw), trained from the first residuals; widths may differ."""
    at = f"(m * (len(res) // {m}) + least(m, len(res) % {m}))"
    parts = [
        f"resid as materialized (select id, l.cid, list_transform(list_zip(vec, c), lambda x: x[1]::double - x[2]::double) res from lists l join c{ITERS} using (cid))",
        f"cut as materialized (select id, cid, m, res[{at} + 1 : {at} + len(res) // {m} + case when m < len(res) % {m} then 1 else 0 end] x from resid, (select unnest(range({m}))::int m))",
        f"words0 as materialized (select m, code, x cw from cut join (select id, (row_number() over (order by {START}, id) - 1)::int code from (select id from resid order by {START}, id limit {k})) using (id))",
    ]
    for i in range(iters):
        parts += [
            f"near{i} as materialized (select id, m, code, x from (select id, cut.m, code, x, row_number() over (partition by id, cut.m order by {l2('x', 'cw')}, code) n from cut join words{i} w on w.m = cut.m) where n = 1)",
            f"""words{i + 1} as materialized (select o.m, o.code, coalesce(n.cw, o.cw) cw from words{i} o left join (select m, code, list(x order by p) cw from
            (select m, code, p, round(avg(x), 9) x from (select m, code, unnest(x) x, generate_subscripts(x, 1) p from near{i}) group by m, code, p) group by m, code) n using (m, code))""",
        ]
    return ", ".join(parts)
