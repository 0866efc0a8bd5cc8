"""N-gram Jaccard join: a size-aware heavy-light join of word-shingle sets, and its linked components.

Two documents link when their sets of `shingle` consecutive words (A-Z lower-cased) have a Jaccard similarity of
percent / 100 at least. No candidate is left out. Shingles are compared as numbers of 56 bits, so that sets of n and m
shingles have one in common that they have not with a chance of n * m / 2**56 (1e-11 for a thousand each); nothing else
is inexact. Links are looked for as follows.

1. Shared shingles. Each shingle's inverted list is scanned for a single bit: has any other set the shingle? A set
   links only if enough of its shingles are shared. What no other set has can be in no intersection, so from here on a
   set is its shared shingles and its full size. Shingles that meet within one slice of texts are known to be shared
   there; each slice sends one entry for them, so a shingle of half of all documents makes no long list. The rows that
   have them pass through the buckets of shingles in pieces, from a bucket on that the slice's first row gives.
2. Equal sets become one class with one representative.
3. Keys. Light sets (size up to the boundary) enumerate their subsets of fixed sizes: of sizes that any partner's
   intersection must reach, so linked light sets have a subset in common. Heavy sets, and light ones that can link to
   a heavy one, enter the inverted lists of a prefix of their shared shingles, long enough that linked sets meet in
   three lists, or in as many as they must share if that is less. The boundary is the largest size for which enumerating costs no more than scanning lists of the mean length met here.
4. Links within lists. All sets of a key are tested against the most central one (the largest shared part), then
   components are formed. Only sets of one key that are still in different components are tested against each other,
   under bounds from sizes, shared parts, places in the lists and what each shares with the row that has most links. A
   list of copies thus costs its length, not its square. A long list that stays apart is cut in blocks, and each pair of
   blocks is a task's work by itself.

Ids become bigints; others are refused by Spark. Nulls and texts without words have the empty set, link with nothing and are components of their own. With fewer words
than `shingle`, the whole sequence is the one shingle. A null id never names a component; a component of null ids has a
null name. Rows that repeat an id are documents of their own. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import Words, blank_table, cut, grams, mix, raw, runs, text_bytes
from vexel.llm.suffix_dedup import _KNOWN, _ROUTED, _WORK, _split, _table, dealt, pack, unpack, unpacked

SHINGLE = 4
PERCENT = 85
#: Bytes of text for each bucket of documents, and of shingles; and whose shingles a task gathers before it sends them.
DOC_BUCKET, KEY_BUCKET, SEND = 8 << 20, 8 << 20, 8 << 20
#: Entries known to be shared that go to a bucket of shingles at once.
KNOWN_PIECE = 1 << 14
#: Sizes for which the cost of subsets is reckoned; beyond, it exceeds any list's.
LIGHTEST, LIGHT_LIMIT = 1, 24
#: Lists in which heavy sets must meet to be compared. Sets that link and have so many shingles in common do, as the
#: prefixes are longer by as much; those that link by fewer shingles meet in each of them, and a meeting then counts more.
MEETINGS = 3
#: Members of a list in one block, when its members are tested against each other.
LIST_BLOCK = 256
#: Members of a list's largest component from which its pivot is asked before its members are.
PIVOTED = 3
#: Pairs that a task gathers before it adds up those that have met before.
GATHERED = 200_000
#: Pairs that a task holds before it sends them.
HELD = 2_000_000

_TABLE = blank_table(lower=True)
_ENTRY = [("key", "<u8"), ("row", "<i8")]
_META = [("row", "<i8"), ("doc", "<i8"), ("none", "u1"), ("n", "<i4"), ("sig", "V16")]
_PAIR = [("a", "<i8"), ("b", "<i8"), ("w", "<i8")]
#: Rows that describe documents, besides those of _ROUTED.
_ABOUT = 2


def least_overlap(n: int, m: int, percent: int) -> int:
    """Shingles that sets of n and m must share to link."""
    return -(-percent * (n + m) // (100 + percent))


def weight(need):
    """What one meeting counts for sets that must share `need` shingles: min(need, MEETINGS) of them come to MEETINGS."""
    few = np.minimum(need, MEETINGS)
    return -(-MEETINGS // few)


def least_shared(n, percent: int):
    """Shingles that any partner of a set of n shares with it, at least."""
    return -(-percent * n // 100)


_TOKEN = [("step", "<u8")]


def packed_set(t: np.ndarray) -> bytes:
    """Sorted numbers as steps from one to the next, whose high bytes take no room."""
    return pack(_TOKEN, {"step": np.diff(t, prepend=np.uint64(0))})


def unpacked_set(x: bytes) -> np.ndarray:
    return np.cumsum(unpack(_TOKEN, x)[0]["step"], dtype=np.uint64)


def sets_of(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(texts, _TABLE)
    h = w.hashes()
    g, out = grams(h, shingle), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        out.append(np.unique(g[a : b - shingle + 1]) if b - a >= shingle else grams(h[a:b], b - a) if b > a else g[:0])
    return out


def pieces(entries: dict[str, np.ndarray], slice_: int, n: int):
    """(bucket, blob) of a slice's entries, KNOWN_PIECE at once, to one of n buckets after the other: whatever shingles the
    slices have in common, no bucket gets more of their entries than others."""
    first = int(mix(np.array([slice_], np.int64).view(np.uint64))[0] % np.uint64(n))
    for i, a in enumerate(range(0, len(entries["key"]), KNOWN_PIECE)):
        yield (first + i) % n, pack(_ENTRY, {f: v[a : a + KNOWN_PIECE] for f, v in entries.items()})


def shared_sets(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """docs: row (unique), doc, text. Returns row, doc, n, sig for every document and, where the set may have a link
    and no smaller row of its slice has the same set, its shared shingles, packed sorted numbers of 56 bits."""
    total = text_bytes(docs, "text")
    n_docs, n_keys = max(8, -(-total // DOC_BUCKET)), max(8, -(-total // KEY_BUCKET))

    def find(batches):
        sets: dict[bytes, tuple[int, np.ndarray]] = {}
        about, seen = [], 0

        def send():
            nonlocal sets, about, seen
            rows = []
            if about:
                meta = {f: np.array([x[i] for x in about], "V16" if t == "V16" else t) for i, (f, t) in enumerate(_META)}
                rows += [(_ABOUT, b, x) for b, x in dealt(_META, meta, meta["row"] % n_docs)]
            if sets:
                parts = list(sets.values())
                row = np.repeat(np.array([p[0] for p in parts], np.int64), [len(p[1]) for p in parts])
                key = np.concatenate([p[1] for p in parts])
                sets, parts = {}, []
                key >>= np.uint64(8)
                o = np.argsort(key, kind="stable")
                key, row = key[o], row[o]
                del o
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
                size = np.diff(np.append(first, len(key)))
                once = {"key": key[first], "row": np.where(size > 1, -1, row[first])}
                rows += [(_WORK, b, x) for b, x in dealt(_ENTRY, once, (once["key"] % np.uint64(n_keys)).astype(np.int64))]
                known = np.repeat(size > 1, size)
                met = {"key": key[known], "row": row[known]}
                rows += [(_KNOWN, b, x) for b, x in pieces(met, about[0][0], n_keys)]
            sets, about, seen = {}, [], 0
            return _table(rows).to_batches()

        for big in batches:
            for b in runs(big, 2):
                texts = raw(b.column(2))
                for row, doc, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), sets_of(texts, shingle), strict=True):
                    sig = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    about.append((row, doc or 0, doc is None, len(s), sig))
                    if len(s) and (sig not in sets or row < sets[sig][0]):
                        sets[sig] = (row, s)
                seen += sum(map(len, texts))
                if seen >= SEND:
                    yield from send()
        yield from send()

    def scan(t: pa.Table) -> pa.Table:
        about = t.filter(pa.compute.equal(t.column("kind"), _ABOUT))
        blobs, known = _split(t)
        e, _ = unpacked(_ENTRY, blobs)
        o = np.argsort(e["key"], kind="stable")
        key, row = e.pop("key")[o], e.pop("row")[o]
        del blobs, o
        same = np.concatenate([[False], key[1:] == key[:-1]]) if len(key) else np.empty(0, bool)
        met = (same | np.append(same[1:], False)) & (row >= 0) if len(key) else same
        k, _ = unpacked(_ENTRY, known)
        e = {"key": np.concatenate([key[met], k["key"]]), "row": np.concatenate([row[met], k["row"]])}
        out = _table([(_WORK, b, x) for b, x in dealt(_ENTRY, e, e["row"] % n_docs)])
        if not about.num_rows:
            return out
        m, _ = unpacked(_META, about.column("blob").to_pylist())
        return pa.concat_tables([out, _table([(_ABOUT, b, x) for b, x in dealt(_META, m, m["row"] % n_docs)])])

    def gather(t: pa.Table) -> pa.Table:
        m, _ = unpacked(_META, t.filter(pa.compute.equal(t.column("kind"), _ABOUT)).column("blob").to_pylist())
        e, _ = unpacked(_ENTRY, _split(t)[0])
        o = np.lexsort((e["key"], e["row"]))
        key, row = e["key"][o], e["row"][o]
        first = np.searchsorted(row, m["row"])
        size = np.searchsorted(row, m["row"], "right") - first
        enough = (size >= least_shared(m["n"].astype(np.int64), percent)) & (m["n"] > 0)
        shared = [packed_set(key[a : a + z]) if ok else None for a, z, ok in zip(first.tolist(), size.tolist(), enough.tolist(), strict=True)]
        doc = pa.array(m["doc"], mask=m["none"].astype(bool))
        return pa.table({"row": m["row"], "doc": doc, "n": m["n"].astype(np.int64), "sig": pa.array([x.tobytes() for x in m["sig"]], pa.binary()), "shared": pa.array(shared, pa.binary())})

    found = docs.select("row", "doc", "text").mapInArrow(find, _ROUTED)
    back = found.groupBy("bucket").applyInArrow(scan, _ROUTED)
    return back.groupBy("bucket").applyInArrow(gather, "row bigint, doc bigint, n bigint, sig binary, shared binary")


def subset_sizes(m: int, percent: int) -> list[int]:
    """Sizes of the subsets that a light set of m enumerates: for each n <= m that can link to m, what two sets of n
    must share. Partners of n and m share as many at least, and the partner of n enumerates that size, too."""
    return sorted({least_overlap(n, n, percent) for n in range(least_shared(m, percent), m + 1)})


def prefix(n: int, s: int, percent: int) -> int:
    """Shared shingles, of s, among which a partner has MEETINGS."""
    return s - least_shared(n, percent) + MEETINGS


def boundary(mean_list: float, percent: int) -> int:
    """The largest size up to which enumerating subsets costs no more than scanning the lists of a prefix."""
    light = 0
    for n in range(LIGHTEST, LIGHT_LIMIT + 1):
        if sum(comb(n, c) for c in subset_sizes(n, percent)) > prefix(n, n, percent) * max(1.0, mean_list):
            break
        light = n
    return light


def _keyed(sets: DataFrame, make) -> DataFrame:
    """key, row, n, s, pos of each set; make(n, shared) gives its keys and their places."""

    def work(batches):
        for b in batches:
            out = {"key": [], "row": [], "n": [], "s": [], "pos": []}
            for row, n, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                t = unpacked_set(x)
                k, pos = make(n, t)
                out["key"].append(k.view(np.int64))
                out["pos"].append(pos)
                for f, v in (("row", row), ("n", n), ("s", len(t))):
                    out[f].append(np.full(len(k), v, np.int64))
            cols = {f: np.concatenate(v) if v else np.empty(0, np.int64) for f, v in out.items()}
            yield pa.RecordBatch.from_arrays([pa.array(cols[f], pa.int64()) for f in out], names=list(out))

    return sets.select("row", "n", "shared").mapInArrow(work, "key bigint, row bigint, n bigint, s bigint, pos bigint")


def prefix_keys(sets: DataFrame, percent: int) -> DataFrame:
    """The inverted lists that a set enters: those of the first of its shared shingles."""

    def make(n, t):
        p = min(len(t), prefix(n, len(t), percent))
        return mix(t[:p]), np.arange(p)

    return _keyed(sets, make)


def subset_keys(sets: DataFrame, percent: int) -> DataFrame:
    """The subsets of a light set, of all sizes that it enumerates."""

    def make(n, t):
        made = [hashlib.blake2b(t[list(i)].tobytes(), digest_size=8).digest() for c in subset_sizes(n, percent) for i in combinations(range(len(t)), c)]
        return np.frombuffer(b"".join(made), "<u8").astype(np.uint64), np.zeros(len(made), np.int64)

    return _keyed(sets, make)


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with set sizes, the size of their intersection and whether they link: a, b, na, nb, both, links."""

    def work(batches):
        for b in batches:
            ok, size = [], []
            for n, m, x, y in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                both = np.concatenate([unpacked_set(x), unpacked_set(y)])
                both.sort()
                i = int((both[1:] == both[:-1]).sum())
                size.append(i)
                ok.append(100 * i >= percent * (n + m - i))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(size, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "na", "nb", "both", "links"])

    left = sets.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("shared").alias("xa"))
    right = sets.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("xb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(work, "a bigint, b bigint, na bigint, nb bigint, both bigint, links boolean")


def components(links: DataFrame) -> DataFrame:
    """row, comp (the smallest row reachable) of every row that has a link: smallest labels pass along links and are
    then looked up at their own rows, so a chain's length costs rounds by its logarithm."""
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("row")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(labels, F.col("b") == F.col("row")).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, F.col("row") == F.col("a")).select("row", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        over = labels.select(F.col("row").alias("_r"), F.col("comp").alias("over"))
        step = step.join(over, F.col("comp") == F.col("_r")).select("row", "was", F.least("comp", "over").alias("comp"))
        step = cut(step)
        labels = step.select("row", "comp")
        if step.filter("was <> comp").isEmpty():
            return labels


def _bound(na: Column, nb: Column, percent: int) -> Column:
    return F.ceil((na + nb) * percent / (100 + percent))


def _weight(na: Column, nb: Column, percent: int) -> Column:
    few = F.least(_bound(na, nb, percent), F.lit(MEETINGS))
    return F.ceil(F.lit(MEETINGS) / few)


def linked(sets: DataFrame, percent: int) -> DataFrame:
    """row, comp for each row that has a link. sets: row, n, shared of one representative of each class, dealt by row."""
    spread = max(8, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heavy = prefix_keys(sets, percent)
    stats = heavy.groupBy("key").count().agg(F.sum(F.col("count") * F.col("count")).alias("squares"), F.sum("count").alias("all")).first()
    light = boundary((stats["squares"] or 0) / max(1, stats["all"] or 0), percent)
    entries = heavy.filter(F.col("n") >= least_shared(light + 1, percent))  # its partners may be heavy, or it is
    entries = entries.withColumn("w", F.lit(1)).unionByName(subset_keys(sets.filter(F.col("n") <= light), percent).withColumn("w", F.lit(MEETINGS)))
    central = F.struct((F.col("s") / F.col("n")).alias("part"), (-F.col("row")).alias("minus"), "n", "s")
    lists = cut(entries.groupBy("key").agg(F.count("*").alias("size"), F.max(central).alias("lead")).filter("size > 1").select("key", (-F.col("lead.minus")).alias("lead"), F.col("lead.n").alias("ln"), F.col("lead.s").alias("ls")))
    entries = cut(entries.join(lists, "key"))
    star = entries.filter((F.col("row") != F.col("lead")) & (_bound(F.col("n"), F.col("ln"), percent) <= F.least("s", "ls")))
    star = star.groupBy(F.col("row").alias("a"), F.col("lead").alias("b")).agg(F.sum(F.col("w") * _weight(F.col("n"), F.col("ln"), percent)).alias("w"))
    star = cut(compared(star.filter(F.col("w") >= MEETINGS).select("a", "b"), sets, percent))
    links = star.filter("links").select("a", "b")
    comps = components(links)
    # What is still apart within a list. Its largest component is represented by the row with most links, the pivot.
    turned = star.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb"), "both", "links")
    known = star.unionByName(turned).dropDuplicates(["a", "b"])
    hubs = known.filter("links").groupBy("a").agg(F.count("*").alias("count"), F.first("na").alias("pn"))
    hubs = hubs.join(comps, F.col("a") == F.col("row")).groupBy("comp").agg(F.max(F.struct("count", (-F.col("row")).alias("minus"), "pn")).alias("h"))
    hubs = hubs.select(F.col("comp").alias("main"), (-F.col("h.minus")).alias("pivot"), F.col("h.pn").alias("pn"))
    own = entries.select("key", "row", "n", "s", "pos", "w").join(comps, "row", "left").withColumn("comp", F.coalesce("comp", "row"))
    per = own.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key")
    several = per.agg(F.count("*").alias("comps"), F.sum("c").alias("all"), F.max(F.struct("c", "comp")).alias("m")).filter("comps > 1")
    several = several.select("key", F.col("m.comp").alias("main"), F.col("m.c").alias("members"), F.ceil(F.col("all") / LIST_BLOCK).cast("int").alias("blocks"))
    apart = cut(own.join(several, "key").join(hubs, "main", "left"))
    asked = apart.filter((F.col("members") >= PIVOTED) & (F.col("row") != F.col("pivot"))).groupBy(F.col("row").alias("a"), F.col("pivot").alias("b"))
    asked = asked.agg(F.sum(F.col("w") * _weight(F.col("n"), F.col("pn"), percent)).alias("w"))
    new = cut(compared(asked.filter(F.col("w") >= MEETINGS).select("a", "b").join(known, ["a", "b"], "left_anti"), sets, percent))
    met = known.unionByName(new).select(F.col("a").alias("row"), F.col("b").alias("pivot"), "both")
    apart = apart.join(met, ["row", "pivot"], "left")
    # Of a list cut in blocks every pair of blocks is a piece: x the own block, (lo, hi) the piece.
    apart = apart.withColumn("x", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    apart = apart.select("key", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "x", "row", "n", "s", "pos", "w", "comp", "main", F.coalesce("both", F.lit(-1)).alias("both"))
    apart = apart.withColumn("bucket", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(4 * spread)).cast("int"))
    numbers = ("key", "lo", "hi", "x", "row", "n", "s", "pos", "w", "comp", "main", "both")

    def cross(t: pa.Table) -> pa.Table:
        c = {f: t.column(f).to_numpy() for f in numbers}
        o = np.lexsort((c["hi"], c["lo"], c["key"]))
        c = {f: v[o] for f, v in c.items()}
        new_piece = (np.diff(c["key"]) != 0) | (np.diff(c["lo"]) != 0) | (np.diff(c["hi"]) != 0)
        edges = np.flatnonzero(np.concatenate([[True], new_piece, [True]])) if len(o) else [0]
        met, new, held, out = np.empty((3, 0), np.int64), [], 0, []

        def send():
            p = dict(zip(("a", "b", "w"), met, strict=True))
            out.extend((_WORK, b, z) for b, z in dealt(_PAIR, p, (p["a"] * 31 + p["b"]) % (4 * spread)))

        for i0, i1 in zip(edges, edges[1:], strict=False):
            lo, hi, x, row, n, s, pos, comp, main, both = (c[f][i0:i1] for f in ("lo", "hi", "x", "row", "n", "s", "pos", "comp", "main", "both"))
            within = lo[0] == hi[0]
            for i in np.flatnonzero(comp != main).tolist():  # every other set against all of other components
                need = -(-percent * (n[i] + n) // (100 + percent))
                ok = (comp != comp[i]) & (need <= np.minimum(s[i] - pos[i], s - pos) + MEETINGS - 1) & (need <= np.minimum(s[i], s)) & ((comp == main) | (row > row[i]))
                if not within:
                    ok &= x != x[i]
                if both[i] >= 0:  # what both share with the pivot, and what both have beside it
                    ok &= (both < 0) | (need <= np.minimum(both[i], both) + np.minimum(s[i] - both[i], s - both))
                if ok.any():
                    new.append(np.stack([np.minimum(row[ok], row[i]), np.maximum(row[ok], row[i]), c["w"][i0] * weight(need[ok])]))
                    held += int(ok.sum())
                    if held > max(GATHERED, met.shape[1] // 2):
                        met, new, held = summed(np.concatenate([met, *new], axis=1)), [], 0
                        if met.shape[1] > HELD:
                            send()
                            met = met[:, :0]
        met = summed(np.concatenate([met, *new], axis=1))
        send()
        return _table(out)

    def summed(p: np.ndarray) -> np.ndarray:
        """Each pair once, with the sum of its meetings."""
        p = p[:, np.lexsort((p[1], p[0]))]
        first = np.flatnonzero(np.concatenate([[True], (p[0, 1:] != p[0, :-1]) | (p[1, 1:] != p[1, :-1])])) if p.shape[1] else np.empty(0, np.int64)
        return np.stack([p[0, first], p[1, first], np.add.reduceat(p[2], first) if len(first) else first])

    def distinct(t: pa.Table) -> pa.Table:
        p, _ = unpacked(_PAIR, t.column("blob").to_pylist())
        p = summed(np.stack([p["a"], p["b"], p["w"]]))
        p = p[:, p[2] >= MEETINGS]
        return pa.table({"a": p[0], "b": p[1]})

    rest = apart.groupBy("bucket").applyInArrow(cross, _ROUTED).groupBy("bucket").applyInArrow(distinct, "a bigint, b bigint")
    rest = rest.join(known.select("a", "b"), ["a", "b"], "left_anti")
    more = new.filter("links").select("a", "b").unionByName(cut(compared(rest, sets, percent).filter("links").select("a", "b")))
    return comps if more.isEmpty() else components(links.unionByName(more))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, extra: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document. extra: a long column, unique by row, that names the rows
    and is returned, too, with `first`: whether the row stands for its component (smallest id, then smallest row)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), *([F.col(extra).alias("row")] if extra else []))
    if not extra:
        own = own.withColumn("row", F.monotonically_increasing_id())
    all_ = cut(shared_sets(own.select("row", "doc", "text"), shingle, percent))
    spread = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    stands = all_.filter("shared is not null").groupBy("sig").agg(F.min("row").alias("row"))
    sets = all_.filter("shared is not null").select("row", "n", "shared").repartition(spread, "row")  # joins by row find it dealt
    comps = linked(cut(sets.join(stands.select("row"), "row", "left_semi")), percent)
    classes = all_.filter("n > 0").groupBy("sig").agg(F.min(F.struct(F.col("doc").isNull().alias("no"), "doc", "row")).alias("first"))
    classes = classes.join(stands, "sig", "left").join(comps, "row", "left").select("sig", "first", "comp")
    tops = classes.filter("comp is not null").groupBy("comp").agg(F.min("first").alias("top"))
    classes = classes.join(tops, "comp", "left").select("sig", F.coalesce("top", "first").alias("top"))
    out = all_.select("row", "doc", "n", "sig").join(classes, "sig", "left")
    top = F.when(F.col("n") > 0, F.col("top.doc")).otherwise(F.col("doc"))
    more = [F.col("row").alias(extra), F.when(F.col("n") > 0, F.col("top.row") == F.col("row")).otherwise(True).alias("first")] if extra else []
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), top.alias("component_id"), *more)
