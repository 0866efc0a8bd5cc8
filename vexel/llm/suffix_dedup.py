"""Substring deduplication over sorted suffixes: deep-shallow sorting.

A byte goes if a string of LENGTH bytes covers it that also starts in a document with a smaller id. Strings are judged
on the input and never cross documents.

Every string of LENGTH bytes holds exactly one anchor: of its 16-byte words, the first with the least hash. Equal
strings have equal anchors at equal places, so equal suffixes always meet under one anchor, and anchors that only one
document has need no sorting. Five steps, each linear in the input, bytes moved as packed arrays:

1. find the anchors of every text and send them to buckets by hash. Where a stretch around an anchor repeats within a
   slice of texts, only that of the smallest id is sent; the others are covered by it already.
2. by bucket: keep the anchors that several documents have.
3. by text: cut out the stretch of bytes around each of those.
4. by bucket: sort the suffixes that start in these stretches, LENGTH bytes deep. Multikey quicksort with symbols of
   eight bytes sorts to the shallow depth of 16. Groups that still agree go into blind tries, which look at no more than
   the byte where a group first branches. Groups that end in one leaf are equal; all but the smallest id is covered.
5. by text: unite the covered spans and remove them.

Documents never collect in one task beyond a bucket of bounded bytes; a passage that half of all documents share
reaches its bucket once per slice.

Ids become bigints; others are refused by Spark. Nulls count as empty texts. A null id counts as the greatest bigint. Rows
that repeat an id are one document: they do not cover each other, and each is reported. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import mix, raw, runs, text_bytes

LENGTH = 50
WORD = 16
SHALLOW = 16
#: Bytes of text for each bucket of texts, and of anchors.
TEXT_BUCKET, ANCHOR_BUCKET = 12 << 20, 16 << 20
#: Bytes of text whose anchors a task gathers before it sends them.
SEND = 32 << 20
#: Suffixes that one pass of the sort holds.
SORTED = 1 << 20

_U = np.uint64
_ANCHOR = [("key", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("pos", "<i4"), ("lead", "u1"), ("n", "u1")]
_SPAN = [("doc", "<i8"), ("tag", "<i8"), ("start", "<i4"), ("stop", "<i4")]


def pack(fields: list[tuple], arrays: dict[str, np.ndarray], text: bytes = b"") -> bytes:
    """Arrays as planes of bytes, so that those that seldom change cost nothing, then text; compressed."""
    n = len(arrays[fields[0][0]])
    planes = [np.ascontiguousarray(arrays[f], t).view(np.uint8).reshape(n, -1).T.tobytes() if n else b"" for f, t in fields]
    return zstandard.ZstdCompressor(1).compress(b"".join([n.to_bytes(8, "little"), *planes, text]))


def unpack(fields: list[tuple], blob: bytes) -> tuple[dict[str, np.ndarray], bytes]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(body[:8], "little"), 8, {}
    for f, t in fields:
        w = np.dtype(t).itemsize
        out[f] = np.frombuffer(body, np.uint8, n * w, at).reshape(w, n).T.copy().view(t).reshape(n)
        at += n * w
    return out, body[at:]


def unpacked(fields: list[tuple], blobs: list[bytes]) -> tuple[dict[str, np.ndarray], bytes]:
    parts = [unpack(fields, b) for b in blobs]
    return {f: np.concatenate([p[0][f] for p in parts]) if parts else np.empty(0, t) for f, t in fields}, b"".join(p[1] for p in parts)


def dealt(fields: list[tuple], arrays: dict[str, np.ndarray], to: np.ndarray, text=None):
    """(bucket, blob) for each bucket in `to`; text(chosen rows) gives what goes with them."""
    order = np.argsort(to, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) != 0, [True]])) if len(to) else [0]
    for a, b in zip(edges, edges[1:], strict=False):
        rows = order[a:b]
        yield int(to[rows[0]]), pack(fields, {f: arrays[f][rows] for f, _ in fields}, text(rows) if text else b"")


def spans_of(doc, tag, start, stop) -> dict[str, np.ndarray]:
    """Spans with those of one text that touch made one."""
    o = np.lexsort((start, tag, doc))
    doc, tag, start, stop = doc[o], tag[o], start[o].astype(np.int64), stop[o].astype(np.int64)
    if not len(o):
        return {"doc": doc, "tag": tag, "start": start, "stop": stop}
    new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(tag) != 0)])
    shift = (np.cumsum(new) - 1) << 32  # no text is as long: one running maximum serves all
    reach = np.maximum.accumulate(stop + shift)
    first = np.flatnonzero(np.concatenate([[True], (start + shift)[1:] > reach[:-1]]) | new)
    last = np.append(first[1:], len(o)) - 1
    return {"doc": doc[first], "tag": tag[first], "start": start[first], "stop": reach[last] - shift[last]}


def words_at(buffer: bytes) -> np.ndarray:
    """The eight bytes from each position on; buffer ends in eight spare bytes."""
    return np.ndarray((len(buffer) - 7,), "<u8", buffer, 0, (1,))


class Stretches:
    """All anchors of some texts: key (hash), pos (of the anchor in its text), lead (bytes before it), n (strings)."""

    def __init__(self, texts: list[bytes]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.base = np.concatenate([[0], np.cumsum(size)])
        total, reach = int(self.base[-1]), LENGTH - WORD + 1
        self.buffer = b"".join(texts) + bytes(2 * LENGTH)
        eight = words_at(self.buffer)
        h = mix(mix(eight[: total + LENGTH] + _U(1)) ^ (eight[8 : total + LENGTH + 8] * _U(0x9E3779B97F4A7C15)))
        low = _U((1 << 24) - 1)
        if total + LENGTH >= 1 << 24:  # positions of one very long text need more bits
            low = _U((1 << 36) - 1)
        least, width = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * width <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if reach > width:
            least = np.minimum(least[: width - reach], least[reach - width :])
        at = (least[:total] & low).astype(np.int64)
        ok = np.zeros(total + 1, np.int8)  # strings that start here end within their text
        long = np.flatnonzero(size >= LENGTH)
        np.add.at(ok, self.base[long], 1)
        np.add.at(ok, self.base[long + 1] - LENGTH + 1, -1)
        ok = np.cumsum(ok[:-1], dtype=np.int8) > 0
        new = ok.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
        start = np.flatnonzero(new)
        n = np.diff(np.append(start, total)) if len(start) else start
        if len(start):  # a run also ends where strings leave their text
            n = np.minimum(n, np.diff(np.append(np.concatenate([[0], np.cumsum(ok)])[start], ok.sum())))
        self.row = np.searchsorted(self.base, start, "right") - 1
        self.start, self.n, self.anchor = start, n, at[start]
        self.key = h[self.anchor] >> _U(16)
        self.hash = np.zeros(len(start), np.uint64)
        for k in range(0, 2 * LENGTH, WORD):  # the whole stretch, in words that may overlap at its end
            self.hash = mix((self.hash ^ h[start + np.minimum(k, n + LENGTH - 1 - WORD)]) + _U(k + 1))
        self.hash ^= n.astype(np.uint64)


def repeats(buffer: bytes, start: np.ndarray, size: np.ndarray, group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which stretches equal one of a smaller document; group: a hash of each stretch, whose bytes are then compared."""
    order = np.lexsort((doc, group))
    g, d = group[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
    lead = np.repeat(first, np.diff(np.append(first, len(g))))
    rows = np.flatnonzero(d > d[lead])
    a, b = order[rows], order[lead[rows]]
    same, eight = size[a] == size[b], words_at(buffer)
    for k in range(0, 2 * LENGTH, 8):
        at = np.minimum(k, np.minimum(size[a], size[b]) - 8)
        same &= eight[start[a] + at] == eight[start[b] + at]
    out = np.zeros(len(group), bool)
    out[a[same]] = True
    return out


def _several(doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which groups (by their first rows) have more than one document."""
    return np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.empty(0, bool)


def _alive(rows: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, in group order, of groups that have more than one document; groups numbered anew."""
    if not len(rows):
        return rows, group
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(rows)))
    keep = _several(doc[rows], first)
    return rows[np.repeat(keep, size)], np.repeat(np.arange(int(keep.sum())), size[keep])


def multikey_quicksort(eight: np.ndarray, start: np.ndarray, rows: np.ndarray, group: np.ndarray, doc: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes split by their first `depth` bytes, all groups at once. In each round a group's middle symbol parts it
    in three; the equal part goes on with the next symbol. Returns rows and groups that agree so far and have several
    documents."""
    done_rows, done_groups, n_done = [], [], 0
    rows, group = _alive(rows, group, doc)
    at = np.zeros(int(group[-1]) + 1 if len(group) else 0, np.int64)
    while len(rows):
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        middle = first + np.diff(np.append(first, len(rows))) // 2
        symbol = eight[start[rows] + at[group]].byteswap()  # most significant byte first: numbers order as bytes do
        pivot = symbol[middle][group]
        part = group * 3 + (symbol > pivot) + (symbol >= pivot)
        order = np.argsort(part, kind="stable")
        rows, part = rows[order], part[order]
        names = part[np.concatenate([[True], part[1:] != part[:-1]])]
        kept = np.flatnonzero(_several(doc[rows], np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))))
        rows, group = _alive(rows, part, doc)
        at = at[names[kept] // 3] + 8 * (names[kept] % 3 == 1)
        ready = at >= depth
        mine = ready[group] if len(group) else np.empty(0, bool)
        if mine.any():
            done_rows.append(rows[mine])
            done_groups.append((np.cumsum(ready) - 1)[group[mine]] + n_done)
            n_done += int(ready.sum())
            rows, group, at = rows[~mine], (np.cumsum(~ready) - 1)[group[~mine]], at[~ready]
    return (np.concatenate(done_rows), np.concatenate(done_groups)) if done_rows else (rows, group)


def blind_tries(buffer: np.ndarray, eight: np.ndarray, start: np.ndarray, rows: np.ndarray, group: np.ndarray, doc: np.ndarray, depth: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """One blind trie for each group that agrees to `depth`, grown level by level, all groups at once. A node is the
    first byte where its suffixes branch; the bytes that they share are skipped. Returns rows and groups of the leaves:
    suffixes that agree to `length`."""
    leaf_rows, leaf_groups, n = [], [], 0
    at = [*range(depth, length - 7, 8), length - 8]
    while len(rows):
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        own, lead = start[rows], start[rows[first]][group]
        branch = np.full(len(rows), length)
        for k in reversed(at):
            x = eight[own + k] ^ eight[lead + k]
            low = np.where(x == 0, 0, np.log2(np.maximum(x & (~x + _U(1)), _U(1)).astype(np.float64)).astype(np.int64) >> 3)
            branch = np.where(x != 0, k + low, branch)
        node = np.minimum.reduceat(branch, first)
        leaf = node[group] >= length
        if leaf.any():
            leaf_rows.append(rows[leaf])
            leaf_groups.append((np.cumsum(node >= length) - 1)[group[leaf]] + n)
            n += int((node >= length).sum())
        rows, group = rows[~leaf], group[~leaf]
        child = group * 256 + buffer[start[rows] + node[group]]
        order = np.argsort(child, kind="stable")
        rows, group = _alive(rows[order], child[order], doc)
    return (np.concatenate(leaf_rows), np.concatenate(leaf_groups)) if leaf_rows else (rows, group)


def covered(text: bytes, size: np.ndarray, a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Spans of the strings in stretches that a smaller document has, too. Stretches lie one after another in text."""
    text += bytes(2 * LENGTH)
    buffer, eight = np.frombuffer(text, np.uint8), words_at(text)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    n, lead, doc = a["n"].astype(np.int64), a["lead"].astype(np.int64), a["doc"]
    whole = a["key"] * _U(0x9E3779B97F4A7C15)
    for k in range(0, 2 * LENGTH, 8):
        whole = mix((whole ^ eight[start + np.minimum(k, size - 8)]) + _U(k + 1))
    again = repeats(text, start, size, whole, doc)
    begin = a["pos"].astype(np.int64) - lead
    out = [(np.flatnonzero(again), begin[again], (begin + size)[again])]
    live = np.flatnonzero(~again)
    live = live[np.argsort(a["key"][live], kind="stable")]
    edge = np.flatnonzero(np.concatenate([[True], np.diff(a["key"][live]) != 0])) if len(live) else np.empty(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(n[live])])
    cuts = [0]
    for e, w in zip(edge.tolist(), upto[edge].tolist(), strict=True):  # anchors stay whole
        if w - upto[cuts[-1]] > SORTED:
            cuts.append(e)
    for x, y in zip(cuts, [*cuts[1:], len(live)], strict=True):
        own = live[x:y]
        which = np.repeat(own, n[own])
        j = np.arange(len(which)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
        key, at, d = a["key"][which], start[which] + j, doc[which]
        order = np.lexsort((lead[which] - j, key))
        place = (lead[which] - j)[order]
        group = np.cumsum(np.concatenate([[0], (np.diff(key[order]) != 0) | (np.diff(place) != 0)])) if len(order) else order
        rows, group = multikey_quicksort(eight, at, order, group, d, SHALLOW)
        rows, group = blind_tries(buffer, eight, at, rows, group, d, SHALLOW, LENGTH)
        if not len(rows):
            continue
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        hit = np.sort(rows[d[rows] > np.minimum.reduceat(d[rows], first)[group]])
        run = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(which[hit]) != 0)]))
        last = np.append(run[1:], len(hit)) - 1
        s = which[hit[run]]
        out.append((s, begin[s] + j[hit[run]], begin[s] + j[hit[last]] + LENGTH))
    s, b, e = (np.concatenate([o[i] for o in out]) for i in range(3))
    return spans_of(doc[s], a["tag"][s], b, e)


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


_ROUTED = "kind int, bucket int, blob binary"
#: Kinds of rows: anchors or stretches on their way, and spans that are known.
_WORK, _KNOWN = 0, 1


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    k, b, x = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"kind": pa.array(k, pa.int32()), "bucket": pa.array(b, pa.int32()), "blob": pa.array(x, pa.binary())})


def _split(t: pa.Table) -> tuple[list[bytes], list[bytes]]:
    rows = list(zip(t.column("kind").to_pylist(), t.column("blob").to_pylist(), strict=True))
    return [b for k, b in rows if k == _WORK], [b for k, b in rows if k == _KNOWN]


def covered_spans(docs: DataFrame, n_texts: int, n_anchors: int) -> DataFrame:
    """docs: doc, tag, tb (bucket of the text), text (more may be there). Rows of kind _KNOWN: packed spans by bucket of text."""

    def find(batches):
        kept, spans, seen = [], [], 0

        def send():
            nonlocal kept, spans, seen
            rows = []
            if kept:
                a = {f: np.concatenate([k[f] for k in kept]) for f, _ in _ANCHOR}
                o = np.argsort(a["key"])
                a = {f: v[o] for f, v in a.items()}
                rows += [(_WORK, b, x) for b, x in dealt(_ANCHOR, a, (a["key"] % _U(n_anchors)).astype(np.int64))]
            if spans:
                s = spans_of(*(np.concatenate([x[f] for x in spans]) for f in ("doc", "tag", "start", "stop")))
                rows.append((_KNOWN, int(s["doc"][0] % n_anchors) if len(s["doc"]) else 0, pack(_SPAN, s)))
            kept, spans, seen = [], [], 0
            return _table(rows).to_batches()

        for big in batches:
            for b in runs(big, 2):
                s = Stretches(raw(b.column(2)))
                doc, tag = (b.column(i).to_numpy(zero_copy_only=False)[s.row] for i in (0, 1))
                size = s.n + LENGTH - 1
                again = repeats(s.buffer, s.start, size, s.hash, doc)
                begin = s.start - s.base[s.row]
                spans.append({"doc": doc[again], "tag": tag[again], "start": begin[again], "stop": (begin + size)[again]})
                new = ~again
                kept.append({"key": s.key[new], "doc": doc[new], "tag": tag[new], "pos": (s.anchor - s.base[s.row])[new].astype(np.int32), "lead": (s.anchor - s.start)[new].astype(np.uint8), "n": s.n[new].astype(np.uint8)})
                seen += len(s.buffer)
                if seen >= SEND:
                    yield from send()
        yield from send()

    def shared(t: pa.Table) -> pa.Table:
        blobs, known = _split(t)
        a, _ = unpacked(_ANCHOR, blobs)
        o = np.argsort(a["key"], kind="stable")
        rows, _ = _alive(o, np.cumsum(np.concatenate([[0], np.diff(a["key"][o]) != 0])) if len(o) else o, a["doc"])
        out = [(_WORK, b, x) for b, x in dealt(_ANCHOR, {f: a[f][rows] for f, _ in _ANCHOR}, a["doc"][rows] % n_texts)]
        s, _ = unpacked(_SPAN, known)
        return _table(out + [(_KNOWN, b, x) for b, x in dealt(_SPAN, s, s["doc"] % n_texts)])

    def stretches(texts: pa.Table, t: pa.Table) -> pa.Table:
        blobs, known = _split(t)
        a, _ = unpacked(_ANCHOR, blobs)
        parts = raw(texts.column("text").combine_chunks()) if texts.num_rows else []
        index, base, at = {}, [], 0
        for i, key in enumerate(zip(texts.column("doc").to_pylist(), texts.column("tag").to_pylist(), strict=True)):
            index[key] = at
            at += len(parts[i])
        buffer = np.frombuffer(b"".join(parts), np.uint8)
        base = np.fromiter((index[k] for k in zip(a["doc"].tolist(), a["tag"].tolist(), strict=True)), np.int64, len(a["doc"]))
        start, size = base + a["pos"] - a["lead"], a["n"].astype(np.int64) + LENGTH - 1

        def text(rows):
            s, z = start[rows], size[rows]
            return buffer[np.arange(z.sum()) + np.repeat(s - np.cumsum(z) + z, z)].tobytes()

        out = [(_WORK, b, x) for b, x in dealt(_ANCHOR, a, (a["key"] % _U(n_anchors)).astype(np.int64), text)]
        s, _ = unpacked(_SPAN, known)
        if len(s["doc"]):
            out.append((_KNOWN, int(s["doc"][0] % n_anchors), pack(_SPAN, s)))
        return _table(out)

    def sort(t: pa.Table) -> pa.Table:
        blobs, known = _split(t)
        a, text = unpacked(_ANCHOR, blobs)
        s = covered(text, a["n"].astype(np.int64) + LENGTH - 1, a)
        k, _ = unpacked(_SPAN, known)
        s = spans_of(*(np.concatenate([s[f], k[f]]) for f in ("doc", "tag", "start", "stop")))
        return _table([(_KNOWN, b, x) for b, x in dealt(_SPAN, s, s["doc"] % n_texts)])

    found = docs.select("doc", "tag", "text").mapInArrow(find, _ROUTED)
    several = found.groupBy("bucket").applyInArrow(shared, _ROUTED)
    cut_out = docs.groupBy("tb").cogroup(several.groupBy("bucket")).applyInArrow(stretches, _ROUTED)
    return cut_out.groupBy("bucket").applyInArrow(sort, _ROUTED)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (start, stop; maximal removed runs), kept (bytes)."""
    last = (1 << 63) - 1
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).isNull().alias("none"))
    total = text_bytes(own, "text")
    n_texts, n_anchors = _prime(max(7, -(-total // TEXT_BUCKET))), max(8, -(-total // ANCHOR_BUCKET))
    again = own.groupBy("doc").count().filter("count > 1")
    own = own.withColumn("tag", F.lit(0).cast("long") if again.isEmpty() else F.xxhash64("text"))
    own = own.withColumn("tb", F.pmod("doc", F.lit(n_texts)).cast("int")).select("doc", "tag", "tb", "text", "none")
    place = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def remove(texts: pa.Table, t: pa.Table) -> pa.Table:
        s, _ = unpacked(_SPAN, _split(t)[1])
        s = spans_of(*(s[f] for f in ("doc", "tag", "start", "stop")))
        mine: dict[tuple, list] = {}
        for d, g, a, b in zip(*(s[f].tolist() for f in ("doc", "tag", "start", "stop")), strict=True):
            mine.setdefault((d, g), []).append((a, b))
        ids, sizes, gone, spans, kept = [], [], [], [], []
        for d, g, none, x in zip(*(texts.column(c).to_pylist() for c in ("doc", "tag", "none")), raw(texts.column("text").combine_chunks()) if texts.num_rows else [], strict=True):
            own = mine.get((d, g), [])
            parts, at = [], 0
            for a, b in own:
                parts.append(x[at:a])
                at = b
            parts.append(x[at:])
            ids.append(None if none else d)
            sizes.append(len(x))
            gone.append(sum(b - a for a, b in own))
            spans.append([{"start": a, "stop": b} for a, b in own])
            kept.append(b"".join(parts))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "spans": pa.array(spans, pa.list_(place)), "kept": pa.array(kept, pa.binary())})

    spans = covered_spans(own, n_texts, n_anchors)
    return own.groupBy("tb").cogroup(spans.groupBy("bucket")).applyInArrow(remove, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary")


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
