"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned against every text.

Words are maximal runs of digits, letters a-z (A-Z lower-cased first) and everything beyond ASCII. A window is 10
consecutive words of a benchmark item; an item of fewer words is one window. Window hashes go to the executors in
sorted arrays of bounded size. Each document window whose hash is there is verified against the window's own words,
and then marks its words as hit. Documents are never split or moved.

A benchmark with more than `block_windows` windows is dealt into blocks by window and item, so that a window that many
items share is spread over them. Each block is scanned in a job of its own, hits alone are kept, and they are put together
per text, so memory stays bounded and no window is left out.

Null texts have no words. An item without words gives no window; one without an id marks words like any other and
is not among the items. Items that repeat an id count once. Repeated
documents are each reported. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import Words, cut, grams, raw, runs

WORDS = 10
#: Windows in one broadcast block: some 60 bytes each, so 30 MB at most.
BLOCK_WINDOWS = 500_000
FILTER_BITS = 20

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def windows(bench: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """item_id and each of its distinct windows: size in words, words joined by spaces."""

    def work(batches):
        for big in batches:
            for b in runs(big, 1):
                w = Words(raw(b.column(1)), _TABLE)
                ids, sizes, texts = [], [], []
                for item, a, c in zip(b.column(0).to_pylist(), w.first[:-1].tolist(), w.counts().tolist(), strict=True):
                    own = {w.text(i, min(n, c)) for i in range(a, a + max(1, c - n + 1))} if c else ()
                    ids += [item] * len(own)
                    sizes += [min(n, c)] * len(own)
                    texts += own
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(sizes, pa.int32()), pa.array(texts, pa.binary())], names=["item_id", "size", "window"])

    kind = bench.schema[id_col].dataType.simpleString()
    return bench.select(id_col, text_col).mapInArrow(work, f"item_id {kind}, size int, window binary").distinct()


class Block:
    """Windows of one block: by size, their sorted hashes and a bit filter; by words, the items."""

    def __init__(self, rows: list[tuple]):
        self.items: dict[bytes, list] = {}
        sizes: dict[int, list[bytes]] = {}
        for item, size, text in rows:
            text = bytes(text)
            if text not in self.items:
                self.items[text] = []
                sizes.setdefault(size, []).append(text)
            self.items[text].append(item)
        self.hashes, self.filters = {}, {}
        for size, texts in sizes.items():
            h = grams(Words(texts, _TABLE).hashes(), size)[::size]  # each text has just this many words
            self.hashes[size] = np.sort(h)
            self.filters[size] = np.zeros(1 << FILTER_BITS, bool)
            self.filters[size][h >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, w: Words) -> tuple[list[int], list[int], list[list]]:
        """First word, size and items of every verified window."""
        at, sizes, items = [], [], []
        h, last = w.hashes(), np.repeat(w.first[1:], w.counts())
        for size, known in self.hashes.items():
            g = grams(h, size)
            ok = np.flatnonzero(self.filters[size][g >> np.uint64(64 - FILTER_BITS)])
            ok = ok[known[np.minimum(np.searchsorted(known, g[ok]), len(known) - 1)] == g[ok]]
            for i in ok[ok + size <= last[ok]].tolist():
                if found := self.items.get(w.text(i, size)):
                    at.append(i)
                    sizes.append(size)
                    items.append(found)
        return at, sizes, items


def _spans(mark: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


def scan(docs: DataFrame, text_col: str, block, item_type: str, only_hits: bool = False) -> DataFrame:
    """Replaces the text by n_words, hit spans in words [start, end) and the sorted items; other columns stay."""
    others = [c for c in docs.columns if c != text_col]
    docs = docs.select(*others, text_col)

    def work(batches):
        for big in batches:
            for b in runs(big, len(others)):
                w = Words(raw(b.column(len(others))), _TABLE)
                counts = w.counts()
                at, sizes, items = block.value.hits(w)
                spans, found = [[] for _ in counts], [[] for _ in counts]
                if at:
                    delta = np.zeros(len(w.start) + 1, np.int32)
                    np.add.at(delta, at, 1)
                    np.add.at(delta, np.add(at, sizes), -1)
                    mark = np.cumsum(delta[:-1]) > 0
                    text_of = np.searchsorted(w.first, at, "right") - 1
                    who: dict[int, set] = {}
                    for d, x in zip(text_of.tolist(), items, strict=True):
                        who.setdefault(d, set()).update(x)
                    for d, x in who.items():
                        spans[d] = [{"start": s, "stop": e} for s, e in _spans(mark[w.first[d] : w.first[d + 1]])]
                        found[d] = sorted(i for i in x if i is not None)
                out = pa.RecordBatch.from_arrays(
                    [*b.columns[: len(others)], pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(found, pa.list_(kind))],
                    names=[*others, "n_words", "spans", "items"],
                )
                yield out.filter(pa.array([bool(x) for x in spans])) if only_hits else out

    kind = pa.string() if item_type == "string" else {"bigint": pa.int64(), "int": pa.int32()}[item_type]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != text_col)
    return docs.mapInArrow(work, schema + f"n_words bigint, spans array<struct<start: bigint, stop: bigint>>, items array<{item_type}>")


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = WORDS, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, spans (hit words, [start, stop)), items (ids whose windows occur), one row per document."""
    spark = docs.sparkSession
    if not isinstance(kind := bench.schema[item_col].dataType.simpleString(), str) or kind not in ("bigint", "int", "string"):
        raise ValueError(f"benchmark ids of type {kind}")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    found = cut(windows(bench, item_col, item_text, n))
    blocks = max(1, -(-found.count() // block_windows))
    if blocks == 1:
        return scan(docs, "_text", spark.sparkContext.broadcast(Block(found.collect())), kind)
    found = found.withColumn("_block", F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks)))
    keyed = docs.withColumn("_key", F.sha2(F.coalesce("_text", F.lit("")), 256))
    parts = []
    for k in range(blocks):
        block = spark.sparkContext.broadcast(Block(found.filter(F.col("_block") == k).drop("_block").collect()))
        parts.append(cut(scan(keyed, "_text", block, kind, only_hits=True).dropDuplicates(["doc_id", "_key"])))
        block.destroy()
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    hits = hits.groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_k")).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    union = F.expr("""aggregate(_spans, cast(array() as array<struct<start: bigint, stop: bigint>>), (a, s) ->
        if(size(a) > 0 and element_at(a, -1).stop >= s.start,
           concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, greatest(element_at(a, -1).stop, s.stop) as stop))),
           concat(a, array(s))))""")
    nothing = spark.sparkContext.broadcast(Block([]))
    sizes = scan(keyed, "_text", nothing, kind).drop("spans", "items")
    out = sizes.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")), "left")
    return out.select("doc_id", "n_words", F.coalesce(union, F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)")).alias("spans"), F.coalesce("items", F.expr(f"cast(array() as array<{kind}>)")).alias("items"))


def digest(hits: DataFrame) -> DataFrame:
    """The contract's columns from decontaminate()'s."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = WORDS) -> DataFrame:
    """Documents, all columns, that hold no benchmark window. Beyond one block of windows, blocks run one by one."""
    found = cut(windows(bench, item_col, item_text, n).select(F.lit(None).cast("string").alias("item_id"), "size", "window").distinct())
    blocks = max(1, -(-found.count() // BLOCK_WINDOWS))
    found = found.withColumn("_block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    sc, columns = docs.sparkSession.sparkContext, docs.columns
    for k in range(blocks):
        block = sc.broadcast(Block(found.filter(F.col("_block") == k).drop("_block").collect()))

        def work(batches, block=block):
            for big in batches:
                for b in runs(big, columns.index(text_col)):
                    w = Words(raw(b.column(columns.index(text_col))), _TABLE)
                    keep = np.ones(b.num_rows, bool)
                    keep[np.searchsorted(w.first, block.value.hits(w)[0], "right") - 1] = False
                    yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(work, docs.schema)
        if k + 1 < blocks:
            docs = cut(docs)
    return docs


def sha(items: list) -> str:
    """The digest of a list of item ids, as in digest()."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
