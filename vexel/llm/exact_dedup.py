"""Exact deduplication by content-defined chunk recipes.

A text, with each run of blanks made one space, is cut where a rolling hash of its last bytes says so. Each chunk gets
an identifier; a text is then the ordered list of its chunks' identifiers (its recipe), and two texts are equal when
their recipes are. Chunk contents move once, after equal chunks have met in the batch that found them; documents are
compared by recipes alone, of which a SHA-256 digest moves, so that a long text costs no more than a short one.

Identifiers are verified: contents that share an identifier are compared byte by byte. Should two differ, recipes that
use that identifier are also told apart by the SHA-256 of the whole text, so a weak identifier costs time, not rows.

Nulls count as empty text (one empty recipe). A null id sorts after all others. Repeated rows are copies like any
other: one of them stays. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import cut, raw, runs

#: Bytes that the rolling hash looks at; the shortest chunk is longer, so no cut depends on an earlier text.
WINDOW = 32
LEAST, MOST, MASK = 256, 8192, (1 << 10) - 1
_SPACES = bytes(32 if 9 <= c <= 13 else c for c in range(256))
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def normalised(text: bytes) -> bytes:
    text = text.translate(_SPACES)
    return re.sub(rb"  +", b" ", text) if b"  " in text else text


def boundaries(buffer: bytes) -> np.ndarray:
    """Positions after which a chunk may end: the rolling hash of the last WINDOW bytes ends in ten zero bits."""
    h = _GEAR[np.frombuffer(buffer, np.uint8)]
    reach = 1
    while reach < WINDOW:  # doubling: the hash over 2r bytes from two hashes over r bytes
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    return np.flatnonzero((h >> np.uint32(16)) & np.uint32(MASK) == 0) + 1


def cuts(size: int, ends: np.ndarray) -> list[int]:
    """Ends of the chunks of a text, from its candidate ends."""
    out, last = [], 0
    for e in ends.tolist():
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e - last >= LEAST and e < size:
            out.append(e)
            last = e
    while size - last > MOST:
        last += MOST
        out.append(last)
    if size > last:
        out.append(size)
    return out


def chunked(texts: list[bytes]) -> Iterator[tuple[bytes, list[bytes]]]:
    """Each normalised text with its chunks."""
    texts = [normalised(t) for t in texts]
    ends = boundaries(b"".join(texts)) if any(texts) else np.empty(0, np.int64)
    at = 0
    for t in texts:
        own = ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + len(t), "right")] - at
        a, parts = 0, []
        for b in cuts(len(t), own):
            parts.append(t[a:b])
            a = b
        yield t, parts
        at += len(t)


def identifier(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def recipes(docs: DataFrame, text_col: str, digest_bytes: int) -> DataFrame:
    """Replaces the text by recipe (identifiers joined), n_chunks and text_sha256; other columns stay."""
    others = [c for c in docs.columns if c != text_col]
    docs = docs.select(*others, text_col)

    def work(batches):
        for big in batches:
            for b in runs(big, len(others)):
                made, shas, n = [], [], []
                for t, parts in chunked(raw(b.column(len(others)))):
                    made.append(b"".join(identifier(p, digest_bytes) for p in parts))
                    shas.append(hashlib.sha256(t).hexdigest())
                    n.append(len(parts))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(made, pa.binary()), pa.array(n, pa.int32()), pa.array(shas, pa.string())], names=[*others, "recipe", "n_chunks", "text_sha256"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != text_col)
    return docs.mapInArrow(work, schema + "recipe binary, n_chunks int, text_sha256 string")


def chunk_store(docs: DataFrame, text_col: str, digest_bytes: int) -> DataFrame:
    """Distinct (identifier, chunk) over all texts."""

    def work(batches):
        for big in batches:
            for b in runs(big, 0, 16 << 20):
                met = {}
                for _, parts in chunked(raw(b.column(0))):
                    for p in parts:
                        met[p] = None
                yield pa.RecordBatch.from_arrays([pa.array([identifier(p, digest_bytes) for p in met], pa.binary()), pa.array(list(met), pa.binary())], names=["digest", "chunk"])

    return docs.select(text_col).mapInArrow(work, "digest binary, chunk binary").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 16, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks, and the columns named in extra."""
    own = docs.select(F.col(id_col).alias("doc_id"), *extra, F.col(text_col).alias("_text"))
    rows = cut(recipes(own, "_text", digest_bytes).withColumn("_tag", F.monotonically_increasing_id()))
    shared = cut(chunk_store(own, "_text", digest_bytes).groupBy("digest").count().filter("count > 1").select("digest"))
    rows = rows.withColumn("_apart", F.lit(""))
    if not shared.isEmpty():
        part = F.expr(f"explode(transform(sequence(0, n_chunks - 1), i -> substring(recipe, i * {digest_bytes} + 1, {digest_bytes})))")
        told = rows.filter("n_chunks > 0").select("_tag", part.alias("digest")).join(shared, "digest", "left_semi").select("_tag").distinct().withColumn("_told", F.lit(True))
        rows = rows.join(told, "_tag", "left").withColumn("_apart", F.when(F.col("_told"), F.col("text_sha256")).otherwise("")).drop("_told")
    rows = rows.withColumn("_recipe", F.sha2("recipe", 256)).drop("recipe")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("_tag").alias("tag"))).alias("_first")
    groups = rows.groupBy("_recipe", "_apart").agg(first, F.count("*").alias("group_size")).filter("group_size > 1")
    out = rows.join(groups, ["_recipe", "_apart"], "left")
    return out.select(
        "doc_id", *extra,
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("_first.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_first.tag") == F.col("_tag"), F.lit(True)).alias("kept"),
        "text_sha256", "n_chunks",
    )
