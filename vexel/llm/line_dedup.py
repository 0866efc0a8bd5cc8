"""Line deduplication: lines whose key occurs in many documents are dropped from every one of them.

A line's key is the line without blanks at its ends, A-Z lower-cased, hashed to 128 bits. Lines are exploded to (document,
position, key). Each text gives each of its keys once, batches add up their counts, and one aggregation by key sums them:
a line that half of all documents hold reaches its task as one row per batch. The exploded lines of keys over the
threshold are the dropped ones; their positions go back to their documents, and what is left is put together by position.

A document is named by a digest of its id and text, so that any input plan may be read twice, and copies are names of
their own; lines of one key are dealt over SALTS tasks where their keys are joined. With `broadcast_keys` above 0, up to
so many common keys are sent to the texts instead, which then do not move; the rows are the same.

Null or empty texts are one empty line, and empty keys are never dropped. Every row counts as a document, repeated rows
and null ids too. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import BLANKS, cut, raw, runs

DOCUMENTS = 10
#: Common keys that are sent to the texts: by default none.
BROADCAST_KEYS = 0
#: Tasks among which the lines of one key are dealt.
SALTS = 16


def key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()  # bytes.lower() changes A-Z alone


def hashed(line: bytes) -> bytes:
    """b"" for an empty key, which is never dropped."""
    return hashlib.blake2b(k, digest_size=16).digest() if (k := key(line)) else b""


def common_keys(docs: DataFrame, text_col: str, documents: int) -> DataFrame:
    """Hashes of the keys that at least so many documents hold."""

    def work(batches):
        for big in batches:
            for b in runs(big, 0, 16 << 20):
                met: dict[bytes, int] = {}
                for t in raw(b.column(0)):
                    for h in {hashed(x) for x in t.split(b"\n")}:
                        met[h] = met.get(h, 0) + 1
                met.pop(b"", None)
                yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.binary()), pa.array(list(met.values()), pa.int64())], names=["key", "n"])

    return docs.select(text_col).mapInArrow(work, "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= documents).select("key")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = DOCUMENTS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept (the text that stays)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    common = cut(common_keys(docs, "_text", documents))
    schema = "doc_id bigint, n_lines bigint, n_dropped bigint, kept string".replace("doc_id bigint", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    if broadcast_keys and common.count() <= broadcast_keys:
        drop = docs.sparkSession.sparkContext.broadcast(b"".join(sorted(bytes(r.key) for r in common.toLocalIterator())))

        def by_set(batches):
            x = drop.value
            gone = {x[i : i + 16] for i in range(0, len(x), 16)}
            for big in batches:
                for b in runs(big, 1):
                    yield kept(b, [[i for i, y in enumerate(t.split(b"\n")) if hashed(y) in gone] for t in raw(b.column(1))])

        return docs.mapInArrow(by_set, schema)
    docs = docs.withColumn("_row", F.sha2(F.concat(F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256), F.coalesce("_text", F.lit(""))), 256))

    def explode(batches):
        for big in batches:
            for b in runs(big, 1):
                lines = [[hashed(y) for y in t.split(b"\n")] for t in raw(b.column(1))]
                rows = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in lines]))
                at = np.concatenate([np.arange(len(x)) for x in lines]) if lines else np.empty(0, np.int64)
                keys = pa.array([y for x in lines for y in x], pa.binary())
                some = pa.compute.not_equal(keys, b"")
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array(at, pa.int32()), keys], names=["_row", "at", "key"]).filter(some)

    salted = common.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lines = docs.select("_row", "_text").mapInArrow(explode, "_row string, at int, key binary").withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    dropped = lines.join(salted, ["key", "_salt"], "left_semi").groupBy("_row").agg(F.collect_set("at").alias("_at"))

    def by_rows(batches):
        for big in batches:
            for b in runs(big, 1):
                yield kept(b, [x or [] for x in b.column(2).to_pylist()])

    return docs.join(dropped.hint("shuffle_hash"), "_row", "left").select("doc_id", "_text", "_at").mapInArrow(by_rows, schema)


def kept(b: pa.RecordBatch, gone: list[list[int]]) -> pa.RecordBatch:
    texts, sizes = [], []
    for t, x in zip(raw(b.column(1)), gone, strict=True):
        lines = t.split(b"\n")
        sizes.append(len(lines))
        if x:
            drop = set(x)
            t = b"\n".join(y for i, y in enumerate(lines) if i not in drop)
        texts.append(t)
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array([len(x) for x in gone], pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
