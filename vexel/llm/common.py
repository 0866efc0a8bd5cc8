"""Pieces that the corpus operators share: checkpoints, batch cutting, word and shingle hashes."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes that separate words in the corpus contracts: space and \x09-\x0D.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Text bytes that one numpy pass handles; a single longer text makes a pass of its own.
PASS_BYTES = 2 << 20
#: Words longer than this are hashed one by one.
LONG_WORD = 256

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all run in one machine, as
    in tests, a folder of our own; on a cluster that would lose data and is refused."""
    sc = spark.sparkContext
    if (at := spark.conf.get("spark.checkpoint.dir", None)) is None:
        if sc.getCheckpointDir() is None:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="vexel-checkpoint-"))
        return sc.getCheckpointDir()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written to the shared folder, so that a lost executor costs no upstream work."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of all texts of a column; one cheap pass."""
    return df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0


def runs(batch: pa.RecordBatch, column: int, most: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about `most` bytes in a column."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Points:
    """Code points of a text before a byte; asked in any order, each text is read once."""

    def __init__(self, text: bytes):
        self.heads = None if text.isascii() else np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80, dtype=np.int64)

    def __call__(self, byte: int) -> int:
        return byte if self.heads is None else int(self.heads[byte - 1]) if byte else 0


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """Words of many texts, found and hashed in whole arrays.

    table: 256 bytes, maps each separator to a space and every other byte to its normal form.
    first: for each text, the index of its first word; one entry more at the end.
    """

    def __init__(self, texts: list[bytes], table: bytes):
        self.buffer = b" " + b" ".join(texts).translate(table) + b" " * 9
        a = np.frombuffer(self.buffer, np.uint8)
        inside = a != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edges[0::2], edges[1::2]
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        self.first = np.searchsorted(self.start, at + 1)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, made from its bytes eight at a time."""
        eight = np.ndarray((len(self.buffer) - 7,), "<u8", self.buffer, 0, (1,))
        size = self.end - self.start
        masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
        h = mix(size.astype(np.uint64) + _ODD)
        left, at, who = np.minimum(size, LONG_WORD), self.start, None
        while len(left):
            part = eight[at] & masks[np.minimum(left, 8)]
            if who is None:
                h = mix((h ^ part) * _ODD)
            else:
                h[who] = mix((h[who] ^ part) * _ODD)
            more = np.flatnonzero(left > 8)
            who = more if who is None else who[more]
            left, at = left[more] - 8, at[more] + 8
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.buffer[self.start[i] : self.end[i]], digest_size=8).digest(), "little")
        return h

    def text(self, i: int, n: int) -> bytes:
        """Words i to i + n - 1, joined by one space."""
        return b" ".join(self.buffer[self.start[i] : self.end[i + n - 1]].split())


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on, across text ends too; shorter by n - 1."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out += h[j : len(h) - n + 1 + j] * _U((0xD1342543DE82EF95 * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF)
    return mix(out + _U(n))


def blank_table(lower: bool) -> bytes:
    """Separators are the blanks alone; A-Z lower-cased on request."""
    t = bytearray(range(256))
    for c in BLANKS:
        t[c] = 32
    if lower:
        for c in range(65, 91):
            t[c] = c + 32
    return bytes(t)


def running_sum(df: DataFrame, keys: list[str], order: list, value: str, slice_col: str, out: str) -> DataFrame:
    """Sum of `value` over the rows of the same keys that come before, in the order (slice_col, *order).

    slice_col cuts a hot key into slices: each task sorts the rows of one slice, and only the slices' totals are
    summed over the whole key."""
    totals = df.groupBy(*keys, slice_col).agg(F.sum(value).alias("_slice_total"))
    w = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_before", F.coalesce(F.sum("_slice_total").over(w), F.lit(0))).drop("_slice_total")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, slice_col]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = df.alias("a").join(before.alias("b"), cond, "left").select("a.*", F.col("b._before"))
    inner = Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, (F.col("_before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).cast("long")).drop("_before")
