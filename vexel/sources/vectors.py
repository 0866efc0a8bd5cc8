"""Vector files: readers as a Spark data source cut by row ranges, writers, and importers of index files.

All numbers are little-endian.
    fvecs, ivecs, bvecs   each row: dim i32, then dim values (f32, i32, u8)
    u8bin, fbin           n i32, dim i32, then n * dim values (u8, f32)
    gt                    n i32, k i32, then n * k ids i32 (distances may follow and are not read)

Tasks read their own row ranges, from any store that pyarrow.fs opens by its address: file, s3, gs, hdfs, or a plain path
that every executor sees. A folder that write_parts() has made is read like one file.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vexel.functions.hashing import digest_bits
from vexel.operators.kernels import matrix

_VALUE = {"fvecs": "<f4", "ivecs": "<i4", "bvecs": "u1", "u8bin": "u1", "fbin": "<f4", "gt": "<i4"}
_SCHEMA = {"f": "id bigint, vec array<float>", "i": "id bigint, vec array<int>", "u": "id bigint, vec array<smallint>"}
MOST_DIM = 4096
ROWS = 65536
#: In a folder of parts: which files count, in what order, with how many rows.
MANIFEST = "_manifest.json"


def store_of(path: str) -> tuple[stores.FileSystem, str]:
    """The file system of an address, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    if "://" not in path:
        return stores.LocalFileSystem(), path
    return stores.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def size_of(path: str) -> int:
    store, at = store_of(path)
    info = store.get_file_info(at)
    if info.type != stores.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def slice_of(path: str, start: int, size: int) -> bytes:
    store, at = store_of(path)
    with store.open_input_file(at) as f:
        f.seek(start)
        return f.read(size)


def put(path: str, pieces) -> None:
    """Writes a file of these pieces under another name and then gives it its own."""
    store, at = store_of(path)
    with store.open_output_stream(at + ".part") as f:
        for x in pieces:
            f.write(x)
    store.move(at + ".part", at)


def infer_format(path: str) -> str:
    end = path.rsplit(".", 1)[-1].lower()
    return end if end in _VALUE else "u8bin"


def header(path: str) -> tuple[int, int]:
    """(n, dim) of a file that starts with both."""
    if len(head := slice_of(path, 0, 8)) < 8:
        raise ValueError(f"{path}: no header")
    n, dim = struct.unpack("<ii", head)
    if n < 0 or dim <= 0:
        raise ValueError(f"{path}: header {n}, {dim}")
    return n, dim


def shape(path: str, kind: str) -> tuple[int, int, int, int]:
    """Rows that are there, dim, bytes before the first row, bytes of a row."""
    size, width = size_of(path), np.dtype(_VALUE[kind]).itemsize
    if kind.endswith("vecs"):
        if not size:
            return 0, 0, 0, 0
        dim = struct.unpack("<i", slice_of(path, 0, 4))[0]
        if not 0 < dim <= MOST_DIM:
            raise ValueError(f"{path}: {dim} values in a row")
        if size % (4 + dim * width):
            raise ValueError(f"{path}: its size is no multiple of a row's")
        return size // (4 + dim * width), dim, 0, 4 + dim * width
    n, dim = header(path)
    there = (size - 8) // (dim * width)
    if there < n and kind != "u8bin":
        raise ValueError(f"{path}: {there} of {n} rows")
    return min(n, there), dim, 8, dim * width


class _Rows(InputPartition):
    """Rows first to last - 1 of a file, whose row 0 has the id `base`."""

    def __init__(self, path: str, first: int, last: int, base: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last, self.base = path, first, last, base


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, most: int | None, rows: int):
        self.kind, self.rows = kind, rows
        parts = parts_of(path)
        if parts is None:
            n, self.dim, self.skip, self.width = shape(path, kind)
            self.files = [(path, n)]
        else:
            self.files = [(f"{path.rstrip('/')}/{p['name']}", p["n"]) for p in parts]
            _, self.dim, self.skip, self.width = shape(self.files[0][0], kind) if parts else (0, 0, 0, 0)
        self.most = most

    def partitions(self):
        out, base = [], 0
        for path, n in self.files:
            upto = n if self.most is None else min(n, self.most - base)
            out += [_Rows(path, a, min(a + self.rows, upto), base) for a in range(0, upto, self.rows)]
            base += n
        return out or [_Rows("", 0, 0, 0)]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(_VALUE[self.kind])
        out = {"f": pa.float32(), "i": pa.int32(), "u": pa.int16()}[kind.kind]
        if part.first == part.last:
            return
        store, at = store_of(part.path)
        with store.open_input_file(at) as f:
            f.seek(self.skip + part.first * self.width)
            for a in range(part.first, part.last, 4096):
                n = min(4096, part.last - a)
                raw = np.frombuffer(f.read(n * self.width), np.uint8).reshape(n, self.width)
                if self.kind.endswith("vecs"):
                    if (raw[:, :4].copy().view("<i4") != self.dim).any():
                        raise ValueError(f"{part.path}: a row has another number of values")
                    raw = raw[:, 4:]
                v = np.ascontiguousarray(raw).view(kind).reshape(n, self.dim)
                ids = pa.array(np.arange(part.base + a, part.base + a + n, dtype=np.int64))
                flat = pa.array(v.ravel().astype(out.to_pandas_dtype()), out)
                yield pa.RecordBatch.from_arrays([ids, pa.FixedSizeListArray.from_arrays(flat, self.dim).cast(pa.list_(out))], names=["id", "vec"])


class VectorFile(DataSource):
    """spark.read.format("vexel").option("path", ...): options kind (or auto), max_n, rows (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "vexel"

    def _kind(self) -> str:
        kind = self.options.get("kind", "auto")
        return infer_format(self.options["path"].rstrip("/")) if kind == "auto" else kind

    def schema(self) -> str:
        return _SCHEMA[np.dtype(_VALUE[self._kind()]).kind]

    def reader(self, schema) -> DataSourceReader:
        most = self.options.get("max_n")
        return _Reader(self.options["path"], self._kind(), int(most) if most else None, int(self.options.get("rows", ROWS)))


def read_vectors(spark: SparkSession, path: str, kind: str = "auto", max_n: int | None = None, rows: int = ROWS) -> DataFrame:
    """id, vec. max_n: that many rows from the start."""
    spark.dataSource.register(VectorFile)
    reader = spark.read.format("vexel").option("kind", kind).option("rows", rows)
    return (reader.option("max_n", max_n) if max_n else reader).load(path)


def read_truth(spark: SparkSession, path: str, k: int | None = None, kind: str = "gt") -> DataFrame:
    """qid, rank, id; the first k of each query, who must have as many."""
    width = shape(path, kind)[1]
    if k is not None and k > width:
        raise ValueError(f"{path}: {width} neighbours, {k} are asked for")
    t = read_vectors(spark, path, kind).select(F.col("id").alias("qid"), F.posexplode("vec").alias("p", "n"))
    t = t.select("qid", (F.col("p") + 1).alias("rank"), F.col("n").cast("long").alias("id"))
    return t if k is None else t.filter(F.col("rank") <= k)


def read_rows(base: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of a stated set of ids."""
    return base.join(ids.select("id"), "id", "left_semi")


def random_vectors(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """Uniform in [-1, 1), the same for the same seed however the rows are dealt: 24 bits of a digest of id, seed and place."""
    x = lambda i: (digest_bits(6, F.col("id"), F.lit(seed), i) / float(1 << 23) - 1).cast("float")
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(dim)), x).alias("vec"))


def encoded(v: np.ndarray, kind: str) -> bytes:
    """Rows of a matrix as they stand in a file."""
    raw = np.ascontiguousarray(v.astype(_VALUE[kind])).view(np.uint8).reshape(len(v), -1)
    if kind.endswith("vecs"):
        raw = np.concatenate([np.broadcast_to(np.frombuffer(struct.pack("<i", v.shape[1]), np.uint8), (len(v), 4)), raw], axis=1)
    return raw.tobytes()


def _pieces(rows: DataFrame, encode, *columns: str):
    """Bytes of the rows in the order of their first columns. Tasks encode them; the driver only passes them on, piece by piece."""

    def work(batches):
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                yield pa.RecordBatch.from_arrays([pa.array([encode(b.slice(a, 4096))], pa.binary())], names=["blob"])

    for r in rows.select(*columns).orderBy(*columns[:-1]).mapInArrow(work, "blob binary").toLocalIterator(prefetchPartitions=True):
        yield bytes(r.blob)


def _shape(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi")).first()
    if r.lo != r.hi:
        raise ValueError("vectors of different length")
    return r.n, r.hi or 0


def write_vectors(df: DataFrame, path: str, kind: str) -> int:
    """Rows by id into one file; returns how many."""
    n, dim = _shape(df)
    head = [] if kind.endswith("vecs") else [struct.pack("<ii", n, dim)]
    put(path, (x for part in (head, _pieces(df, lambda b: encoded(matrix(b.column(1), dim), kind), "id", "vec")) for x in part))
    return n


def write_parts(df: DataFrame, folder: str, kind: str, rows: int = ROWS) -> int:
    """Rows by id into a folder of files, each whole by itself, written by the tasks; no row passes the driver. Files of
    attempts that failed are not in the manifest and are not read."""
    folder = folder.rstrip("/")
    store, at = store_of(folder)
    store.create_dir(at, recursive=True)
    ordered = df.select("id", "vec").orderBy("id").withColumn("_p", F.spark_partition_id())

    def work(batches):
        held, n, seq = [], 0, 0

        def flush():
            nonlocal held, n, seq
            t = pa.Table.from_batches(held)
            v = matrix(t.column("vec"))
            p, name = t.column("_p")[0].as_py(), f"{uuid.uuid4().hex}.{kind}"
            head = [] if kind.endswith("vecs") else [struct.pack("<ii", *v.shape)]
            put(f"{folder}/{name}", [*head, encoded(v, kind)])
            out = pa.RecordBatch.from_pylist([{"p": p, "seq": seq, "name": name, "n": len(v), "dim": v.shape[1]}], pa.schema([("p", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("n", pa.int64()), ("dim", pa.int32())]))
            held, n, seq = [], 0, seq + 1
            return out

        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, rows - n))
                b = b.slice(rows - n)
                n += held[-1].num_rows
                if n == rows:
                    yield flush()
        if n:
            yield flush()

    made = sorted(ordered.mapInArrow(work, "p int, seq int, name string, n bigint, dim int").collect())  # one row for each file
    if len({r.dim for r in made}) > 1:
        raise ValueError("vectors of different length")
    put(f"{folder}/{MANIFEST}", [json.dumps([{"name": r["name"], "n": r.n} for r in made]).encode()])
    return sum(r.n for r in made)


def parts_of(path: str) -> list[dict] | None:
    """The files of a folder that write_parts() has made; None for a file."""
    store, at = store_of(path.rstrip("/"))
    if store.get_file_info(at).type != stores.FileType.Directory:
        return None
    return json.loads(slice_of(f"{path.rstrip('/')}/{MANIFEST}", 0, size_of(f"{path.rstrip('/')}/{MANIFEST}")))


def write_truth(truth: DataFrame, path: str, k: int) -> int:
    rows = truth.filter(F.col("rank") <= k).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("vec"))
    return write_vectors(rows.select(F.col("qid").alias("id"), "vec"), path, "gt")


def bvecs_to_u8bin(spark: SparkSession, source: str, target: str) -> int:
    return write_vectors(read_vectors(spark, source, "bvecs"), target, "u8bin")


def fbin_to_u8bin(spark: SparkSession, source: str, target: str, sample: int = 1_000_000) -> tuple[float, float]:
    """Values between the least and greatest of the first `sample` rows become 0..255; a .scale file keeps both."""
    from vexel.operators.quant import min_max, minmax_u8

    rows = read_vectors(spark, source, "fbin")
    lo, hi = min_max(rows.filter(F.col("id") < sample))
    write_vectors(rows.select("id", minmax_u8(F.col("vec"), lo, hi).alias("vec")), target, "u8bin")
    put(target + ".scale", [f"{lo}\n{hi}\n{255.0 / (hi - lo) if hi > lo else 1.0}\n".encode()])
    return lo, hi


def write_centroids(c: np.ndarray, path: str) -> None:
    put(path, [struct.pack("<ii", *c.shape) + c.astype("<f4").tobytes()])


def read_centroids(path: str) -> np.ndarray:
    n, dim = header(path)
    return np.frombuffer(slice_of(path, 8, 4 * n * dim), "<f4").reshape(n, dim).astype(np.float64)


def write_assign(assigned: DataFrame, path: str) -> int:
    """n i64, then the list of each row, by id."""
    n = assigned.count()
    put(path, (x for part in ([struct.pack("<q", n)], _pieces(assigned, lambda b: b.column(1).to_numpy().astype("<i4").tobytes(), "id", "cid")) for x in part))
    return n


def with_assign(rows: DataFrame, path: str) -> DataFrame:
    """Adds cid to rows that have an id: each batch reads its own stretch of the file, and nothing is joined."""
    at = rows.columns.index("id")
    n = struct.unpack("<q", slice_of(path, 0, 8))[0]

    def work(batches):
        for b in batches:
            ids = b.column(at).to_numpy()
            if len(ids) and not (0 <= ids.min() and ids.max() < n):
                raise ValueError(f"{path}: {n} rows, there are ids beyond")
            got = np.frombuffer(slice_of(path, 8 + 4 * int(ids.min()), 4 * int(ids.max() - ids.min() + 1)), "<i4")[ids - ids.min()] if len(ids) else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.int32())], names=[*b.schema.names, "cid"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, f"{schema}, cid int")


def read_assign(spark: SparkSession, path: str) -> DataFrame:
    """id, cid."""
    return with_assign(spark.range(struct.unpack("<q", slice_of(path, 0, 8))[0]), path)


def load_clustered(spark: SparkSession, base: str, assign: str, kind: str = "auto", keep_bytes: bool = False, partitions: int | None = None) -> DataFrame:
    """id, cid, vec of a base file and its lists, rows of a list together and sorted. Values become floats unless
    keep_bytes asks for them as they are."""
    from vexel.operators.layout import cluster_major

    rows = with_assign(read_vectors(spark, base, kind), assign)
    return cluster_major(rows.select("id", "cid", F.col("vec") if keep_bytes else F.col("vec").cast("array<float>").alias("vec")), partitions)


def write_codebook(words: list[np.ndarray], path: str) -> None:
    """Equal widths: M, K, width, 0. Others: M, K, -1, 1, then widths, their offsets and the words' offsets."""
    widths = [w.shape[1] for w in words]
    if len(set(widths)) == 1:
        head = struct.pack("<iiii", len(words), len(words[0]), widths[0], 0)
    else:
        places = np.cumsum([0, *widths[:-1]])
        at = np.cumsum([0, *(w.size for w in words[:-1])])
        head = struct.pack("<iiii", len(words), len(words[0]), -1, 1) + np.array(widths, "<i4").tobytes() + places.astype("<i4").tobytes() + at.astype("<i8").tobytes()
    put(path, [head, *(w.astype("<f4").tobytes() for w in words)])


def read_codebook(path: str) -> list[np.ndarray]:
    data = slice_of(path, 0, size_of(path))
    (m, k, width, uneven), at = struct.unpack_from("<iiii", data), 16
    widths = [width] * m
    if uneven:
        widths = np.frombuffer(data, "<i4", m, at).tolist()
        at += 16 * m
    if len(data) != at + 4 * k * sum(widths):
        raise ValueError(f"{path}: longer than its shape")
    edges = at + 4 * k * np.cumsum([0, *widths])
    return [np.frombuffer(data, "<f4", k * w, e).reshape(k, w).astype(np.float64) for w, e in zip(widths, edges.tolist(), strict=False)]


def write_codes(codes: DataFrame, path: str) -> int:
    """n i64, M i32, pad i32, then the codes as bytes by (cid, id)."""
    r = codes.agg(F.count("*").alias("n"), F.max(F.size("codes")).alias("m")).first()
    encode = lambda b: matrix(b.column(2), r.m).astype(np.uint8).tobytes()
    put(path, (x for part in ([struct.pack("<qii", r.n, r.m or 0, 0)], _pieces(codes, encode, "cid", "id", "codes")) for x in part))
    return r.n


def codes_shape(path: str) -> tuple[int, int]:
    n, m, _ = struct.unpack("<qii", slice_of(path, 0, 16))
    return n, m


def read_codes(path: str) -> np.ndarray:
    n, m = codes_shape(path)
    return np.frombuffer(slice_of(path, 16, n * m), np.uint8).reshape(n, m)


def code_rows(spark: SparkSession, path: str) -> DataFrame:
    """pos, codes: by the place in the order (cid, id). Each task reads its own stretch."""
    n, m = codes_shape(path)

    def work(batches):
        for b in batches:
            pos = b.column(0).to_numpy()
            if len(pos):
                got = np.frombuffer(slice_of(path, 16 + int(pos[0]) * m, len(pos) * m), np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(got.astype(np.int16)), m).cast(pa.list_(pa.int16()))], names=["pos", "codes"])

    return spark.range(n).mapInArrow(work, "pos bigint, codes array<smallint>")


def append_csv(path: str, row: dict) -> None:
    """One result row; the header is written with the first. A plain path: stores without appending are refused by it."""
    import csv

    new = not os.path.exists(path) or not os.path.getsize(path)
    with open(path, "a", newline="") as f:
        w = csv.DictWriter(f, list(row))
        if new:
            w.writeheader()
        w.writerow(row)


def write_metrics(path: str, metrics: dict) -> None:
    """JSON, in place of the old file at once."""
    put(path, [json.dumps(metrics, indent=1, sort_keys=True).encode()])
