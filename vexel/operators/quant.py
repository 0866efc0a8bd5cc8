"""Scalar quantisers: half precision with scale and zero point, and bytes between minimum and maximum."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.operators.kernels import matrix


class Quantizer(ABC):
    """Extension point: train on rows, then encode and decode a vector column."""

    @abstractmethod
    def train(self, rows: DataFrame) -> Quantizer: ...

    @abstractmethod
    def encode(self, rows: DataFrame) -> DataFrame: ...

    @abstractmethod
    def decode(self, rows: DataFrame) -> DataFrame: ...

    @abstractmethod
    def code_size(self, dim: int) -> int: ...


def _map(rows: DataFrame, column: str, out: str, kind: str, f) -> DataFrame:
    at = rows.columns.index(column)

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, f(b.column(at))], names=[*b.schema.names, out])

    schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in rows.schema)
    return rows.mapInArrow(work, f"{schema}, `{out}` {kind}")


class Fp16Linear(Quantizer):
    """(x - zero) * scale in IEEE half precision, rounded to nearest even. Nothing is trained."""

    def __init__(self, scale: float = 1.0, zero: float = 0.0):
        self.scale, self.zero = scale, zero

    def train(self, rows: DataFrame) -> Fp16Linear:
        return self

    def encode(self, rows: DataFrame) -> DataFrame:
        """Adds codes: little-endian halves as binary."""

        def f(column):
            return pa.array([r.tobytes() for r in ((matrix(column) - self.zero) * self.scale).astype("<f2")], pa.binary())

        return _map(rows, "vec", "codes", "binary", f)

    def decode(self, rows: DataFrame) -> DataFrame:
        def f(column):
            return pa.array([(np.frombuffer(x, "<f2").astype(np.float32) / np.float32(self.scale) + np.asarray(self.zero, np.float32)).tolist() for x in column.to_pylist()], pa.list_(pa.float32()))

        return _map(rows, "codes", "decoded", "array<float>", f)

    def code_size(self, dim: int) -> int:
        return 2 * dim


class Fp16Centred(Fp16Linear):
    """Half precision of what is left after the mean of all rows; means are summed per position, in one pass."""

    def __init__(self, mean: np.ndarray | None = None):
        super().__init__(1.0, 0.0)
        self.zero = mean

    def train(self, rows: DataFrame) -> Fp16Centred:
        means = rows.select(F.posexplode("vec").alias("p", "x")).groupBy("p").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x")).orderBy("p")
        return Fp16Centred(np.array([r.x for r in means.collect()], np.float32))  # one number for each position


def bf16_bits(x: np.ndarray) -> np.ndarray:
    """The upper half of a float32, rounded to nearest even; not-a-number stays one."""
    bits = x.astype("<f4").view("<u4")
    out = ((bits.astype(np.uint64) + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype("<u2")
    return np.where(np.isnan(x), np.uint16(0x7FC0), out).astype("<u2")


class Bf16(Quantizer):
    """Brain floats: the range of float32 in two bytes. Nothing is trained."""

    def train(self, rows: DataFrame) -> Bf16:
        return self

    def encode(self, rows: DataFrame) -> DataFrame:
        return _map(rows, "vec", "codes", "binary", lambda c: pa.array([r.tobytes() for r in bf16_bits(matrix(c))], pa.binary()))

    def decode(self, rows: DataFrame) -> DataFrame:
        def f(column):
            return pa.array([(np.frombuffer(x, "<u2").astype("<u4") << 16).view("<f4").tolist() for x in column.to_pylist()], pa.list_(pa.float32()))

        return _map(rows, "codes", "decoded", "array<float>", f)

    def code_size(self, dim: int) -> int:
        return 2 * dim


def min_max(rows: DataFrame, column: str = "vec") -> tuple[float, float]:
    """Least and greatest element: one pass, partial on every task."""
    r = rows.agg(F.min(F.array_min(column)).alias("lo"), F.max(F.array_max(column)).alias("hi")).first()
    return float(r.lo), float(r.hi)


def minmax_u8(v: Column, lo: float, hi: float) -> Column:
    """Scaled to 0..255, held there, and cut down to an integer."""
    scale = 255.0 / (hi - lo) if hi > lo else 1.0
    return F.transform(v, lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x.cast("double") - F.lit(lo)) * F.lit(scale)))).cast("smallint"))


class MinMaxU8(Quantizer):
    def __init__(self, lo: float = 0.0, hi: float = 255.0):
        self.lo, self.hi = lo, hi

    def train(self, rows: DataFrame) -> MinMaxU8:
        return MinMaxU8(*min_max(rows))

    def encode(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("codes", minmax_u8(F.col("vec"), self.lo, self.hi))

    def decode(self, rows: DataFrame) -> DataFrame:
        step = (self.hi - self.lo) / 255.0
        return rows.withColumn("decoded", F.transform("codes", lambda x: x * F.lit(step) + F.lit(self.lo)))

    def code_size(self, dim: int) -> int:
        return dim
