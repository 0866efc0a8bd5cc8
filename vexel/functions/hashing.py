"""64-bit hashes that wrap. ANSI mode refuses wrapping products of longs, so they run on Arrow batches of numpy uint64."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The splitmix64 mixer and the golden-ratio multiplier.
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
FIBONACCI = 11400714819323198485
FULL = (1 << 64) - 1


def splitmix64_array(x: np.ndarray) -> np.ndarray:
    z = x.astype(np.uint64) + np.uint64(GOLDEN)
    for shift, factor in ((30, MIX_1), (27, MIX_2)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def splitmix64_udf():
    """The hash as a signed number of 64 bits."""

    @F.pandas_udf("bigint")
    def hashed(x: pd.Series) -> pd.Series:
        return pd.Series(splitmix64_array(x.to_numpy(np.int64)).view(np.int64))

    return hashed


def splitmix64(ids: Column) -> Column:
    """The hash as an unsigned number."""
    h = splitmix64_udf()(ids)
    return (h.cast("decimal(20,0)") + F.expr("18446744073709551616BD") * (h < 0).cast("int")).cast("decimal(20,0)")


def is_deleted(id_: Column, ratio: float) -> Column:
    """Whether a hash of the id falls under `ratio` of its range; negative ids never do."""
    if ratio <= 0:
        return F.lit(False)
    if ratio >= 1:
        return id_ >= 0

    threshold = int(ratio * FULL)

    @F.pandas_udf("boolean")
    def under(ids: pd.Series) -> pd.Series:
        return pd.Series(splitmix64_array(ids.to_numpy(np.int64)) < np.uint64(threshold))

    return (id_ >= 0) & under(id_)


def hashed_list(local_id: Column, nlist: int) -> Column:
    """The list of an inserted row that has no source row: a Fibonacci hash."""

    @F.pandas_udf("int")
    def of(ids: pd.Series) -> pd.Series:
        return pd.Series((ids.to_numpy(np.int64).astype(np.uint64) * np.uint64(FIBONACCI) % np.uint64(nlist)).astype(np.int32))

    return of(local_id)


def synthetic_code(local_id: Column, m: int) -> Column:
    """A made-up PQ code for fixtures: the low byte of a hash of id and subspace."""

    @F.pandas_udf("smallint")
    def of(ids: pd.Series) -> pd.Series:
        salt = np.uint64(GOLDEN * (m + 1) & FULL)
        return pd.Series((splitmix64_array(ids.to_numpy(np.int64).astype(np.uint64) ^ salt) & np.uint64(255)).astype(np.int16))

    return of(local_id)


def digest_bits(digits: int, *parts: Column) -> Column:
    """4 * digits bits of an MD5 digest of the parts, joined by colons: the same number in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, digits), 16, 10).cast("long")
