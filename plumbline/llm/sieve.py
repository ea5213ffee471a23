"""A sieve of fixed size: which 64-bit keys may be in a table. It never misses one, never grows, and what it lets through wrongly is sorted out by what comes after."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a sieve, 8 MB as broadcast.
SIEVE = 1 << 26


def sieve(keys: DataFrame, key: str) -> np.ndarray:
    """Words of 64 bits: the bits that the low bits of the keys name are set. At most SIEVE / 64 rows reach the driver."""
    bit = F.col(key).bitwiseAND(F.lit(SIEVE - 1))
    words = keys.groupBy(F.shiftright(bit, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{key}` & 63L as int))")).alias("bits")).toArrow()
    got = np.zeros(SIEVE // 64, np.int64)
    got[words["word"].to_numpy()] = words["bits"].to_numpy()
    return got.view(np.uint64)


def passes(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys.astype(np.uint64) & np.uint64(SIEVE - 1)
    return (held[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
