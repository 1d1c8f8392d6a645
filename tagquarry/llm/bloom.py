"""Bloom filters of hash tables that are already counted: built in the JVM, of a bounded size, tested in tasks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^27 bits: 16 MiB, the most that is ever broadcast.
MAX_FILTER_BITS = 1 << 27
WORD = 32768


def positions(h: Column, bits: int, k: int) -> Column:
    """k bit positions of a 64-bit hash."""
    return F.array(*(F.pmod(F.xxhash64(h, F.lit(i)), F.lit(bits)) for i in range(k)))


def bloom_filter(hashes: DataFrame, bits: int, k: int = 2) -> np.ndarray:
    """The Bloom filter of a table's hashes (h), as bytes: at most bits / 8 of them come to the driver."""
    set_ = hashes.select(F.explode(positions(F.col("h"), bits, k)).alias("p"))
    words = set_.groupBy(F.floor(F.col("p") / WORD).alias("w")).agg(F.bitmap_construct_agg(F.col("p") % WORD).alias("bitmap"))
    out = np.zeros(max(1, bits // 8), np.uint8)
    for w, bitmap in words.collect():
        start = w * WORD // 8
        out[start : start + WORD // 8] = np.frombuffer(bitmap, np.uint8)[: len(out) - start]
    return out


def filter_bits(n: int, most: int, k: int = 2) -> int:
    """The bits of a filter of n hashes: 16 per hash and position, within the bound."""
    return min(most, 1 << max(15, math.ceil(math.log2(max(1, n) * 16 * k))))


def possibly_repeated(spark, bitmap: np.ndarray, k: int = 2):
    """A column function: all k positions of the hash are set."""
    shared = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def test(ps: pd.Series) -> pd.Series:
        p = np.concatenate(ps.to_numpy()).reshape(len(ps), k) if len(ps) else np.zeros((0, k), np.int64)
        return pd.Series((shared.value[p >> 3] >> (p & 7).astype(np.uint8) & 1).all(axis=1))

    return test
