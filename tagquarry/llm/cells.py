"""Count-min sketches whose counters stop at two: does a 64-bit hash occur more than once?

Row i of a sketch adds each hash to one of its own cells. A hash that occurs twice finds two or more in all its k
cells; one cell below two proves that it occurs once. Each task fills two bitmaps, "seen" and "seen twice";
only the chunks of the bitmaps that a task has touched are exchanged and merged, never a row or a hash.
The size is bounded by `most` bits, whatever the input: a sketch that fills up proves less, and nothing false.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2^27 cells: 16 MiB for each of the two bitmaps, the most that a task holds or that is broadcast.
MAX_CELLS = 1 << 27
#: Bytes of a bitmap that are exchanged together.
CHUNK = 1024


class Sketch(NamedTuple):
    seen: np.ndarray
    twice: np.ndarray
    rows: int


def sketch_cells(n: int, most: int = MAX_CELLS, rows: int = 2) -> int:
    """Cells of a sketch of n hashes: 8 to 16 for each hash and row, within the bound; a power of two."""
    return min(most, 1 << max(15, math.ceil(math.log2(max(1, n) * 8 * rows))))


def positions(h: np.ndarray, cells: int, rows: int) -> list[np.ndarray]:
    """The cell of each hash in each row of the sketch."""
    width, out = np.uint64(cells // rows), []
    for i in range(rows):
        x = h.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(((x ^ (x >> np.uint64(31))) % width + np.uint64(i) * width).astype(np.int64))
    return out


def is_set(bitmap: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (bitmap[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)


def all_set(bitmap: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """Whether all cells of each hash are set in the bitmap."""
    out = np.ones(len(h), bool)
    for p in positions(h, len(bitmap) * 8, rows):
        out &= is_set(bitmap, p)
    return out


def _set(bitmap: np.ndarray, p: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))


def build(table: DataFrame, cells: int, rows: int = 2, hashed=None) -> Sketch:
    """The sketch of a table's hashes: its column h (long, not null), or what `hashed` makes of its batches.

    The driver gets at most 2 * cells / 8 bytes.
    """
    unit = 8 * CHUNK * rows
    cells = max(unit, cells - cells % unit)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, twice = np.zeros(cells // 8, np.uint8), np.zeros(cells // 8, np.uint8)
        for batch in batches:
            h = hashed(batch) if hashed else batch["h"]
            for p in positions(np.asarray(h, np.int64), cells, rows):
                own, n = np.unique(p, return_counts=True)
                _set(twice, own[(n > 1) | is_set(seen, own)])
                _set(seen, own)
        chunks = np.flatnonzero(seen.reshape(-1, CHUNK).any(axis=1))
        for some in np.array_split(chunks, max(1, len(chunks) // 1000)):
            yield pd.DataFrame({"chunk": some, "seen": [seen[c * CHUNK : (c + 1) * CHUNK].tobytes() for c in some], "twice": [twice[c * CHUNK : (c + 1) * CHUNK].tobytes() for c in some]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A task holds the chunks that are dealt to it, however many tasks have filled them.
        whole: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for c, s, t in zip(batch["chunk"], batch["seen"], batch["twice"], strict=True):
                s, t = np.frombuffer(s, np.uint8), np.frombuffer(t, np.uint8)
                if c in whole:
                    seen, twice = whole[c]
                    whole[c] = [seen | s, twice | t | (seen & s)]
                else:
                    whole[c] = [s, t]
        yield pd.DataFrame({"chunk": list(whole), "seen": [s.tobytes() for s, _ in whole.values()], "twice": [t.tobytes() for _, t in whole.values()]})

    schema = "chunk long, seen binary, twice binary"
    parts = table.mapInPandas(fill, schema).repartition("chunk").mapInPandas(merge, schema)
    seen, twice = np.zeros(cells // 8, np.uint8), np.zeros(cells // 8, np.uint8)
    for c, s, t in parts.collect():
        seen[c * CHUNK : (c + 1) * CHUNK] = np.frombuffer(s, np.uint8)
        twice[c * CHUNK : (c + 1) * CHUNK] = np.frombuffer(t, np.uint8)
    return Sketch(seen, twice, rows)


def tester(spark: SparkSession, bitmap: np.ndarray, rows: int):
    """A column function: all cells of the hash (long) are set."""
    shared = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(all_set(shared.value, h.to_numpy(np.int64), rows))

    return test
