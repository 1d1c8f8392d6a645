"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into m segments of almost equal width, each about as wide as the number of codes has bits. Codes that differ in at
most m * s + j bits differ in at most s bits of one of the first j + 1 segments or in at most s - 1 bits of another one.
So a query looks up, segment by segment, all values at distance s from its own, compares the whole codes found there, and
is done as soon as its kth distance is covered. The radius s grows until every query is done: the result is exact. Where
the next radius would look up more values and codes than there are codes, the queries still open are compared with all of them.

Codes are dealt to chunks of at most CHUNK rows by a hash, queries to at most as many blocks as BLOCK and BLOCKS say. A task holds
the index of a chunk and searches it for a block, so that look-ups are array accesses and no row is made for a value or
a candidate; only each query's k nearest of each chunk leave it, and are merged. Codes of different lengths are searched apart.
Equal codes of a chunk keep their k + 1 smallest ids; others can never be among k nearest rows when ties go to the smaller id.

Defined cases: null or empty embeddings have no code and neither ask nor are found; rows of another
length than the query's are not compared with it; the query row itself is not its neighbour, rows with equal codes are, at distance 0;
rows that share an id count once, at their least distance; of queries that share an id the one with the shortest,
then smallest code asks; ties go to the smaller id; with fewer than k other rows all are returned, with none
no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Codes of 64 bits that a task holds; fewer if they are longer.
CHUNK = 1 << 20
#: Queries that a task holds, and blocks that fewer queries are dealt to, of 64 at least: each block reads all codes.
BLOCK, BLOCKS = 1 << 15, 16
#: Widest segment, whose values are the places of a table.
WIDTH = 16
#: Values that are looked up, and candidates that are compared, at a time.
STEP = 1 << 17


def sign_code(embedding: Column, segment_bits: int) -> Column:
    """array<int>: bit i is set where the embedding's value i is positive."""
    bits = F.transform(embedding, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1), i % segment_bits)).otherwise(0))
    starts = F.sequence(F.lit(1), F.size(embedding), F.lit(segment_bits))
    return F.transform(starts, lambda s: F.aggregate(F.slice(bits, s, F.lit(segment_bits)), F.lit(0), lambda a, b: a + b))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.list_value_length(batch.column(1)).to_numpy()
        on = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False)
        starts, codes = np.cumsum(sizes) - sizes, [b""] * len(sizes)
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            for i, row in zip(at, np.packbits(on[starts[at][:, None] + np.arange(n)], axis=1), strict=True):
                codes[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(codes, pa.binary())], names=["id", "bits", "code"])


def packed(rows: DataFrame) -> DataFrame:
    """(id, bits, code binary): the signs of embeddings of any length."""
    on = F.transform("embedding", lambda x: F.coalesce(x > 0, F.lit(False)))
    return rows.select(F.col("id").cast("long").alias("id"), on.alias("on")).mapInArrow(_pack, "id long, bits int, code binary")


class _Nearest:
    """Each query's k nearest so far; bound is its kth distance, or more than any while there are fewer."""

    def __init__(self, k: int, bits: int, ids: np.ndarray, asked: np.ndarray):
        self.k, self.ids, self.asked = k, ids, asked
        self.bound = np.full(len(asked), bits + 1)
        self.q, self.i, self.d = (np.zeros(0, np.int64) for _ in range(3))
        self.more, self.size = [], 0

    def add(self, q: np.ndarray, c: np.ndarray, d: np.ndarray) -> None:
        i = self.ids[c]
        keep = (d <= self.bound[q]) & (i != self.asked[q])
        self.more.append((q[keep], i[keep], d[keep]))
        self.size += len(self.more[-1][0])
        if self.size > max(2 * STEP, 4 * len(self.q)):
            self.merge()

    def merge(self) -> None:
        if not self.size:
            return
        q, i, d = (np.concatenate(x) for x in zip((self.q, self.i, self.d), *self.more, strict=True))
        order = np.lexsort((d, i, q))
        q, i, d = q[order], i[order], d[order]
        first = np.r_[True, (q[1:] != q[:-1]) | (i[1:] != i[:-1])]  # an id counts once
        q, i, d = q[first], i[first], d[first]
        order = np.lexsort((i, d, q))
        q, i, d = q[order], i[order], d[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        self.q, self.i, self.d = q[rank < self.k], i[rank < self.k], d[rank < self.k]
        self.bound[q[rank == self.k - 1]] = d[rank == self.k - 1]
        self.more, self.size = [], 0


def _words(raw: np.ndarray) -> np.ndarray:
    """Codes as whole 64-bit words, filled up with zeros."""
    out = np.zeros((len(raw), -(-raw.shape[1] // 8) * 8), np.uint8)
    out[:, : raw.shape[1]] = raw
    return out.view(np.uint64)


def _segment(raw: np.ndarray, low: int, width: int) -> np.ndarray:
    """The values of the bits from low on."""
    bits = np.zeros((len(raw), WIDTH), np.uint8)
    bits[:, WIDTH - width :] = np.unpackbits(raw[:, low // 8 : -(-(low + width) // 8)], axis=1)[:, low % 8 : low % 8 + width]
    return np.packbits(bits, axis=1).astype(np.int64) @ np.array([256, 1])


def _compare_all(near: _Nearest, open_: np.ndarray, words: np.ndarray, asked: np.ndarray, bits: int) -> None:
    repeats = len(near.ids) - len(np.unique(near.ids))
    for at in range(0, len(open_), some := max(1, 8 * STEP // len(words))):
        q = open_[at : at + some]
        d = np.zeros((len(q), len(words)), np.int64)
        for w in range(words.shape[1]):
            d += np.bitwise_count(asked[q, w][:, None] ^ words[None, :, w])
        for x in np.flatnonzero(near.bound[q] > bits):  # k rows of different ids besides the query's are not farther
            reached = np.bincount(d[x], minlength=bits + 1).cumsum() > near.k + repeats
            near.bound[q[x]] = np.argmax(reached) if reached[-1] else bits
        x, c = np.nonzero(d <= near.bound[q][:, None])
        near.add(q[x], c, d[x, c])
    near.merge()


def search(k: int, bits: int, ids: np.ndarray, raw: np.ndarray, asked_ids: np.ndarray, asked_raw: np.ndarray) -> _Nearest:
    """The k nearest of a chunk (ids, codes as bytes) for each query of a block."""
    words, asked = _words(raw), _words(asked_raw)
    order = np.lexsort((ids, *words.T))
    words, ids, raw = words[order], ids[order], raw[order]
    starts = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]).any(axis=1)])
    copy = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
    words, ids, raw = words[copy <= k], ids[copy <= k], raw[copy <= k]
    n, near = len(ids), _Nearest(k, bits, ids, asked_ids)
    m = max(-(-bits // WIDTH), round(bits / max(4, math.log2(n))))
    ends = [bits * j // m for j in range(m + 1)]
    segments = []
    for low, high in zip(ends, ends[1:], strict=False):
        values = _segment(raw, low, high - low).astype(np.uint16)
        at = np.r_[0, np.bincount(values, minlength=1 << (high - low)).cumsum()]
        segments.append((high - low, np.argsort(values, kind="stable"), at, _segment(asked_raw, low, high - low)))
    open_ = np.arange(len(asked_ids))
    for s in range(max(w for w, *_ in segments) + 1):
        if s and sum(math.comb(w, s) * (1 + n / (1 << w)) for w, *_ in segments) > n:
            _compare_all(near, open_, words, asked, bits)
            break
        for j, (w, rows, at, own) in enumerate(segments):
            flips = np.array([sum(1 << b for b in c) for c in combinations(range(w), s)], np.int64)
            for f in range(0, len(flips), some := max(1, STEP // len(open_))):
                part = flips[f : f + some]
                values = (own[open_][:, None] ^ part[None, :]).ravel()
                q, low = np.repeat(open_, len(part)), at[values]
                sizes = at[values + 1] - low
                upto = sizes.cumsum()
                cuts = np.unique(np.searchsorted(upto, np.arange(STEP, upto[-1], STEP), side="right"))
                for a, b in zip([0, *cuts], [*cuts, len(q)], strict=True):
                    size = sizes[a:b]
                    place = np.arange(size.sum()) + np.repeat(low[a:b] - (size.cumsum() - size), size)
                    c, x = rows[place], np.repeat(q[a:b], size)
                    near.add(x, c, np.bitwise_count(words[c] ^ asked[x]).sum(axis=1, dtype=np.int64))
            near.merge()
            open_ = open_[near.bound[open_] > m * s + j]
            if not len(open_):
                return near
    return near


def _bytes(codes: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """rows and queries: (id long, embedding array<double>). Returns query_id, id, distance, rank."""
    known = lambda df: df.where("id IS NOT NULL AND size(embedding) > 0")
    segment_bits = min(max(4, math.ceil(math.log2(max(2, known(rows).count())))), 24)
    codes = materialize(packed(known(rows)).distinct())
    # Of codes of one id the smallest is that of the smallest values of so many bits each.
    least = F.min(F.struct(F.size("embedding").alias("bits"), sign_code(F.col("embedding"), segment_bits).alias("code"), "embedding")).alias("q")
    asked = materialize(packed(known(queries).groupBy("id").agg(least).select("id", "q.embedding")))
    sizes = codes.groupBy("bits").agg(F.count("*").alias("n")).join(asked.groupBy("bits").agg(F.count("*").alias("asked")), "bits")
    most = F.greatest(F.lit(1), F.least(F.lit(CHUNK), F.floor(F.lit(64 * CHUNK) / F.col("bits"))))
    blocks = F.greatest(F.ceil(F.col("asked") / BLOCK), F.least(F.lit(BLOCKS), F.ceil(F.col("asked") / 64)))
    sizes = materialize(sizes.select("bits", F.ceil(F.col("n") / most).alias("chunks"), blocks.alias("blocks")))  # one row a length
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = codes.join(sizes, "bits").withColumn("chunk", F.pmod(F.xxhash64("id", "code"), "chunks")).withColumn("block", every("blocks"))
    posed = asked.join(sizes, "bits").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("chunk", every("chunks"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = (t.column("id").to_numpy() for t in (left, right))
        q, i, d = (np.zeros(0, np.int64),) * 3
        if len(ids) and len(own):
            near = search(k, left.column("bits")[0].as_py(), ids, _bytes(left.column("code")), own, _bytes(right.column("code")))
            q, i, d = own[near.q], near.i, near.d
        return pa.table({"query_id": q, "id": i, "distance": d})

    keys = ("bits", "chunk", "block")
    left, right = (df.select(*keys, "id", "code").groupBy(*keys) for df in (dealt, posed))
    near = left.cogroup(right).applyInArrow(run, "query_id long, id long, distance long")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    near = near.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "distance", "rank")
