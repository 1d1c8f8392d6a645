"""Mixing sources to target weights by cube-method balanced sampling.

Each source's target fixes how often its documents are taken on average: the whole part for all,
the fraction as an inclusion probability. The cube method's flight moves the probabilities of three
documents at a time along the null space of the constraints (number of documents, words) until one
of them is 0 or 1. Flights run in chunks of about CHUNK documents of a source, so that no source is
one task; each leaves at most two documents open. They land on the rounding that misses the chunk's
words least, and a few exchanges of a taken document with one left out take up the rest.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a
document of size 0 is taken like any other but adds no words; rows that share a doc_id are drawn
apart; equal rows are interchangeable; an empty table gives an empty result; runs repeat exactly,
since order and random numbers come from doc_id, size and source alone. Other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagquarry.functions.tables import global_index, running_total

from .common import bound_batches, materialize

WEIGHTS = (5.0, 2.0, 1.0)
#: No document is taken more often than this, on average.
MOST = 3.0
CHUNK = 4_000
#: Sources up to this number are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, n, source_size, target, place) from rows (source, size).

    The targets share the total by weight; one above most * source_size stops there and the excess
    goes to the others by weight. Sorted by most * size / weight, a source is capped if that is at
    most the level which the rest would get. place counts from 0 by code point, null last. Places and sums over
    sources come from range partitions, so that no task holds them all.
    """
    stats = sized.groupBy("source").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    stats = global_index(stats.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "place")
    w = F.array(*(F.lit(float(x)) for x in weights))
    stats = stats.withColumn("w", F.get(w, (F.col("place") % len(weights)).cast("int"))).withColumn("cap", most * F.col("source_size"))
    stats = materialize(stats.withColumn("q", F.col("cap") / F.col("w")))
    for amount in ("cap", "w"):
        stats = running_total(stats, ["q", "_null", "source"], amount, f"_{amount}").withColumn(f"_{amount}", F.col(f"_{amount}") - F.col(amount))
    whole = stats.agg(F.sum("source_size").alias("_all"), F.sum("w").alias("_all_w"))
    stats = stats.crossJoin(F.broadcast(whole))  # one row
    stats = materialize(stats.withColumn("capped", F.col("q") <= (F.col("_all") - F.col("_cap")) / (F.col("_all_w") - F.col("_w"))))
    kept = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0.0))
    share = stats.agg(((F.sum("source_size") - kept) / F.sum(F.when(~F.col("capped"), F.col("w")))).alias("_share"))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("_share") * F.col("w"))
    return stats.crossJoin(F.broadcast(share)).select("source", "n", "source_size", target.alias("target"), "place")  # one row


def flight(p: np.ndarray, size: np.ndarray, random: np.random.RandomState) -> np.ndarray:
    """Probabilities after the flight phase: at most two stay fractional. Keeps sum(p) and sum(p * size)."""
    p, live = p.astype(float).copy(), []
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        live.append(i)
        while len(live) >= 2:
            a, b = live[0], live[1]
            if len(live) == 2:
                if size[a] != size[b]:
                    break
                units, u = live[:2], (1.0, -1.0)
            else:
                c = live[2]
                units, u = live[:3], (float(size[b] - size[c]), float(size[c] - size[a]), float(size[a] - size[b]))
                if not any(u):
                    units, u = live[:2], (1.0, -1.0)
            up = min(((1 - p[j]) / x if x > 0 else -p[j] / x) for j, x in zip(units, u) if x)
            down = min((p[j] / x if x > 0 else (p[j] - 1) / x) for j, x in zip(units, u) if x)
            step = up if random.random_sample() * (up + down) < down else -down
            for j, x in zip(units, u):
                p[j] = min(1.0, max(0.0, p[j] + step * x))
                if p[j] < 1e-9 or p[j] > 1 - 1e-9:
                    p[j] = round(p[j])
            live = [j for j in live if 0 < p[j] < 1]
    return p


def landing(p: np.ndarray, size: np.ndarray, first: np.ndarray, exchanges: int = 4) -> np.ndarray:
    """Round the last fractional documents so that the words of the first probabilities are missed least.

    The choice among the few roundings comes first; then up to `exchanges` times a taken document
    changes places with one left out, if that brings the words nearer. The number of documents stays.
    """
    p = p.copy()
    goal = float((first * size).sum())
    rest = np.flatnonzero((p > 0) & (p < 1))
    if len(rest) > 2:
        raise ValueError("a flight leaves two documents at most")
    if len(rest):
        off = float((p * size).sum()) - float((p[rest] * size[rest]).sum()) - goal
        miss = lambda c: (abs(off + sum(x * float(size[j]) for x, j in zip(c, rest))), abs(sum(c) - p[rest].sum()), c)
        p[rest] = min(itertools.product((0.0, 1.0), repeat=len(rest)), key=miss)
    for _ in range(exchanges):
        off = float((p * size).sum()) - goal
        taken = np.flatnonzero((p == 1) & (first < 1))
        left = np.flatnonzero((p == 0) & (first > 0))
        if abs(off) < 1 or not len(taken) or not len(left):
            break
        left = left[np.argsort(size[left], kind="stable")]
        at = np.clip(np.searchsorted(size[left], size[taken] - off), 0, len(left) - 1)
        at = np.concatenate([at, np.maximum(at - 1, 0)])
        taken = np.concatenate([taken, taken])
        after = np.abs(off - (size[taken] - size[left[at]]))
        best = int(np.argmin(after))
        if after[best] >= abs(off):
            break
        p[taken[best]], p[left[at[best]]] = 0.0, 1.0
    return p


def _fly(key, rows: pd.DataFrame) -> pd.DataFrame:
    by = ["size", "doc_id", "tie"] if "tie" in rows else ["size", "doc_id"]
    rows = rows.sort_values(by, ascending=[False, True, True][: len(by)], kind="stable", na_position="last")
    seed = (int(key[0]) * 7919 + int(key[1]) * 104729) % (1 << 32)
    p, size = rows["p"].to_numpy(float), rows["size"].to_numpy(float)
    return rows.assign(p=landing(flight(p, size, np.random.RandomState(seed)), size, p))


def draw(units: DataFrame) -> DataFrame:
    """Rows (doc_id, size, sid, n, p) with p rounded to 0 or 1; each chunk of a source flies alone.

    Rows may have two columns more, row and tie, which stay; tie orders rows of one doc_id and size. Equal rows
    are numbered, and the number is part of what deals rows to chunks, so that many of them fill no chunk.
    """
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK)).cast("long")
    more = [c for c in ("row", "tie") if c in units.columns]
    own = ["doc_id", "size", *(["tie"] if "tie" in more else [])]
    units = global_index(units.withColumn("g", F.xxhash64("sid", *own)), ["g", *more[:1]], "i")
    first = units.groupBy("g").agg(F.min("i").alias("first"))
    units = units.join(first, "g").withColumn("bucket", F.pmod(F.xxhash64(*own, F.col("i") - F.col("first")), chunks))
    units = units.select("doc_id", "size", "sid", "bucket", "p", *more)
    return units.groupBy("sid", "bucket").applyInPandas(_fly, units.schema)


def mix_sources(documents: DataFrame, weights=WEIGHTS, most: float = MOST, key: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, times (how often it is taken), taken.

    key: a column of distinct values that is returned too, to tell apart rows that doc_id does not.
    """
    bound_batches(documents.sparkSession)
    more = [F.col(key).alias("row"), F.xxhash64("text").alias("tie")] if key else []
    sized = materialize(documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), *more))
    more = ["row", "tie"] if key else []
    targets = materialize(source_targets(sized, weights, most))
    named = targets.withColumn("sid", F.col("place") + 1).drop("place")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-12)
    named = named.withColumn("whole", whole).withColumn("p", F.greatest(F.lit(0.0), rate - whole))
    named = materialize(named.withColumn("p", F.when(F.col("p") < 1e-12, 0.0).otherwise(F.col("p"))))
    side = named.withColumn("_null", F.col("source").isNull()).withColumn("_key", F.coalesce("source", F.lit(""))).drop("source")
    if named.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    rows = sized.select("doc_id", "size", *more, F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_key"))
    drawn = draw(rows.join(side, ["_null", "_key"]).select("doc_id", "size", *more, "sid", "n", "p"))
    back = named.select("sid", "source_size", "target", "whole")
    if named.count() <= BROADCAST_SOURCES:
        back = F.broadcast(back)
    return drawn.join(back, "sid").select(
        *([F.col("row").alias(key)] if key else []),
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("whole") + F.col("p")).cast("long").alias("times"),
        (F.col("size") * (F.col("whole") + F.col("p"))).cast("long").alias("taken"),
    )
