"""Phrase collocation mining: the phrases of two and three words whose parts belong together, best first.

Phrases grow from their prefixes, level by level: frequent words, then pairs of frequent words, then triples. The counts of
a prefix bound what can grow from it. For a triple that starts with the pair q = (v, w), a <= f(q), and its
cut after one word has l = f(v) and r >= a; hence score <= a * a / (l * r) <= f(q) / f(v), floored like the score. The frontier of pairs is
expanded in the order of that bound, in batches, until no open pair's bound reaches the score of the language's
last wanted phrase; equal bounds are still expanded, so that ties are settled. A pair's own score is at most its bound, too,
so that every pair in the running has been expanded; the same scan counts the triples that end with a pair of
the batch, with which it is known whether a longer phrase absorbs the pair.

A scan counts the phrases of one level inside each task, in tables of bounded size, and exchanges the partial counts.
It takes only phrases that the sketch of the frontier lets through (`cells`, 16 MiB at most); what passes by
accident is dropped by an exact join. Counts are exact, and scores are 38-digit decimals.

Defined cases: a null text is empty, a null lang is `und`; a null doc_id counts like any other; repeated rows count again; a text
without words adds nothing; no phrases, no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, islice
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cells
from .common import bound_batches, materialize

MILLION = 1_000_000
#: Pairs of a language that the first batch of the frontier expands; each later batch is eight times as large.
FIRST_BATCH = 20_000
#: Distinct words and phrases of a task's tables after which they are emitted and started anew.
MAX_WORDS, MAX_PHRASES = 400_000, 500_000
#: Words that are looked at together. With MAX_WORDS it keeps the numbers of words below 2^ID_BITS.
STEP, ID_BITS = 250_000, 21
#: A separator of pieces as a word of its own; no word holds one.
BREAK = b"."
_FOLD = bytearray(range(256))
_FOLD[65:91] = range(97, 123)
for _b in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_b] = BREAK[0]
FOLD = bytes(_FOLD)


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text in order, A-Z in lower case, and a BREAK for each separator of pieces."""
    return text.translate(FOLD).replace(BREAK, b" . ").split()


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its first words and its last one."""
    x = a * np.uint64(0xD6E8FEB86659FD93) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hash(lang: str, word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8, key=lang.encode()[:64]).digest(), "little")


class Test(NamedTuple):
    """Which phrases a scan counts, by hashes: words of pairs, and pairs of triples; None takes all."""

    word: Callable | None = None
    pair: Callable | None = None  # (hashes) -> (may be frequent, is in the batch)


class Counts:
    """Numbers the words of one language and counts its phrases of one length in a task."""

    def __init__(self, lang: str, length: int):
        self.lang, self.length = lang, length
        self.ids: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ids[BREAK]
        # By a word's number: its hash, where one is asked for, and whether phrases may hold it.
        self.hashes, self.taken = np.zeros(1, np.uint64), np.zeros(1, bool)
        self.keys, self.n, self.pending, self.waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, tokens: list[bytes], test: Test) -> None:
        ids = np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))
        if fresh := len(self.ids) - len(self.taken):
            taken = np.ones(fresh, bool)
            if test.word or test.pair:
                new = islice(self.ids, len(self.taken), None)
                hashes = np.fromiter((word_hash(self.lang, w) for w in new), np.uint64, fresh)
                self.hashes = np.concatenate([self.hashes, hashes])
                taken = test.word(hashes) if test.word else taken
            self.taken = np.concatenate([self.taken, taken])
        k, ok = self.length, self.taken[ids]
        if k > 1:
            ok = ok[:-1] & ok[1:]
        if k > 2:
            at = np.flatnonzero(ok)
            own = np.zeros_like(ok)
            ok[at], own[at] = test.pair(mixed(self.hashes[ids[at]], self.hashes[ids[at + 1]]))
            ok = ok[:-1] & ok[1:] & (own[:-1] | own[1:])
        at = np.flatnonzero(ok)
        key = ids[at]
        for i in range(1, k):
            key = key << ID_BITS | ids[at + i]
        self.pending.append(key)
        self.waiting += len(key)

    def settle(self) -> None:
        new, n = np.unique(np.concatenate([np.zeros(0, np.int64), *self.pending]), return_counts=True)
        self.pending, self.waiting = [], 0
        self.keys, at = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        self.n = np.bincount(at, np.concatenate([self.n, n]), len(self.keys)).astype(np.int64)

    def emit(self) -> Iterator[pa.RecordBatch]:
        """(lang, w0 … , n)."""
        self.settle()
        known = pa.array(list(self.ids), pa.binary()).cast(pa.string())
        for start in range(0, len(self.n), 50_000):
            key, n = self.keys[start : start + 50_000], self.n[start : start + 50_000]
            shifts = [ID_BITS * (self.length - 1 - i) for i in range(self.length)]
            held = [known.take(pa.array(key >> x & (1 << ID_BITS) - 1)) for x in shifts]
            yield pa.RecordBatch.from_arrays([pa.repeat(self.lang, len(n)), *held, pa.array(n)], names=["lang", *_names(self.length), "n"])


def _names(length: int) -> list[str]:
    return [f"w{i}" for i in range(length)]


def count_phrases(texts: DataFrame, length: int, make_test: Callable[[], Test] = Test) -> DataFrame:
    """(lang, w0 … , n) of texts (lang, text): occurrences of phrases of one length, of those that pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, Counts] = {}
        test = make_test()
        for batch in batches:
            by: defaultdict[str, list[bytes]] = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                by[lang].append(text)
            for lang, own in by.items():
                found = words(BREAK.join(own))
                for start in range(0, len(found), STEP):
                    tables.setdefault(lang, Counts(lang, length)).add(found[start : start + STEP + length - 1], test)
                    # All languages together stay within the bounds.
                    if sum(c.waiting for c in tables.values()) > 2 * MAX_PHRASES:
                        for c in tables.values():
                            c.settle()
                    if sum(len(c.ids) for c in tables.values()) > MAX_WORDS or sum(len(c.n) for c in tables.values()) > MAX_PHRASES:
                        for c in tables.values():
                            yield from c.emit()
                        tables.clear()
        for c in tables.values():
            yield from c.emit()

    names = _names(length)
    parts = texts.mapInArrow(scan, f"lang string, {', '.join(f'{w} string' for w in names)}, n long")
    return parts.groupBy("lang", *names).agg(F.sum("n").alias("n"))


def phrase_hashes(batch: pd.DataFrame, length: int) -> np.ndarray:
    """The hashes of phrases (lang, w0 …), equal to what a scan sees."""
    h = None
    for w in _names(length):
        own = np.array([word_hash(x, v.encode()) for x, v in zip(batch["lang"], batch[w], strict=True)], np.uint64)
        h = own if h is None else mixed(h, own)
    return h.view(np.int64)


def _shared_filter(phrases: DataFrame, length: int, max_cells: int):
    """A broadcast filter that passes every phrase of the table: one bit per cell, of a bounded number of cells."""
    # Hashed where the sketch is filled, so that a task needs one Python worker only.
    size = cells.sketch_cells(phrases.count(), max_cells)
    sketch = cells.build(phrases.select("lang", *_names(length)), size, hashed=lambda batch: phrase_hashes(batch, length))
    return phrases.sparkSession.sparkContext.broadcast(sketch.seen)


def _within(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    return cells.all_set(bitmap, h.view(np.int64), 2)


def scores(phrases: DataFrame, cuts: int) -> DataFrame:
    """phrases with l, r, score of the lowest-scoring cut, the smallest of equal ones; cut k is in columns l{k}, r{k}."""
    each = []
    for k in range(1, cuts + 1):
        a, l, r = (F.col(c).cast("decimal(18,0)") for c in ("a", f"l{k}", f"r{k}"))  # noqa: E741
        score = F.call_function("div", (a * a * F.lit(MILLION).cast("decimal(7,0)")).cast("decimal(38,0)"), (l * r).cast("decimal(38,0)"))
        each.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    best = F.array_min(F.array(*each)) if cuts > 1 else each[0]
    drop = [f"{c}{k}" for k in range(1, cuts + 1) for c in "lr"]
    return phrases.withColumn("_best", best).select("*", "_best.l", "_best.r", "_best.score").drop("_best", *drop)


def frequent_pairs(texts: DataFrame, frequent: DataFrame, least: int, max_cells: int) -> DataFrame:
    """(lang, w0, w1, a, l, r, score, bound): pairs of frequent words that occur `least` times."""
    known = _shared_filter(frequent, 1, max_cells)
    pairs = count_phrases(texts, 2, lambda: Test(word=lambda h: _within(known.value, h))).where(F.col("n") >= least).withColumnRenamed("n", "a")
    left = frequent.select("lang", F.col("w0"), F.col("n").alias("l1"))
    right = frequent.select("lang", F.col("w0").alias("w1"), F.col("n").alias("r1"))
    scored = scores(pairs.join(left, ["lang", "w0"]).join(right, ["lang", "w1"]), 1)
    bound = F.floor(F.lit(MILLION).cast("decimal(20,0)") * F.col("a") / F.col("l")).cast("long")
    return scored.select("lang", "w0", "w1", "a", "l", "r", "score", bound.alias("bound"))


def triples_of(texts: DataFrame, batch: DataFrame, pairs: DataFrame, least: int, max_cells: int) -> DataFrame:
    """(lang, w0, w1, w2, a): triples that occur `least` times and begin or end with a pair of the batch."""
    own, every = _shared_filter(batch, 2, max_cells), _shared_filter(pairs, 2, max_cells)

    def pair(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Both pairs of a triple are frequent, as the triple can only then be; one of them is in the batch.
        frequent = _within(every.value, h)
        wanted = np.zeros_like(frequent)
        wanted[frequent] = _within(own.value, h[frequent])
        return frequent, wanted

    return count_phrases(texts, 3, lambda: Test(pair=pair)).where(F.col("n") >= least).withColumnRenamed("n", "a")


def _order() -> list[Column]:
    return [F.desc("score"), F.desc("a"), F.encode("phrase", "UTF-8")]


def collocations(
    documents: DataFrame, top: int = 2000, least: int = 10, absorb: int = 50, first_batch: int = FIRST_BATCH, max_cells: int = cells.MAX_CELLS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language, by score, a, phrase.

    A pair is dropped if a triple around it occurs at least `absorb` percent as often.
    """
    bound_batches(documents.sparkSession)
    texts = documents.where("text IS NOT NULL").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    vocabulary = materialize(count_phrases(texts, 1))
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = materialize(vocabulary.where(F.col("n") >= least))
    pairs = materialize(frequent_pairs(texts, frequent, least, max_cells))
    by_first = Window.partitionBy("lang").orderBy(F.desc("bound"), "w0", "w1")
    open_, triples, settled, size = pairs, None, None, first_batch
    while not open_.isEmpty():
        # Row numbers up to a limit: Spark keeps that many rows of each task's part before it shuffles.
        ranked = open_.withColumn("_r", F.row_number().over(by_first)).where(F.col("_r") <= size)
        batch = materialize(ranked.drop("_r"))
        found = materialize(triples_of(texts, batch, pairs, least, max_cells))
        keys = batch.select("lang", "w0", "w1")
        grown = found.join(keys, ["lang", "w0", "w1"])
        around = found.select("lang", "w0", "w1", "a").unionByName(found.select("lang", F.col("w1").alias("w0"), F.col("w2").alias("w1"), "a"))
        around = around.groupBy("lang", "w0", "w1").agg(F.max("a").alias("longer"))
        kept = batch.join(around, ["lang", "w0", "w1"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorb * F.col("a")))
        singles = frequent.select("lang", "w0", "n")
        doubles = pairs.select("lang", "w0", "w1", F.col("a").alias("n"))
        cut = (
            grown.join(singles.withColumnRenamed("n", "l1"), ["lang", "w0"])
            .join(doubles.toDF("lang", "w1", "w2", "r1"), ["lang", "w1", "w2"])
            .join(doubles.withColumnRenamed("n", "l2"), ["lang", "w0", "w1"])
            .join(singles.toDF("lang", "w2", "r2"), ["lang", "w2"])
        )
        grown = scores(cut, 2).select("lang", F.concat_ws(" ", "w0", "w1", "w2").alias("phrase"), "a", "l", "r", "score")
        kept = kept.select("lang", F.concat_ws(" ", "w0", "w1").alias("phrase"), "a", "l", "r", "score")
        settled = grown.unionByName(kept) if settled is None else settled.unionByName(grown).unionByName(kept)
        # What is beyond the first `top` now stays beyond it.
        best = Window.partitionBy("lang").orderBy(*_order())
        settled = materialize(settled.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).drop("rank"))
        last = settled.groupBy("lang").agg(F.when(F.count("*") >= top, F.min("score")).otherwise(-1).alias("last"))
        rest = open_.join(keys, ["lang", "w0", "w1"], "left_anti").join(last, "lang", "left")
        open_ = materialize(rest.where(F.col("last").isNull() | (F.col("bound") >= F.col("last"))).drop("last"))
        size *= 8
    if settled is None:
        empty = pairs.select("lang", F.col("w0").alias("phrase"), "a", "l", "r", "score")
        settled = empty.limit(0)
    out = settled.join(totals, "lang").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*_order())).cast("long"))
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
