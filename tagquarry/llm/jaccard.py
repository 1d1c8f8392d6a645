"""N-gram Jaccard join by parity sketches.

A document is the set of its hashed word shingles. Every shingle flips one bit of a wide virtual bit
sketch that is cut into segments; a segment's key is the hash of its odd bits. Linked sets of n <= m
shingles differ in at most (n + m) / 9 <= n / 4 of them, so a set disagrees with any partner in at
most d = n // 4 segments: by the pigeonhole principle one of its d + 1 fullest segments (ties by
number) agrees. Equal segments are equally full, so both sides rank them alike, and the segment is among
the first m // 4 + 1 of the partner as well. This is complete for sets of every size. Segments are laid
out per size band (bands grow by 1 / 0.8^2; a set that may link into the next band is keyed for that
one too). A second, dense parity sketch gives a Hamming distance, which never exceeds the symmetric
difference and rejects most candidates before the exact sets are compared.

Keys held by more than CROWD sets are never expanded into pairs. The sets that hold one go an exact way:

1. Their single shingles are grouped like keys. A set of which more than a fifth of the shingles are
   held by at most CROWD of them shares one of those with whatever it links with, so it is settled
   (documents that merely have a popular passage in common end here).
2. The others (large groups of near copies) are compared with hubs: once with a hub of their fullest key, then
   those that it does not link with several of those that it does. What is still apart meets under
   a join condition on the Hamming distance of longer sketches, so that hardly any pair but missing
   links leaves the join.

Only components are given, neither linked pairs nor numbers of links: the exact way skips pairs of sets
that are in one component already.

Equal sets are one node from the start, so that copies are never paired. A key that one batch of sets
holds many times is cut short there; the rest of its rows bypass the key's task.

Defined cases: a text without words, or null, has no shingles and links with nothing; a null doc_id
links with nothing and has a null component; rows that share a doc_id are one node (linked to one
another); repeated rows repeat in the result; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import MAX_FILTER_BITS, bloom_filter, filter_bits, positions, possibly_repeated
from .common import bound_batches, materialize
from .components import connected_components
from .shingles import U, batch_sets, mix

CROWD = 16
#: Hubs that a set is compared with if the first one of its key does not link it.
HUBS = 8
#: Bytes of sets, sketches and keys after which a record batch is handed on.
BATCH_BYTES = 2_000_000


def band_bounds(limit: int = 1 << 40) -> np.ndarray:
    """Smallest set size of each band."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, -(-out[-1] * 25 // 16)))
    return np.array(out)


BOUNDS = band_bounds()


def segment_keys(s: np.ndarray, band: int) -> np.ndarray:
    """The segment keys of a set in the layout of a band; their low byte is the band."""
    d = len(s) // 4
    if not d:
        return np.zeros(0, np.int64)  # only equal sets link
    most = (int(BOUNDS[band + 1]) - 1) // 4
    count = most + most // 5 + 2
    at = (mix(s ^ U(0xA5A5_0000 + band)) % U(count)).astype(np.int64)
    value = np.zeros(count, U)
    np.bitwise_xor.at(value, at, mix(s + U(0x51)))
    full = np.bincount(at, minlength=count)
    filled = np.flatnonzero(full)
    if len(filled) > d:
        segments = filled[np.argsort(-full[filled], kind="stable")[: d + 1]]
    else:
        segments = np.arange(count)  # so few that all agreeing segments may be empty ones
    keys = mix(value[segments] ^ mix(segments.astype(U) + U(band << 32)))
    return ((keys & ~U(0xFF)) | U(band)).view(np.int64)


def set_keys(s: np.ndarray) -> np.ndarray:
    """The keys of a set in all layouts in which it may meet a partner."""
    if not len(s):
        return np.zeros(0, np.int64)
    band = int(np.searchsorted(BOUNDS, len(s), "right")) - 1
    own = segment_keys(s, band)
    if 5 * len(s) < 4 * BOUNDS[band + 1]:
        return own
    return np.concatenate([own, segment_keys(s, band + 1)])


def parity_sketch(s: np.ndarray) -> bytes:
    """One bit flipped per shingle, in 2 to 4 bits per shingle."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    flips = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def folded_hamming(a: bytes, b: bytes) -> int:
    """Hamming distance of two parity sketches, the longer folded onto the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))


def _signatures(batches):
    def flush(rows):
        docs, sizes, keys, sketches, lists = zip(*rows)
        columns = [pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, _lists(lists)], names=["doc_id", "n", "set_key", "sketch", "keys"])

    for batch in batches:
        rows, held = [], 0
        for doc, s in zip(batch.column(0).to_pylist(), batch_sets(batch.column(1))):
            key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            rows.append((doc, len(s), key, parity_sketch(s) if len(s) else b"", set_keys(s)))
            held += 64 + len(rows[-1][3]) + rows[-1][4].nbytes
            if held > BATCH_BYTES:
                yield flush(rows)
                rows, held = [], 0
        if rows:
            yield flush(rows)


def signatures(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n (shingles), set_key (equal for equal sets), sketch, keys."""
    return documents.select("doc_id", "text").mapInArrow(
        _signatures, "doc_id long, n long, set_key binary, sketch binary, keys array<long>"
    )


def _dealt(key: np.ndarray, doc: np.ndarray):
    """Rows (key, doc, direct) without repeats; of a key only CROWD + 1 rows of a batch are not direct."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    rank = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(doc), pa.array(rank > CROWD)], names=["key", "doc_id", "direct"]
    )


def _key_rows(batches):
    for batch in batches:
        lists = batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        key = lists.flatten().to_numpy()
        if len(key):
            yield _dealt(key, np.repeat(batch.column(0).to_numpy(), sizes))


def _shingle_rows(batches):
    for batch in batches:
        sets = [np.frombuffer(s, np.int64) for s in batch.column(1).to_pylist()]
        if sets and sum(map(len, sets)):
            yield _dealt(np.concatenate(sets), np.repeat(batch.column(0).to_numpy(), [len(s) for s in sets]))


def runs(rows: DataFrame) -> DataFrame:
    """(a, b, key) of rows (key, doc_id, direct): the pairs of keys held by at most CROWD sets, with a
    null key, and a row (doc_id, null, key) for each holder of another key."""
    dealt = rows.repartition(F.when(F.col("direct"), F.xxhash64("doc_id", "key")).otherwise(F.col("key")))
    return dealt.sortWithinPartitions("direct", "key", "doc_id").mapInArrow(_runs, "a long, b long, key long")


def _runs(batches):
    """Streams (key, doc, direct) in order. Never holds more than one batch and CROWD rows."""
    key0, doc0, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def out(a, b, c):
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64(), from_pandas=False) if x is not None else pa.nulls(n, pa.int64()) for n in [len(a)] for x in (a, b, c)],
            names=["a", "b", "key"],
        )

    def emit(key, doc, crowded):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[starts, len(key)])
        size = np.repeat(length, length)
        many = (size > CROWD) | (key == crowded if crowded is not None else False)
        if many.any():
            yield out(doc[many], None, key[many])
        for t in range(1, min(CROWD, len(key) - 1) + 1):
            pair = (key[t:] == key[:-t]) & ~many[t:]
            if not pair.any():
                break
            yield out(doc[:-t][pair], doc[t:][pair], None)

    for batch in batches:
        direct = batch.column(2).to_numpy(zero_copy_only=False)
        key, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if direct.any():
            yield out(doc[direct], None, key[direct])
        key, doc = np.r_[key0, key[~direct]], np.r_[doc0, doc[~direct]]
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc = key[new], doc[new]
        last = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
        if len(key) - last > CROWD or key[-1] == crowded:
            yield from emit(key, doc, crowded)
            crowded, last = key[-1], len(key)
        elif last:
            yield from emit(key[:last], doc[:last], crowded)
        key0, doc0 = key[last:], doc[last:]
    if len(key0):
        yield from emit(key0, doc0, crowded)


def _hamming(batches):
    for b in batches:
        keep = [folded_hamming(x, y) * 9 <= n + m for x, y, n, m in zip(b["sketch_a"], b["sketch_b"], b["n_a"], b["n_b"])]
        yield b.loc[keep, ["a", "b"]]


def _same_enough(batches):
    for b in batches:
        keep = []
        for x, y in zip(b["set_a"], b["set_b"]):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= 80 * (len(x) + len(y) - common))
        yield b.loc[keep, ["a", "b"]]


def _sets(batches):
    kinds = [pa.int64(), pa.binary()]
    for batch in batches:
        rows, held = [], 0
        for doc, s in zip(batch.column(0).to_pylist(), batch_sets(batch.column(1))):
            rows.append((doc, s.tobytes()))
            held += len(rows[-1][1])
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "set"])
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "set"])


def sets_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, set) of the documents in ids (one distinct long column).

    A Bloom filter of the ids, of a fixed size limit, keeps most other texts out of the shuffle.
    """
    spark, k, ids = documents.sparkSession, 2, materialize(ids)
    bits = filter_bits(ids.count(), MAX_FILTER_BITS, k)
    bitmap = bloom_filter(ids.select(F.xxhash64("doc_id").alias("h")), bits, k)
    test = possibly_repeated(spark, bitmap, k)
    texts = documents.select("doc_id", "text").where("doc_id IS NOT NULL")
    texts = texts.where(test(positions(F.xxhash64("doc_id"), bits, k)))
    return materialize(texts.join(ids, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, set binary"))


def _with_both(pairs: DataFrame, of: DataFrame, cols: list[str]) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(of.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in cols)), side)
    return pairs


def near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs that the Hamming distance of their sketches does not rule out."""
    return materialize(_with_both(pairs, nodes, ["n", "sketch"]).mapInPandas(_hamming, "a long, b long").distinct())


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked pairs."""
    return materialize(_with_both(pairs, sets, ["set"]).mapInPandas(_same_enough, "a long, b long").distinct())


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


#: 64-bit words of the sketches that the last join compares.
WORDS = 32


def _wide(batches):
    """Parity sketches of one length for sets of any size, so that they can be compared by words."""
    bits = 64 * WORDS
    for b in batches:
        sets = [np.frombuffer(s, U) for s in b["set"]]
        flips = np.array([np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1 for s in sets], np.uint8)
        words = np.packbits(flips.reshape(-1, bits), axis=1, bitorder="little").view(np.int64)
        out = pd.DataFrame(words, columns=[f"w{i}" for i in range(WORDS)])
        out.insert(0, "n", [len(s) for s in sets])
        out.insert(0, "doc_id", b["doc_id"].to_numpy())
        yield out


def wide_sketches(sets: DataFrame) -> DataFrame:
    """(doc_id, n, w0, w1, …) of each set."""
    return sets.mapInPandas(_wide, "doc_id long, n long, " + ", ".join(f"w{i} long" for i in range(WORDS)))


def crowded_links(postings: DataFrame, nodes: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """links and those found through crowded keys alone, enough of them to connect components.

    postings: (doc_id, key, rare) of the sets that are not settled otherwise; rare is the share of their
    shingles that few others hold.
    """
    # One hub per key, the set most like the others; each set meets that of its fullest key.
    fullest = postings.groupBy("key").agg(F.count("*").alias("n"))
    chosen = postings.join(fullest, "key").groupBy("doc_id", "rare").agg(F.max(F.struct("n", "key")).alias("m"))
    chosen = materialize(chosen.select("doc_id", "rare", F.col("m.key").alias("key")))
    hub = chosen.groupBy("key").agg(F.min(F.struct("rare", F.col("doc_id").alias("h"))).alias("m"))
    postings = postings.drop("rare")
    star = materialize(chosen.join(hub.select("key", "m.h"), "key"))
    linked = verified(_pairs(star.where("doc_id <> h"), "doc_id", "h"), sets)
    # Those that it does not link meet several of those that it does.
    near_hub = linked.select(F.col("a").alias("doc_id"), F.col("b").alias("h")).unionByName(linked.select(F.col("b").alias("doc_id"), F.col("a").alias("h")))
    star = materialize(star.join(near_hub.withColumn("linked", F.lit(True)), ["doc_id", "h"], "left"))
    lot = lambda i: F.min(F.when(F.col("linked"), F.struct(F.xxhash64("doc_id", F.lit(i)), "doc_id")))["doc_id"]
    hubs = star.groupBy("key").agg(F.array_distinct(F.array(*(lot(i) for i in range(HUBS)))).alias("hubs"))
    second = star.where("linked IS NULL AND doc_id <> h").join(hubs, "key").select("doc_id", F.explode("hubs").alias("h"))
    links = links.unionByName(linked).unionByName(verified(near(_pairs(second.where("h IS NOT NULL"), "doc_id", "h"), nodes), sets))
    # What is still apart meets: each set outside a key's main (largest) component with all others of the key.
    parts = materialize(connected_components(links))
    rows = postings.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    rows = materialize(rows.withColumn("component", F.coalesce("component", "doc_id")))
    mains = rows.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key")
    mains = mains.agg(F.max(F.struct("n", "component")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
    rows = rows.join(mains.select("key", F.col("m.component").alias("main")), "key")
    rows = materialize(rows.join(wide_sketches(sets), "doc_id"))
    named = ["doc_id", "n", "component", *(f"w{i}" for i in range(WORDS))]
    outside = rows.where("component <> main").select(F.col("key").alias("x_key"), *(F.col(c).alias(f"x_{c}") for c in named))
    apart = " + ".join(f"bit_count(w{i} ^ x_w{i})" for i in range(WORDS))
    meet = (
        "key = x_key AND component <> x_component AND (component = main OR x_doc_id < doc_id)"
        f" AND 4 * n <= 5 * x_n AND 4 * x_n <= 5 * n AND 9 * ({apart}) <= n + x_n"
    )
    cross = near(_pairs(materialize(outside).join(rows, F.expr(meet)), "doc_id", "x_doc_id"), nodes)
    return parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(verified(cross, sets))


def unsettled(holders: DataFrame, nodes: DataFrame, crowded: DataFrame) -> DataFrame:
    """(doc_id, rare): the holders of which at most a fifth of the shingles are rare, with that share.

    crowded: (doc_id, c), the number of shingles that more than CROWD holders have.
    """
    rows = nodes.select("doc_id", "n").join(holders, "doc_id", "left_semi").join(crowded, "doc_id")
    return rows.where("5 * (n - c) <= n").groupBy("doc_id").agg(F.min((F.col("n") - F.col("c")) / F.col("n")).alias("rare"))


def links_of(documents: DataFrame, signed: DataFrame, gone: DataFrame) -> DataFrame:
    """(a, b): links that connect all components of the documents whose id is not in gone."""
    own = signed.where("n > 0 AND doc_id IS NOT NULL").join(gone, "doc_id", "left_anti")
    nodes = materialize(own.select("doc_id", "n", "sketch").distinct())
    found = materialize(runs(own.select("doc_id", "keys").mapInArrow(_key_rows, "key long, doc_id long, direct boolean")))
    pairs = near(_pairs(found.where("b IS NOT NULL"), "a", "b"), nodes)
    crowded = found.where("b IS NULL").select(F.col("a").alias("doc_id"), "key").distinct()
    holders = materialize(crowded.select("doc_id").distinct())
    if holders.isEmpty():
        return verified(pairs, sets_of(documents, _ends(pairs)))
    sets = sets_of(documents, _ends(pairs).unionByName(holders).distinct())
    shingles = sets.join(holders, "doc_id", "left_semi").mapInArrow(_shingle_rows, "key long, doc_id long, direct boolean")
    met = materialize(runs(shingles).groupBy("a", "b").agg(F.count("*").alias("c")))
    more = _pairs(met.where("b IS NOT NULL"), "a", "b").join(pairs, ["a", "b"], "left_anti")
    links = verified(pairs.unionByName(near(more, nodes)), sets)
    rest = materialize(unsettled(holders, nodes, met.where("b IS NULL").select(F.col("a").alias("doc_id"), "c")))
    if rest.isEmpty():
        return links
    postings = materialize(crowded.join(rest, "doc_id"))
    return crowded_links(postings, nodes, sets, links)


def jaccard_join(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Documents link when 100 * |A & B| >= 80 * |A | B| for their sets of 5-word shingles.
    """
    bound_batches(documents.sparkSession)
    signed = materialize(signatures(documents))
    named = signed.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "set_key")
    classes = materialize(named.groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    first = classes.select(F.col("rep").alias("doc_id")).distinct()
    gone = materialize(named.select("doc_id").distinct().join(first, "doc_id", "left_anti"))
    links = materialize(links_of(documents, signed, gone))
    # Rows that share a doc_id are one node, whatever their texts.
    same = named.join(classes, "set_key").where("doc_id <> rep").select("doc_id", "rep").distinct()
    shared = same.join(first, "doc_id", "left_semi")
    links = links.unionByName(shared.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    parts = materialize(connected_components(links))
    reached = materialize(
        classes.join(parts, classes.rep == parts.node, "left").select("set_key", F.coalesce("component", "rep").alias("class"))
    )
    return signed.select("doc_id", "n", "set_key").join(reached, "set_key", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("component_id"),
    )
