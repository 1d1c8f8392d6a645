"""Cosine similarity of sparse rows, and leader clustering on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.components import connected_components
from ..functions.tables import global_index, materialize


def label_means(vec: DataFrame, n_samples: int) -> DataFrame:
    """(block, idx, mean): means over blocks of n consecutive instances, zeros counted, rounded half to even.

    vec: (instance_id, idx, cnt), instance_id dense from 0. A last block may be shorter.
    """
    sizes = vec.select("instance_id").distinct().groupBy(F.floor(F.col("instance_id") / n_samples).alias("block")).agg(F.count("*").alias("n"))
    sums = vec.groupBy(F.floor(F.col("instance_id") / n_samples).alias("block"), "idx").agg(F.sum("cnt").alias("s"))
    return sums.join(sizes, "block").select("block", "idx", F.bround(F.col("s") / F.col("n")).alias("mean")).where("mean > 0")


def unit_rows(rows: DataFrame) -> DataFrame:
    """(id, idx, v): rows (id, idx, value), values not zero, scaled to unit length."""
    norm = rows.groupBy("id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return rows.join(norm, "id").select("id", "idx", (F.col("value") / F.col("norm")).alias("v"))


def _dots(pairs: DataFrame, unit: DataFrame) -> DataFrame:
    """(a, b, cosine) of given pairs."""
    a = unit.select(F.col("id").alias("a"), "idx", F.col("v").alias("va"))
    b = unit.select(F.col("id").alias("b"), "idx", F.col("v").alias("vb"))
    return pairs.join(a, "a").join(b, ["b", "idx"]).groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("cosine"))


#: Rows of a tile: two tiles of packed rows and the products between them are what a task holds.
TILE = 256


def _packed_rows(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tile's rows one after another: which row of the tile, feature, value."""
    sizes = part["idx"].map(len).to_numpy()
    return np.repeat(np.arange(len(part)), sizes), np.concatenate(part["idx"].to_numpy()), np.concatenate(part["v"].to_numpy())


def _products(tile: pd.DataFrame) -> pd.DataFrame:
    """(a, b, cosine) of the rows of two tiles, or of one with itself, that share a feature."""
    left, right = tile[tile["side"] == 0], tile[tile["side"] == 1]
    if right.empty:
        right = left
    (ra, ia, va), (rb, ib, vb) = _packed_rows(left), _packed_rows(right)
    dots, shared = np.zeros((len(left), len(right))), np.zeros((len(left), len(right)), bool)
    features = np.intersect1d(ia, ib)
    for start in range(0, len(features), 4096):  # as many columns of the dense tiles at a time
        some = features[start : start + 4096]
        dense = []
        for rows, own, values, n in ((ra, ia, va, len(left)), (rb, ib, vb, len(right))):
            at = np.searchsorted(some, own).clip(0, len(some) - 1)
            hit = some[at] == own
            m = np.zeros((n, len(some)))
            m[rows[hit], at[hit]] = values[hit]
            dense.append(m)
        dots += dense[0] @ dense[1].T
        shared |= (dense[0] != 0).astype(np.float32) @ (dense[1] != 0).astype(np.float32).T > 0
    a, b = np.nonzero(shared)
    first, second = left["id"].to_numpy()[a], right["id"].to_numpy()[b]
    keep = first < second if tile["side"].max() == 0 else np.ones(len(a), bool)
    out = pd.DataFrame({"a": np.minimum(first, second)[keep], "b": np.maximum(first, second)[keep], "cosine": dots[a, b][keep]})
    return out


def cosine_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, cosine) of all pairs a < b that share a feature; other pairs are 0. ids are long, values not zero.

    All pairs are the result itself; where only similar ones are wanted, similar_pairs finds them without the others.
    Rows are packed into tiles of TILE rows. Each pair of tiles meets once and multiplies inside a task, so that no
    row is made for a pair and a feature, and a row travels once for each tile, not for each row.
    """
    unit = unit_rows(rows).groupBy("id").agg(F.collect_list("idx").alias("idx"), F.collect_list("v").alias("v"))
    packed = global_index(unit, ["id"], "n", deal=1).withColumn("tile", F.floor(F.col("n") / TILE)).drop("n")
    packed = materialize(packed)
    last = packed.agg(F.max("tile")).first()[0]
    if last is None:
        return packed.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("cosine"))
    # A tile meets those before it as the right side, itself and those after it as the left one.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))
    met = packed.withColumn("other", other)
    met = met.select(
        F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "id", "idx", "v"
    )
    return met.groupBy("x", "y").applyInPandas(_products, "a long, b long, cosine double")


#: Most rows of a group whose pairs are sought, and rows and features whose products a task makes at a time.
GROUP, STRIP, COLUMNS = 8192, 512, 512
#: Products that a task makes in the time in which a join makes a pair.
WORTH = 100_000
#: Decimals to which a cosine is compared, so that the order of a sum decides nothing.
PLACES = 9


def _sorted_by_place(part: pd.DataFrame, features: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The entries of a group with these features, feature by feature: row, place of the feature, value; and where blocks of columns start."""
    rows, idx, v = _packed_rows(part)
    hit = np.isin(idx, features)
    rows, at, v = rows[hit], np.searchsorted(features, idx[hit]), v[hit]
    order = np.argsort(at, kind="stable")
    return rows[order], at[order], v[order], np.searchsorted(at[order], np.arange(0, len(features) + columns, columns))


def _above(threshold: float):
    def dense(entries, block: int, low: int, high: int, width: int) -> np.ndarray:
        rows, at, v, starts = entries
        rows, at, v = (x[starts[block] : starts[block + 1]] for x in (rows, at, v))
        own = (rows >= low) & (rows < high)
        out = np.zeros((high - low, width))
        out[rows[own] - low, at[own] - block * COLUMNS] = v[own]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(a, b, cosine) above threshold of the rows of two groups, or of one with itself."""
        part = pd.concat(list(batches))
        left, right = part[part["side"] == 0], part[part["side"] == 1]
        alone = part["x"].iloc[0] == part["y"].iloc[0]
        if alone:
            right = left
        if left.empty or right.empty:
            return
        first, second = left["id"].to_numpy(), right["id"].to_numpy()
        features = np.intersect1d(*(np.concatenate(x["idx"].to_numpy()) for x in (left, right)))
        a, b = _sorted_by_place(left, features, COLUMNS), _sorted_by_place(right, features, COLUMNS)
        widths = [min(COLUMNS, len(features) - k) for k in range(0, len(features), COLUMNS)]
        kept = dense(b, 0, 0, len(right), widths[0]) if len(widths) == 1 else None
        for low in range(0, len(left), STRIP):
            high = min(low + STRIP, len(left))
            dots = np.zeros((high - low, len(right)))
            for k, width in enumerate(widths):
                dots += dense(a, k, low, high, width) @ (dense(b, k, 0, len(right), width) if kept is None else kept).T
            i, j = np.nonzero(dots > threshold)
            some = np.round(dots[i, j], PLACES) > threshold
            i, j = i[some], j[some]
            x, y = first[low + i], second[j]
            keep = x < y if alone else np.ones(len(x), bool)
            yield pd.DataFrame({"a": np.minimum(x, y)[keep], "b": np.maximum(x, y)[keep], "cosine": dots[i, j][keep]})

    return run


def _pairs_of_groups(unit: DataFrame, n: int, threshold: float) -> DataFrame:
    """similar_pairs of n unit rows by products of all rows: each two groups meet in one task, and only similar pairs leave it."""
    groups = -(-n // max(1, min(GROUP, max(256, -(-n // 16)))))
    packed = unit.groupBy("id").agg(F.collect_list("idx").alias("idx"), F.collect_list("v").alias("v"))
    packed = materialize(packed.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups))))
    met = packed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    met = met.select(
        F.least("group", "other").alias("x"), F.greatest("group", "other").alias("y"), (F.col("group") > F.col("other")).cast("int").alias("side"), "id", "idx", "v"
    )
    return met.groupBy("x", "y").applyInPandas(_above(threshold), "a long, b long, cosine double")


def similar_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cosine) of the pairs a < b whose cosine, to PLACES decimals, is above threshold.

    Features are ranked by how many rows hold them. The more frequent features of a row, as long as their
    own length stays below threshold, cannot reach it alone; so a similar pair's rarest common feature is
    among the others of both rows, and only those are joined. Where even these are so common that the join would make
    more than one pair in WORTH products of all rows, the rows are multiplied in groups.
    """
    unit = materialize(unit_rows(rows))
    held = unit.groupBy("idx").agg(F.count("*").alias("held"))
    common = Window.partitionBy("id").orderBy(F.desc("held"), "idx").rowsBetween(Window.unboundedPreceding, 0)
    rest = unit.join(held, "idx").withColumn("square", F.sum(F.col("v") * F.col("v")).over(common))
    rare = materialize(rest.where(F.col("square") >= threshold * threshold - 1e-9).select("id", "idx"))
    if threshold >= 0:
        n = unit.select("id").distinct().count()
        each = rare.groupBy("idx").agg(F.count("*").cast("double").alias("n"))
        made = each.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]
        if made * WORTH > n * (n - 1) / 2 * held.count():
            return _pairs_of_groups(unit, n, threshold)
    a, b = rare.alias("a"), rare.alias("b")
    met = a.join(b, (F.col("a.idx") == F.col("b.idx")) & (F.col("a.id") < F.col("b.id")))
    met = met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    return _dots(met, unit).where(F.round("cosine", PLACES) > threshold)


def _mean(n, square, own):
    """The mean cosine off the diagonal of n rows, from the square of the sum of their unit rows."""
    return F.when(n > 1, (square - own) / (n * (n - 1))).otherwise(1.0)


def mean_similarity(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: n and the mean cosine over all pairs of ids without the diagonal.

    The sum over all pairs is the squared length of the sum of the unit rows: no pair is made.
    """
    n = ids.select("id").distinct().agg(F.count("*").alias("n"))
    unit = materialize(unit_rows(rows))
    sums = unit.groupBy("idx").agg(F.sum("v").alias("v")).agg(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)).alias("s"))
    own = unit.agg(F.count_distinct("id").alias("own"))
    return n.crossJoin(sums).crossJoin(own).select("n", _mean(F.col("n"), F.col("s"), F.col("own")).alias("mean_cosine"))  # one row each


#: Links of a component that one task walks through in order; larger components are decided in rounds.
MOST_LINKS = 1_000_000


def _greedy(links: pd.DataFrame) -> pd.DataFrame:
    """(id, leader) of one component's links (a, b), both ways: the one-by-one order itself."""
    near: dict[int, list[int]] = {}
    for a, b in zip(links["a"].tolist(), links["b"].tolist(), strict=True):
        near.setdefault(a, []).append(b)
    leader: dict[int, int] = {}
    for item in sorted(near):
        if item not in leader:
            leader[item] = item
            for other in near[item]:
                leader.setdefault(other, item)
    return pd.DataFrame({"id": list(leader), "leader": list(leader.values())})


def leader_clusters(pairs: DataFrame, ids: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(id, leader): in id order an open item leads and takes every open item more similar than threshold.

    Items of different components never meet: each component of at most MOST_LINKS links is walked through by one task, in
    id order, however long its chains are. Larger ones are decided in rounds, which no task needs to hold. ids are long.
    """
    edges = pairs.where(F.col("cosine") > threshold).select("a", "b")
    edges = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    parts = connected_components(edges)
    named = materialize(edges.join(parts.select(F.col("node").alias("a"), "component"), "a"))
    sizes = named.groupBy("component").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") <= 2 * MOST_LINKS).select("component")
    walked = materialize(named.join(small, "component").groupBy("component").applyInPandas(_greedy, "id long, leader long"))
    large = materialize(named.join(small, "component", "left_anti").select("a", "b"))
    alone = ids.select("id").distinct().join(named.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
    out = walked.unionByName(alone.select("id", F.col("id").alias("leader")))
    if large.isEmpty():
        return out
    return out.unionByName(_leaders_in_rounds(large, large.select(F.col("a").alias("id"))))


def row_leaders(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, leader): leader_clusters of sparse rows (id, idx, value) by their cosines to PLACES decimals.

    Equal rows have the same leader, the first of them or that one's: only the first is compared with others.
    """
    whole = F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("row")
    packed = materialize(rows.groupBy("id").agg(whole))
    if threshold < 1:
        own = packed.join(packed.groupBy("row").agg(F.min("id").alias("first")), "row")
    else:
        own = packed.withColumn("first", F.col("id"))
    own = materialize(own.select("id", "first"))
    kept = materialize(rows.join(own.where("id = first").select("id"), "id"))
    found = leader_clusters(materialize(similar_pairs(kept, threshold)), kept.select("id"), threshold)
    return own.join(found.select(F.col("id").alias("first"), "leader"), "first").select("id", "leader")


def _leaders_in_rounds(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, leader) of links (a, b), both ways.

    Each round, an item leads if no open neighbour is smaller; open items next to leaders join the
    smallest of them. That gives the groups of the one-by-one order.
    """
    open_, out, leaders = materialize(ids.select("id").distinct()), None, None
    while True:
        own = edges.join(open_.select(F.col("id").alias("a")), "a", "left_semi")
        inside = own.join(open_.select(F.col("id").alias("b")), "b", "left_semi")
        waiting = inside.where("b < a").select(F.col("a").alias("id")).distinct()
        new = open_.join(waiting, "id", "left_anti")
        if leaders is not None:  # items next to an earlier leader never lead
            taken = own.join(leaders.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id")).distinct()
            new = new.join(taken, "id", "left_anti")
        new = materialize(new)
        leaders = new if leaders is None else leaders.unionByName(new)
        joined = own.join(leaders.select(F.col("id").alias("b")), "b", "left_semi").groupBy("a").agg(F.min("b").alias("leader"))
        joined = materialize(joined)
        # an open item without a leader may still lead and then take its neighbours from larger leaders
        undecided = waiting.join(joined.select(F.col("a").alias("id")), "id", "left_anti")
        threat = inside.join(undecided.select(F.col("id").alias("b")), "b", "left_semi").groupBy("a").agg(F.min("b").alias("threat"))
        sure = joined.join(threat, "a", "left").where("threat IS NULL OR leader < threat").select(F.col("a").alias("id"), "leader")
        done = materialize(new.select("id", F.col("id").alias("leader")).unionByName(sure))
        out = done if out is None else out.unionByName(done)
        open_ = materialize(open_.join(done.select("id"), "id", "left_anti"))
        if open_.isEmpty():
            return out


def group_similarity(clusters: DataFrame, rows: DataFrame) -> DataFrame:
    """(leader, n, mean_similarity): off-diagonal mean cosine inside each group, 1 for a single item.

    clusters: (id, leader); rows: (id, idx, value). Made from one sum per group and feature, without pairs.
    """
    unit = unit_rows(rows).join(clusters, "id")
    squares = unit.groupBy("leader", "idx").agg(F.sum("v").alias("v")).groupBy("leader").agg(F.sum(F.col("v") * F.col("v")).alias("s"))
    held = clusters.join(rows.select("id").distinct().withColumn("held", F.lit(1)), "id", "left")
    sizes = held.groupBy("leader").agg(F.count("*").alias("n"), F.count("held").alias("own"))
    mean = _mean(F.col("n"), F.coalesce("s", F.lit(0.0)), F.col("own"))
    return sizes.join(squares, "leader", "left").select("leader", "n", mean.alias("mean_similarity"))


def cluster_labels(vec: DataFrame, n_samples: int, threshold: float) -> DataFrame:
    """(leader, n, mean_similarity): means per block of samples, cosine, leader groups."""
    rows = materialize(label_means(vec, n_samples).select(F.col("block").alias("id"), "idx", F.col("mean").alias("value")))
    clusters = materialize(row_leaders(rows, threshold))
    return group_similarity(clusters, rows)
