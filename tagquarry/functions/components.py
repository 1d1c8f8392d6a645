"""Connected components: links are contracted inside tasks first, then joined in rounds of large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .tables import discard, materialize


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each node of a task's links with the smallest node that they lead to."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (above := up.setdefault(x, x)) != x:
            up[x] = up[above]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    ends = [(x, root(x)) for x in up]
    yield pd.DataFrame([e for e in ends if e[0] != e[1]], columns=["u", "v"]).astype("int64")


def _round(edges: DataFrame) -> DataFrame:
    """Larger neighbours hang on the smallest of a neighbourhood, then all of them on the smallest of theirs."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    down = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    inner = down.join(lowest, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    return inner.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b), both long: component is the least node. Nodes without links are not returned.

    Links sorted into ranges meet many of their neighbours in one task, so that long chains shrink to a few links before the
    first round. A task holds the nodes of its own range of links, never a component.
    """
    ends = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    edges = materialize(ends.repartitionByRange("u", "v").mapInPandas(_contract, "u long, v long"))
    before = None
    while True:
        seen = Observation()  # counted while the round is written
        moved = _round(edges).observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        done, edges = edges, materialize(moved)
        discard(done)
        if seen.get == before:
            break
        before = seen.get
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
