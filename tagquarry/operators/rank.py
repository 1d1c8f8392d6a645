"""Labels from costs: top k and the density cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k_labels(costs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(instance_id, label_idx, rank): as many labels of least cost as the instance has true labels (k)."""
    order = Window.partitionBy("instance_id").orderBy("cost", "label_idx")
    ranked = costs.withColumn("rank", F.row_number().over(order))
    return ranked.join(sizes, "instance_id").where("rank <= k").select("instance_id", "label_idx", "rank")


def density_cut(costs: DataFrame, eps: float) -> DataFrame:
    """(instance_id, label_idx): labels in the clusters below the heaviest one.

    An instance's sorted costs fall into clusters at gaps above eps; cluster i weighs i times its
    size; the heaviest wins, the later one on a tie; one cluster predicts nothing.
    """
    order = Window.partitionBy("instance_id").orderBy("cost", "label_idx")
    gap = (F.col("cost") - F.lag("cost").over(order) > eps).cast("int")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    clusters = costs.withColumn("_gap", F.coalesce(gap, F.lit(0))).withColumn("cid", F.sum("_gap").over(run))
    per = clusters.groupBy("instance_id", "cid").agg((F.col("cid") * F.count("*")).alias("weight"))
    best = per.groupBy("instance_id").agg(F.max(F.struct("weight", "cid"))["cid"].alias("best"))
    return clusters.join(best, "instance_id").where("cid < best").select("instance_id", "label_idx")
