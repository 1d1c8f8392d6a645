"""Sub-models ("experts") as tables joined on model_id: selection, scoring and merging.

A stump is (model_id, label, round, tag, cut, leaf_low, leaf_high, leaf_default): leaf_high for a
count of at least cut, leaf_low below it, leaf_default where the tag is absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import running_total


def used_tags(stumps: DataFrame) -> DataFrame:
    return stumps.select("model_id", "tag").distinct()


def select_experts(tags: DataFrame, used: DataFrame) -> DataFrame:
    """(model_id, instance_id, tag, cnt): an instance goes to the models with which it shares a tag."""
    return tags.join(used, "tag").select("model_id", "instance_id", "tag", "cnt")


def fan_out(instances: DataFrame, models: DataFrame, tags: DataFrame, used: DataFrame) -> DataFrame:
    """(model_id, instance_id, n_tags): every pair, with no shared tag counted 0.

    The pairs are the result itself, models times instances.
    """
    shared = select_experts(tags, used).groupBy("model_id", "instance_id").agg(F.count("*").alias("n_tags"))
    pairs = instances.select("instance_id").distinct().crossJoin(models.select("model_id").distinct())
    return pairs.join(shared, ["model_id", "instance_id"], "left").select(
        "model_id", "instance_id", F.coalesce("n_tags", F.lit(0)).alias("n_tags")
    )


def score_stumps(selected: DataFrame, stumps: DataFrame) -> DataFrame:
    """(model_id, instance_id, label, margin) for selected tags: defaults for all, corrected by present tags."""
    base = stumps.groupBy("model_id", "label").agg(F.sum("leaf_default").alias("base"))
    leaf = F.when(F.col("cnt") >= F.col("cut"), F.col("leaf_high")).otherwise(F.col("leaf_low"))
    moved = (
        selected.join(stumps, ["model_id", "tag"])
        .groupBy("model_id", "instance_id", "label")
        .agg(F.sum(leaf - F.col("leaf_default")).alias("moved"))
    )
    asked = selected.select("model_id", "instance_id").distinct().join(base, "model_id")
    return asked.join(moved, ["model_id", "instance_id", "label"], "left").select(
        "model_id", "instance_id", "label", (F.col("base") + F.coalesce("moved", F.lit(0.0))).alias("margin")
    )


def predict_labels(margins: DataFrame, threshold: float = 0.5) -> DataFrame:
    probability = 1 / (1 + F.exp(-F.col("margin")))
    return margins.withColumn("p", probability).where(F.col("p") > threshold).select("model_id", "instance_id", "label", "p")


def decode(ones: DataFrame, label_index: DataFrame) -> DataFrame:
    """(instance_id, idx) to (instance_id, label)."""
    return ones.join(label_index, "idx").select("instance_id", "label")


def to_instances(predictions: DataFrame, row_map: DataFrame) -> DataFrame:
    """(instance_id, label) from predictions (model_id, row, label) by each model's own row numbers.

    row_map: (model_id, row, instance_id). Rows that the map does not hold go.
    """
    return predictions.join(row_map, ["model_id", "row"]).select("instance_id", "label")


def merge_predictions(*parts: DataFrame) -> DataFrame:
    """(instance_id, labels): all models' labels; one that two models give stays twice."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("instance_id").agg(F.sort_array(F.collect_list("label")).alias("labels"))


def re_expand(instances: DataFrame, label_index: DataFrame, predicted: DataFrame) -> DataFrame:
    """(instance_id, label, value): the dense 0/1 matrix with skipped instances as zeros.

    The matrix is the result itself, instances times labels.
    """
    grid = instances.select("instance_id").distinct().crossJoin(label_index.select("label").distinct())
    ones = predicted.select("instance_id", "label").distinct().withColumn("value", F.lit(1))
    return grid.join(ones, ["instance_id", "label"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def expert_inference(tags: DataFrame, stumps: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(model_id, instance_id, label, p): selection, scoring and threshold of all experts in one plan."""
    return predict_labels(score_stumps(select_experts(tags, used_tags(stumps)), stumps), threshold)


def route_by_label(instance_label: DataFrame, model_label: DataFrame) -> DataFrame:
    """(model_id, instance_id) wherever a label is shared."""
    return instance_label.join(model_label, "label").select("model_id", "instance_id").distinct()


def eligible(instance_label: DataFrame, trained: DataFrame) -> DataFrame:
    """Instances all of whose labels were trained."""
    missing = instance_label.join(trained.select("label").distinct(), "label", "left_anti").select("instance_id")
    return instance_label.select("instance_id").distinct().join(missing, "instance_id", "left_anti")


def missing_models(expected: DataFrame, present: DataFrame) -> DataFrame:
    return expected.select("model_id").distinct().join(present.select("model_id"), "model_id", "left_anti")


def shared_tags(used: DataFrame) -> DataFrame:
    """n_tags, n_shared (in more than one model) and share in %, over all models."""
    per = used.groupBy("tag").agg(F.count_distinct("model_id").alias("n"))
    return per.agg(
        F.count("*").alias("n_tags"),
        F.count_if(F.col("n") > 1).alias("n_shared"),
        (100 * F.count_if(F.col("n") > 1) / F.count("*")).alias("share"),
    )


def expert_usage(tags: DataFrame, used: DataFrame) -> DataFrame:
    """(model_id, n_instances) with at least one shared tag; models without any are absent."""
    pairs = select_experts(tags, used).select("model_id", "instance_id").distinct()
    return pairs.groupBy("model_id").agg(F.count("*").alias("n_instances"))


def heavy_models(load: DataFrame) -> DataFrame:
    """(model_id, n, heavy): heavy above mean plus population deviation of all models."""
    per = load.groupBy("model_id").agg(F.sum("n").alias("n"))
    limit = per.agg((F.avg("n") + F.stddev_pop("n")).alias("_limit"))
    return per.crossJoin(F.broadcast(limit)).select("model_id", "n", (F.col("n") > F.col("_limit")).alias("heavy"))


def usage_cdf(usage: DataFrame) -> DataFrame:
    """usage with the cumulative share in ascending order of use."""
    summed = running_total(usage, ["n_instances", "model_id"], "n_instances", "_upto")
    whole = summed.agg(F.max("_upto").alias("_all"))
    return summed.crossJoin(F.broadcast(whole)).withColumn("share", F.col("_upto") / F.col("_all")).drop("_upto", "_all")  # one row
