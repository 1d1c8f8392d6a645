"""Tag filters by how many labels or instances share a tag, and row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import combinations


def tag_label_frequency(tags: DataFrame, instance_label: DataFrame) -> DataFrame:
    """(tag, n_labels): number of distinct label combinations a tag occurs in."""
    keys = combinations(instance_label).select("instance_id", "label_key")
    return tags.join(keys, "instance_id").groupBy("tag").agg(F.count_distinct("label_key").alias("n_labels"))


def filter_by_frequency(tags: DataFrame, tag_df: DataFrame, freq: int) -> DataFrame:
    """Tags that are unknown to tag_df or in fewer than freq labels; equal or more are dropped."""
    common = tag_df.where(F.col("n_labels") >= freq).select("tag")
    return tags.join(common, "tag", "left_anti")


def emptied_instances(before: DataFrame, after: DataFrame) -> DataFrame:
    """Instances that a filter left without tags."""
    return before.select("instance_id").distinct().join(after.select("instance_id").distinct(), "instance_id", "left_anti")


def remove_tags_of_many_labels(tags: DataFrame, instance_label: DataFrame, most: int) -> DataFrame:
    """Without tags found in more than `most` labels."""
    wide = tags.join(instance_label, "instance_id").groupBy("tag").agg(F.count_distinct("label").alias("n")).where(F.col("n") > most)
    return tags.join(wide.select("tag"), "tag", "left_anti")


def remove_tags_by_total(tags: DataFrame, most: int) -> DataFrame:
    """Without tags whose counts sum to more than `most`."""
    heavy = tags.groupBy("tag").agg(F.sum("cnt").alias("n")).where(F.col("n") > most)
    return tags.join(heavy.select("tag"), "tag", "left_anti")


def noise_tags(tags: DataFrame, instance_label: DataFrame, least: int = 5) -> DataFrame:
    """Tags seen in fewer than `least` instances of some label."""
    seen = tags.join(instance_label, "instance_id").groupBy("label", "tag").agg(F.count_distinct("instance_id").alias("n"))
    return seen.where(F.col("n") < least).select("tag").distinct()


def site_package_files(files: DataFrame, inside: str, without: tuple = ("cache",)) -> DataFrame:
    """Files whose path holds `inside` and none of `without`; of archive members (with is_file) regular files only."""
    kept = files.where("is_file") if "is_file" in files.columns else files
    kept = kept.where(F.contains("path", F.lit(inside)))
    for part in without:
        kept = kept.where(~F.contains("path", F.lit(part)))
    return kept


def cost_positive(costs: DataFrame, threshold: float = 0.9) -> DataFrame:
    return costs.where(F.col("cost") <= threshold)


def shared_with_label(tags: DataFrame, instance_label: DataFrame, label: str) -> DataFrame:
    """Tags of a label that another label has too."""
    by = tags.join(instance_label, "instance_id").select("label", "tag").distinct()
    own = by.where(F.col("label") == label).select("tag")
    return own.join(by.where(F.col("label") != label).select("tag").distinct(), "tag", "left_semi")


def remove_shared_with_label(tags: DataFrame, instance_label: DataFrame, label: str) -> DataFrame:
    return tags.join(shared_with_label(tags, instance_label, label), "tag", "left_anti")
