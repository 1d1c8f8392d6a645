"""Sampling, folds, batches and grouping of labels into sub-models. All orders are explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import discard, global_index, materialize
from .labels import package


def _rank(by, order):
    """For operators that keep the first few of each label: Spark then cuts labels before the shuffle."""
    return F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1


def numbered(rows: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """rows with their number from 0 in each label; a frequent label is spread over range partitions."""
    indexed = global_index(rows, [by, order], "_i")
    first = indexed.groupBy(F.col(by).alias("_by")).agg(F.min("_i").alias("_first"))
    joined = indexed.join(first, F.col(by).eqNullSafe(F.col("_by")))
    return joined.withColumn(name, F.col("_i") - F.col("_first")).drop("_i", "_by", "_first")


def first_per_label(rows: DataFrame, n: int, by: str = "label", order: str = "instance_id") -> DataFrame:
    return rows.withColumn("_r", _rank(by, order)).where(F.col("_r") < n).drop("_r")


def rotating_split(rows: DataFrame, n: int, share: float, batch: int, by: str = "label", order: str = "instance_id") -> DataFrame:
    """The first n rows of each label with is_test: positions int(batch*n*share) up to the next batch's."""
    low, high = int(batch * n * share), int((batch + 1) * n * share)
    ranked = rows.withColumn("_r", _rank(by, order)).where(F.col("_r") < n)
    return ranked.withColumn("is_test", (F.col("_r") >= low) & (F.col("_r") < high)).drop("_r")


def stratified_folds(rows: DataFrame, n: int = 3, by: str = "label", order: str = "instance_id") -> DataFrame:
    """The i-th row of each label is in fold i % n."""
    return numbered(rows, by, order, "_r").withColumn("fold", (F.col("_r") % n).cast("int")).drop("_r")


def random_folds(rows: DataFrame, n: int, seed: int, key: str = "instance_id") -> DataFrame:
    """A seeded shuffle dealt out in turn; repeatable, since the order comes from a hash."""
    shuffled = rows.withColumn("_h", F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string"))))
    out = global_index(shuffled, ["_h", key], "_i")
    return out.withColumn("fold", (F.col("_i") % n).cast("int")).drop("_h", "_i")


def slices(rows: DataFrame, batches: int, order: str = "instance_id", up: bool = False) -> DataFrame:
    """batch of consecutive rows: step len // batches (one more if up), at least 1."""
    indexed = global_index(rows, [order], "_i")
    step = rows.agg(F.greatest(F.lit(1), F.floor(F.count("*") / batches) + int(up)).alias("_step"))
    return indexed.crossJoin(F.broadcast(step)).withColumn("batch", F.floor(F.col("_i") / F.col("_step"))).drop("_i", "_step")


def oversample(rows: DataFrame, times: int) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def train_rows(rows: DataFrame, test: DataFrame, key: str = "instance_id") -> DataFrame:
    """All rows that are not in test."""
    return rows.join(test.select(key).distinct(), key, "left_anti")


def random_groups(labels: DataFrame, n_models: int, seed: int, column: str = "label") -> DataFrame:
    """(column, model_id): a seeded shuffle cut into runs of len // n_models; a remainder makes more."""
    found = labels.select(column).distinct().withColumn("_h", F.md5(F.concat(F.lit(str(seed)), column)))
    indexed = global_index(found, ["_h", column], "_i")
    step = found.agg(F.greatest(F.lit(1), F.floor(F.count("*") / n_models)).alias("_step"))
    grouped = indexed.crossJoin(F.broadcast(step)).withColumn("model_id", F.floor(F.col("_i") / F.col("_step")))
    return grouped.select(column, "model_id")


def version_packed_groups(labels: DataFrame, n_models: int, seed: int) -> DataFrame:
    """(label, model_id): all versions of a package are in one model."""
    named = labels.select("label").distinct().withColumn("package", package(F.col("label")))
    return named.join(random_groups(named, n_models, seed, "package"), "package").select("label", "model_id")


def round_robin_groups(groups: DataFrame, n: int) -> DataFrame:
    """(group_id, model_id): groups dealt to at most n models in their order."""
    indexed = global_index(groups.select("group_id").distinct(), ["group_id"], "_i")
    size = indexed.agg(F.least(F.lit(n), F.count("*")).alias("_n"))
    return indexed.crossJoin(F.broadcast(size)).select("group_id", (F.col("_i") % F.col("_n")).alias("model_id"))


def number_samples(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """name label.k: the next free number of each label. existing: (label, k) already used."""
    ranked = numbered(rows, "label", "instance_id", "k")
    if existing is not None:
        used = existing.groupBy("label").agg((F.max("k") + 1).alias("_start"))
        ranked = ranked.join(used, "label", "left").withColumn("k", F.col("k") + F.coalesce("_start", F.lit(0))).drop("_start")
    return ranked.withColumn("name", F.concat_ws(".", "label", F.col("k").cast("string")))


def equal_groups(rows: DataFrame, most: int = 25, by: str = "label") -> DataFrame:
    """Each label cut to the size of the smallest, at most `most`."""
    cap = rows.groupBy(by).count().agg(F.least(F.lit(most), F.min("count")).alias("_cap"))
    ranked = rows.withColumn("_r", _rank(by, "instance_id")).where(F.col("_r") < most)
    return ranked.crossJoin(F.broadcast(cap)).where("_r < _cap").drop("_r", "_cap")


def stratified_copy(files: DataFrame, n_test: int = 2, n_all: int = 32) -> DataFrame:
    """(label, instance_id, part): the first n_test of each label are test, up to n_all in all train."""
    r = files.withColumn("_r", _rank("label", "instance_id")).where(F.col("_r") < n_all)
    return r.withColumn("part", F.when(F.col("_r") < n_test, "test").otherwise("train")).drop("_r")


def write_stratified(files: DataFrame, path: str, n_test: int = 2, n_all: int = 32) -> None:
    """stratified_copy as two tables, path/test and path/train, with all columns of files."""
    routed = materialize(stratified_copy(files, n_test, n_all))
    for part in ("test", "train"):
        routed.where(F.col("part") == part).drop("part").write.mode("overwrite").parquet(f"{path}/{part}")
    discard(routed)
