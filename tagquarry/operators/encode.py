"""Vocabularies, label indexes and sparse features as long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import global_index


def vocabulary(tags: DataFrame) -> DataFrame:
    return tags.select("tag").distinct()


def assign_index(values: DataFrame, column: str, start: int = 0) -> DataFrame:
    """Distinct values in sorted order, numbered from start."""
    found = global_index(values.select(column).where(F.col(column).isNotNull()).distinct(), [column])
    return found.withColumn("idx", F.col("idx") + start)


def append_index(known: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """known (column, idx) with the new values after its last index; old indexes stay."""
    new = values.select(column).distinct().join(known, column, "left_anti")
    last = known.agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("last"))
    numbered = global_index(new, [column]).crossJoin(F.broadcast(last))  # one row
    return known.select(column, "idx").unionByName(numbered.select(column, (F.col("idx") + F.col("last") + 1).alias("idx")))


def look_up(rows: DataFrame, index: DataFrame, column: str) -> DataFrame:
    """Rows with a known value and its idx; others are dropped."""
    return rows.join(index.select(column, "idx"), column)


def unseen(rows: DataFrame, index: DataFrame, column: str) -> DataFrame:
    """The values that look_up drops."""
    return rows.select(column).distinct().join(index, column, "left_anti")


def encode_features(tags: DataFrame, vocab: DataFrame, compact_factor: int = 1, input_size: int | None = None) -> DataFrame:
    """(instance_id, idx, value): counts at idx % input_size; of colliding tags the largest index wins.

    input_size is len(vocab) // compact_factor unless given.
    """
    known = look_up(tags, vocab, "tag")
    if input_size is None:
        size = vocab.agg(F.greatest(F.lit(1), F.floor(F.count("*") / compact_factor)).alias("_size"))
        known = known.crossJoin(F.broadcast(size))  # one row
    else:
        known = known.withColumn("_size", F.lit(input_size))
    slot = (F.col("idx") % F.col("_size")).alias("slot")
    return (
        known.groupBy("instance_id", slot)
        .agg(F.max_by("cnt", "idx").cast("double").alias("value"))
        .select("instance_id", F.col("slot").alias("idx"), "value")
    )


def encode_labels(instance_label: DataFrame, label_index: DataFrame) -> DataFrame:
    """(instance_id, idx, value 1): the ones of the label matrix."""
    return look_up(instance_label, label_index, "label").select("instance_id", "idx", F.lit(1).alias("value")).distinct()


def bag_of_words(tags: DataFrame, words: list[str]) -> DataFrame:
    """(instance_id, features): a sparse vector by a given vocabulary, from one row for each tag and its count.

    Instances without any of the words have an empty vector, those without tags none.
    """
    from pyspark.ml.linalg import Vectors, VectorUDT

    size = len(words)
    known = tags.sparkSession.createDataFrame(list(zip(words, range(size))), "tag string, idx int")
    met = tags.join(known, "tag", "left").groupBy("instance_id", "idx").agg(F.sum("cnt").alias("cnt"))
    entries = F.array_compact(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("idx", F.col("cnt").cast("double").alias("cnt")))))
    made = met.groupBy("instance_id").agg(F.sort_array(entries).alias("e"))

    @F.udf(VectorUDT())
    def vector(indices, values):
        return Vectors.sparse(size, indices, values)

    return made.select("instance_id", vector(F.col("e.idx"), F.col("e.cnt")).alias("features"))


def save_index(index: DataFrame, path: str, model_id: str) -> None:
    """Write a vocabulary or label index as one model's part of a table; what the model had before is replaced, others stay."""
    written = index.withColumn("model_id", F.lit(model_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    written.partitionBy("model_id").parquet(path)


def load_index(spark, path: str, model_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("model_id") == model_id).drop("model_id")
