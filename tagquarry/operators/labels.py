"""Label forms and label combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unify_labels(changesets: DataFrame) -> DataFrame:
    """labels if present, else the single label as an array."""
    return changesets.withColumn("labels", F.coalesce("labels", F.array("label"))).drop("label")


def normalise(label: Column) -> Column:
    """a==1.2 to a_v1_2, fit for names."""
    return F.replace(F.replace(label, F.lit("=="), F.lit("_v")), F.lit("."), F.lit("_"))


def join_names(labels: Column, sep: str = "_p_") -> Column:
    return F.array_join(F.transform(labels, normalise), sep)


def base_image_name(image: Column) -> Column:
    return F.replace(F.replace(image, F.lit(":"), F.lit("")), F.lit("."), F.lit("_"))


def denormalise(name: Column) -> Column:
    """The labels in the third dot part of a name."""
    parts = F.split(F.get(F.split(name, r"\."), F.lit(2)), "_p_")
    return F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("_v"), F.lit("==")), F.lit("_"), F.lit(".")))


def package(label: Column) -> Column:
    return F.split(label, "==")[0]


def version(label: Column) -> Column:
    return F.get(F.split(label, "=="), F.lit(1))


def file_fields(name: Column) -> Column:
    """struct<label, package, program>: second dot part, text before the last dash, first dot part."""
    return F.struct(
        F.get(F.split(name, r"\."), F.lit(1)).alias("label"),
        F.regexp_extract(F.regexp_replace(name, r".{4}$", ""), r"^(.*)-", 1).alias("package"),
        F.split(name, r"\.")[0].alias("program"),
    )


def combinations(instance_label: DataFrame) -> DataFrame:
    """(instance_id, label_key, n_labels): an instance's sorted labels joined by &&."""
    labels = F.sort_array(F.collect_set("label"))
    out = instance_label.groupBy("instance_id").agg(labels.alias("labels"))
    return out.select("instance_id", F.array_join("labels", "&&").alias("label_key"), F.size("labels").alias("n_labels"))


def single_label(instance_label: DataFrame) -> DataFrame:
    """Instances with exactly one label."""
    one = instance_label.groupBy("instance_id").agg(F.count("*").alias("n"), F.first("label").alias("label"))
    return one.where("n = 1").select("instance_id", "label")


def flatten_images(images: DataFrame) -> DataFrame:
    """(image, layers array<string>) to one instance per layer, named by its position."""
    return images.select("image", F.posexplode("layers").alias("k", "layer")).select(
        F.concat("image", F.lit("_layer_idx_"), F.col("k").cast("string")).alias("instance_id"), "image", "layer"
    )
