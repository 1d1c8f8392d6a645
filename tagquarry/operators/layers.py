"""Image layers: history alignment and changesets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def align_history(layers: DataFrame, history: DataFrame) -> DataFrame:
    """(image, k, layer, created_by): the k-th layer and the k-th entry whose key empty_layer is absent.

    history: (image, pos, created_by, empty_layer) with null where the key is absent. Layers
    without an entry have a null created_by: see unaligned_layers.
    """
    order = Window.partitionBy("image").orderBy("pos")
    real = history.where("empty_layer IS NULL").select("image", (F.row_number().over(order) - 1).alias("k"), "created_by")
    return layers.join(real, ["image", "k"], "left").select("image", "k", "layer", "created_by")


def unaligned_layers(layers: DataFrame, history: DataFrame) -> DataFrame:
    """Layers beyond the history, which are an error."""
    real = history.where("empty_layer IS NULL").groupBy("image").agg(F.count("*").alias("n"))
    return layers.join(real, "image", "left").where("n IS NULL OR k >= n").select("image", "k", "layer")


def layer_changesets(order: DataFrame, files: DataFrame) -> DataFrame:
    """(image, k, path): a layer's files by its digest ('sha256:x' names the archive 'sha256_x.tar.gz')."""
    archive = F.concat(F.replace("digest", F.lit(":"), F.lit("_")), F.lit(".tar.gz"))
    return order.withColumn("archive", archive).join(files, "archive").select("image", "k", "path")
