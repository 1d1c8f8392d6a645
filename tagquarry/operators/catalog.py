"""Package ranks, versions and combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import global_index, running_total
from .split import numbered


def package_rank(rows: DataFrame, dropped: DataFrame, count: int = 1000) -> DataFrame:
    """(project, rank): the first `count` distinct projects in order of pos that are not dropped."""
    first = rows.groupBy("project").agg(F.min("pos").alias("pos")).join(dropped.select("project").distinct(), "project", "left_anti")
    top = first.orderBy("pos").limit(count)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("pos"))).select("project", "rank")


# Fixed value: the pattern of a version number.
VERSION = r"(\d+\.\d+(?:\.\d+)*)"


def extract_versions(texts: DataFrame) -> DataFrame:
    """(id, versions array): dotted numbers, without the first and the last two."""
    found = F.regexp_extract_all("text", F.lit(VERSION), F.lit(1))
    return texts.select("id", F.slice(found, F.lit(2), F.greatest(F.lit(0), F.size(found) - 3)).alias("versions"))


def three_versions(versions: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(package, version, pos): the first three unseen versions of packages that have three."""
    if seen is not None:
        versions = versions.join(seen.select("package", "version"), ["package", "version"], "left_anti")
    order = Window.partitionBy("package").orderBy("pos", "version")
    ranked = versions.withColumn("r", F.row_number().over(order)).where("r <= 3")
    full = ranked.groupBy("package").agg(F.max("r").alias("n")).where("n = 3").select("package")
    return ranked.join(full, "package", "left_semi").select("package", "version", F.col("r").alias("pos"))


def short_packages(versions: DataFrame) -> DataFrame:
    """Packages with fewer than three versions."""
    return versions.groupBy("package").agg(F.count("*").alias("n")).where("n < 3")


def combinations(labels: DataFrame, bases: DataFrame, k: int, limit: int | None = None) -> DataFrame:
    """(labels, base): unordered combinations of k (1 or 2) labels of different packages, for every base.

    In the order of first label, second label, base; limit keeps the first ones. How many combinations begin with a label
    follows from its place and from those of its package's labels, so that running totals tell which labels
    the first `limit` rows need; pairs are made for these only, and no two labels are compared beyond them.
    """
    one = labels.select("label").distinct().withColumn("package", F.split("label", "==")[0])
    placed = global_index(one, ["label"], "i")
    indexed = global_index(bases.select("base").distinct(), ["base"], "b")
    n_bases = indexed.count()
    if k == 1:
        firsts = placed.select("label", "package", "i", F.lit(1).cast("long").alias("n"))
    elif k == 2:
        n = placed.count()
        own = numbered(placed, "package", "label", "r").join(one.groupBy("package").agg(F.count("*").alias("versions")), "package")
        later = F.col("versions") - 1 - F.col("r")  # labels of the same package that come after this one
        firsts = own.withColumn("later", later).withColumn("n", F.lit(n) - 1 - F.col("i") - F.col("later"))
    else:
        raise ValueError("k is 1 or 2")
    summed = running_total(firsts, ["i"], "n", "upto").withColumn("before", F.col("upto") - F.col("n"))
    if limit is not None:
        most = -(-limit // max(1, n_bases))  # combinations that the first rows need
        summed = summed.where(F.col("before") < most).withColumn("n", F.least("n", F.lit(most) - F.col("before")))
    if k == 1:
        found = summed.select(F.col("label").alias("labels"), F.col("before").alias("place"))
    else:
        # The first n labels of other packages are among the next n + later ones.
        last = F.least(F.col("i") + F.col("n") + F.col("later"), F.lit(n - 1))
        asked = summed.where("n > 0").select(F.col("label").alias("first"), F.col("package").alias("own"), "n", "before", F.col("i").alias("at"), F.explode(F.sequence(F.col("i") + 1, last)).alias("i"))
        met = asked.join(placed, "i").where("own <> package")
        rank = F.row_number().over(Window.partitionBy("at").orderBy("i"))
        found = met.withColumn("q", rank).where("q <= n").select(F.concat_ws(",", "first", "label").alias("labels"), (F.col("before") + F.col("q") - 1).alias("place"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bases - 1).cast("long"))).alias("b") if n_bases else F.explode(F.array().cast("array<bigint>")).alias("b")
    rows = found.select("labels", "place", each)
    if limit is not None:
        rows = rows.where(F.col("place") * n_bases + F.col("b") < limit)
    return rows.join(indexed, "b").select("labels", "base")
