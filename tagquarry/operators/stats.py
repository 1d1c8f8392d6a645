"""Distributions of tags, labels, models, costs and run times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import global_index, materialize, running_total
from .labels import combinations


def recurrence_histogram(tag_df: DataFrame, by: list | None = None) -> DataFrame:
    """(k, n_tags, share): how many tags occur in k label sets, with the share in % to two places."""
    by = by or []
    per = tag_df.groupBy(*by, F.col("n_labels").alias("k")).agg(F.count("*").alias("n_tags"))
    return per.withColumn("share", F.round(100 * F.col("n_tags") / F.sum("n_tags").over(Window.partitionBy(*by)), 2))


def combination_lengths(instance_label: DataFrame) -> DataFrame:
    return combinations(instance_label).groupBy("n_labels").agg(F.count("*").alias("n"))


def combination_counts(instance_label: DataFrame) -> DataFrame:
    return combinations(instance_label).groupBy("label_key").agg(F.count("*").alias("n"))


def mean_tags_per_combination(tags: DataFrame, instance_label: DataFrame) -> DataFrame:
    n = tags.groupBy("instance_id").agg(F.count("*").alias("n_tags"))
    keys = combinations(instance_label).select("instance_id", "label_key")
    return keys.join(n, "instance_id", "left").groupBy("label_key").agg(F.avg(F.coalesce("n_tags", F.lit(0))).alias("mean_tags"))


def recurrence_per_model(tags: DataFrame, instance_label: DataFrame, model_label: DataFrame) -> DataFrame:
    """(model_id, k, n_tags, share) inside each model's labels."""
    own = instance_label.join(model_label, "label").select("model_id", "instance_id", "label")
    freq = tags.join(own, "instance_id").groupBy("model_id", "tag").agg(F.count_distinct("label").alias("n_labels"))
    return recurrence_histogram(freq, ["model_id"])


def feature_occurrence(vec: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(idx, n_labels): labels with a positive mean of the feature; features of the index range in none are 0.

    labels: (label) restricts the count to chosen labels, over the same features.
    """
    counted = vec if labels is None else vec.join(labels.select("label").distinct(), "label", "left_semi")
    positive = counted.where("cnt > 0").groupBy("idx").agg(F.count_distinct("label").alias("n_labels"))
    span = vec.agg(F.min("idx").alias("a"), F.max("idx").alias("b")).select(F.explode(F.sequence("a", "b")).alias("idx"))
    return span.join(positive, "idx", "left").select("idx", F.coalesce("n_labels", F.lit(0)).alias("n_labels"))


def occurrence_histogram(occurrence: DataFrame, fill: bool = True) -> DataFrame:
    """(n_labels, n_features): how many features are in so many labels; with fill every number from the least to the most."""
    per = occurrence.groupBy("n_labels").agg(F.count("*").alias("n_features"))
    if not fill:
        return per
    span = per.agg(F.min("n_labels").alias("a"), F.max("n_labels").alias("b")).where("a IS NOT NULL")
    span = span.select(F.explode(F.sequence("a", "b")).alias("n_labels"))  # at most one row a label
    return span.join(per, "n_labels", "left").select("n_labels", F.coalesce("n_features", F.lit(0)).alias("n_features"))


def trial_stats(trials: DataFrame) -> DataFrame:
    """(key, mean, two_std, confidence): population deviation; 95 % interval of the mean."""
    std = F.stddev_pop("value")
    return trials.groupBy("key").agg(
        F.avg("value").alias("mean"), (2 * std).alias("two_std"), (1.96 * std / F.sqrt(F.count("*"))).alias("confidence")
    )


def combined_error(stats: DataFrame) -> DataFrame:
    """One row: the errors (two_std) added in quadrature, as one deviation."""
    return stats.agg(F.sqrt(F.sum(F.col("two_std") * F.col("two_std") / 4)).alias("error"))


def cost_range(costs: DataFrame, truth: DataFrame) -> DataFrame:
    """(true_idx, label_idx, low, high); truth: (instance_id, true_idx)."""
    return costs.join(truth, "instance_id").groupBy("true_idx", "label_idx").agg(F.min("cost").alias("low"), F.max("cost").alias("high"))


def left_true_right(costs: DataFrame, truth: DataFrame) -> DataFrame:
    """(true_idx, left_mean, true_mean, right_mean): mean cost of classes before, at and after it; null if none."""
    side = lambda c: F.avg(F.when(c, F.col("cost")))
    a, b = F.col("label_idx"), F.col("true_idx")
    return costs.join(truth, "instance_id").groupBy("true_idx").agg(
        side(a < b).alias("left_mean"), side(a == b).alias("true_mean"), side(a > b).alias("right_mean")
    )


def cost_matrix(costs: DataFrame, truth: DataFrame) -> DataFrame:
    """(true_idx, label_idx, mean_cost) in long form."""
    return costs.join(truth, "instance_id").groupBy("true_idx", "label_idx").agg(F.avg("cost").alias("mean_cost"))


def change_histogram(files: DataFrame) -> DataFrame:
    """(offset, n): files per whole second since the first change."""
    first = files.agg(F.min("ts").alias("_first"))
    at = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("_first").cast("timestamp"))
    return files.crossJoin(F.broadcast(first)).groupBy(at.alias("offset")).agg(F.count("*").alias("n"))


def run_seconds(pods: DataFrame) -> DataFrame:
    """pods (name, phase, start, end) with seconds: end minus start of those that have started, have an end and are
    Succeeded or Failed; null for all others, which stage_durations reports as unfinished."""
    finished = F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("phase").isin("Succeeded", "Failed")
    length = (F.unix_micros("end") - F.unix_micros("start")) / 1_000_000
    return pods.withColumn("seconds", F.when(finished, length))


def stage_durations(stages: DataFrame, suffixes: list[str]) -> DataFrame:
    """(stage, n, mean_seconds, unfinished): by name suffix; only rows with an end count as finished."""
    stage = F.lit(None).cast("string")
    for s in sorted(suffixes, key=len):
        stage = F.when(F.endswith("name", F.lit(s)), F.lit(s)).otherwise(stage)
    done = F.col("seconds").isNotNull()
    return stages.withColumn("stage", stage).where("stage IS NOT NULL").groupBy("stage").agg(
        F.count_if(done).alias("n"), F.avg("seconds").alias("mean_seconds"), F.count_if(~done).alias("unfinished")
    )


def runtime_rollup(times: DataFrame) -> DataFrame:
    """(key, totals): per key the totals over experts, listed by trial."""
    per = times.groupBy("trial", "key").agg(F.sum("value").alias("total"))
    rows = F.sort_array(F.collect_list(F.struct("trial", "total")))
    return per.groupBy("key").agg(F.array_join(F.transform(rows, lambda r: r["total"].cast("string")), ",").alias("totals"))


#: Epochs, or blocks of epochs, that one row holds.
SERIES_BLOCK = 1024


def affine_starts(maps: DataFrame, key: str) -> DataFrame:
    """(key, pos, start): what x has become before each pos, from 0 on, if every pos maps x to m * x + c.

    maps: (key, pos from 0, m, c). Maps compose to maps, so that runs of SERIES_BLOCK become one each, and their starts are
    found first in the same way: a series of n takes log(n) / log(SERIES_BLOCK) steps, and no row holds more than a run.
    """
    run = F.floor(F.col("pos") / SERIES_BLOCK)
    runs = maps.groupBy(key, run.alias("run")).agg(F.sort_array(F.collect_list(F.struct("pos", "m", "c"))).alias("xs"))
    whole = F.aggregate("xs", F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("c")), lambda s, x: F.struct((s["m"] * x["m"]).alias("m"), (s["c"] * x["m"] + x["c"]).alias("c")))
    runs = materialize(runs.withColumn("whole", whole))
    if (runs.agg(F.max("run")).first()[0] or 0) > 0:
        above = affine_starts(runs.select(key, F.col("run").alias("pos"), "whole.m", "whole.c"), key)
        runs = runs.join(above.withColumnRenamed("pos", "run"), [key, "run"])
    else:
        runs = runs.withColumn("start", F.lit(0.0))
    first = F.struct(F.col("start").alias("x"), F.array().cast("array<double>").alias("starts"))
    walked = F.aggregate("xs", first, lambda s, x: F.struct((s["x"] * x["m"] + x["c"]).alias("x"), F.concat(s["starts"], F.array(s["x"])).alias("starts")))
    rows = runs.select(key, F.explode(F.arrays_zip(F.col("xs.pos").alias("pos"), walked["starts"].alias("start"))).alias("r"))
    return rows.select(key, "r.pos", "r.start")


def ewma_forecast(load: DataFrame, w: float, t: float, dev_against: str = "new") -> DataFrame:
    """(model_id, n_epochs, avg, dev, threshold): avg = (1-w) avg + w x over the epochs in order.

    dev is smoothed like avg from |x - avg|, against the average before ("old") or after ("new")
    the step; threshold is avg + t * dev. Rows without a model_id, an epoch or a load are left out.

    A step maps avg to (1-w) avg + w x, so that runs of epochs are folded by themselves, in as many tasks as there are, and only
    one pair of numbers a run is combined in order. With the average at the start of each run known, a second
    pass folds the deviations in the same way. A series may have any length.
    """
    rows = load.select("model_id", "epoch", F.col("load").cast("double").alias("load")).dropna()
    indexed = global_index(rows, ["model_id", "epoch", "load"], "_i")
    first = indexed.groupBy("model_id").agg(F.min("_i").alias("_first"), F.count("*").alias("n_epochs"))
    placed = indexed.join(first, "model_id").withColumn("pos", F.col("_i") - F.col("_first"))
    runs = placed.groupBy("model_id", "n_epochs", F.floor(F.col("pos") / SERIES_BLOCK).alias("run")).agg(F.sort_array(F.collect_list(F.struct("pos", "load"))).alias("xs"))

    def step(s, x):
        a = (1 - w) * s["a"] + w * x["load"]
        return F.struct(a.alias("a"), ((1 - w) * s["d"] + w * F.abs(x["load"] - (a if dev_against == "new" else s["a"]))).alias("d"))

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("d"))
    decay = F.pow(F.lit(1 - w), F.size("xs"))
    runs = materialize(runs.withColumn("m", decay).withColumn("c", F.aggregate("xs", zero, step)["a"]))
    starts = affine_starts(runs.select("model_id", F.col("run").alias("pos"), "m", "c"), "model_id")
    known = runs.join(starts.withColumnRenamed("pos", "run"), ["model_id", "run"])
    ended = F.aggregate("xs", F.struct(F.col("start").alias("a"), F.lit(0.0).alias("d")), step)
    folded = materialize(known.select("model_id", "n_epochs", "run", "m", ended.alias("s")))
    before = affine_starts(folded.select("model_id", F.col("run").alias("pos"), "m", F.col("s.d").alias("c")), "model_id")
    # The last run of a series ends with its last epoch.
    last = folded.where((F.col("run") + 1) * SERIES_BLOCK >= F.col("n_epochs")).join(before.withColumnRenamed("pos", "run"), ["model_id", "run"])
    avg, dev = F.col("s.a"), F.col("start") * F.col("m") + F.col("s.d")
    return last.select("model_id", "n_epochs", avg.alias("avg"), dev.alias("dev"), (avg + t * dev).alias("threshold"))


def empirical_cdf(values: DataFrame) -> DataFrame:
    """(value, n, cdf): one row per distinct value."""
    per = values.groupBy("value").agg(F.count("*").alias("n"))
    summed = running_total(per, ["value"], "n", "_upto")
    whole = summed.agg(F.max("_upto").alias("_all"))
    return summed.crossJoin(F.broadcast(whole)).select("value", "n", (F.col("_upto") / F.col("_all")).alias("cdf"))  # one row


def decile_bins(values: DataFrame) -> DataFrame:
    """(bin, n, low, high): bins at the ten percent points (linear interpolation)."""
    indexed = global_index(values.where("value IS NOT NULL"), ["value"], "_i")
    last = indexed.count() - 1
    asked = [i * last / 10 for i in range(1, 10)] if last >= 0 else []
    at = {int(x) for p in asked for x in (p // 1, -(-p // 1))}
    found = dict(indexed.where(F.col("_i").isin(*at)).select("_i", "value").collect()) if at else {}  # 18 rows at most
    cuts = [found[int(p // 1)] + (p % 1) * (found[int(-(-p // 1))] - found[int(p // 1)]) for p in asked]
    bin_ = sum((F.when(F.col("value") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    return values.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def slowest_models(times: DataFrame, n: int = 20) -> DataFrame:
    """(model_id, value, cdf) of the n slowest models."""
    whole = times.agg(F.count("value").alias("_all"))
    top = times.orderBy(F.desc("value"), "model_id").limit(n).crossJoin(F.broadcast(whole))  # one row
    # All rows above one of these n are among them, so that the window runs over n rows.
    above = F.rank().over(Window.orderBy(F.desc("value"))) - 1
    return top.withColumn("cdf", (F.col("_all") - above) / F.col("_all")).drop("_all")


def vocabulary_union(a: DataFrame, b: DataFrame, bag: bool = False) -> DataFrame:
    both = a.select("tag").union(b.select("tag"))
    return both if bag else both.distinct()


def vocabulary_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("tag").subtract(b.select("tag"))


def tag_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("tag").intersect(b.select("tag"))


