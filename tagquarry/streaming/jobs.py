"""Structured Streaming jobs: tag extraction, scoring, epoch loads and their thresholds, expert usage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import experts, tags
from ..sources import files


def _sink(stream: DataFrame, each, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def extract_stream(
    changesets: DataFrame, out: str, checkpoint: str, freq_threshold: int = 2, once: bool = True, done: DataFrame | None = None
) -> StreamingQuery:
    """Tags of newly arrived changesets (changeset_id, changes array<string>), each changeset_id once.

    Ids that the stream has seen are its state: an id that comes again, in the same or a later batch, is skipped, also
    after a restart. done: (instance_id) of outputs from before this checkpoint, which are skipped as well. Each
    batch writes a folder of its own and overwrites it when it runs again, and Spark rolls the state back to that batch.
    The one exchange is that of the state; a changeset's tags are made where its row is.
    """
    fresh = changesets.dropDuplicates(["changeset_id"])
    if done is not None:
        fresh = files.skip_existing(fresh, done)

    def each(batch: DataFrame, batch_id: int) -> None:
        tags.extract_tags_of_lists(batch, freq_threshold).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _sink(fresh, each, checkpoint, once)


def score_stream(samples: DataFrame, stumps: DataFrame, out: str, checkpoint: str, once: bool = True, threshold: float = 0.5) -> StreamingQuery:
    """Predictions for arriving samples (instance_id, tags map<string,long>) by static models."""

    def each(batch: DataFrame, batch_id: int) -> None:
        long = batch.select("instance_id", F.explode("tags").alias("tag", "cnt"))
        experts.expert_inference(long, stumps, threshold).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _sink(samples, each, checkpoint, once)


def epoch_load(events: DataFrame, seconds: int = 900, late: str = "1 hour") -> DataFrame:
    """(model_id, epoch_start, load): counts per tumbling window; events: (model_id, ts)."""
    window = F.window("ts", f"{seconds} seconds")
    counts = events.withWatermark("ts", late).groupBy("model_id", window.alias("w")).agg(F.count("*").alias("load"))
    return counts.select("model_id", F.col("w.start").alias("epoch_start"), "load")


THRESHOLDS = "model_id string, epoch long, load long, avg double, dev double, threshold double"


class _Threshold(StatefulProcessor):
    """One model's average, deviation and last epoch; rows come once their epoch is closed."""

    def __init__(self, seconds: int, w: float, t: float, dev_against: str, missing: str):
        self.ms, self.w, self.t, self.new, self.fill = seconds * 1000, w, t, dev_against == "new", missing == "zero"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ewma", "epoch long, avg double, dev double, timer long")

    def _fold(self, key, loads: list[tuple[int, int]], until: int | None = None) -> pd.DataFrame:
        """The rows of these epochs, in order, and of the empty ones up to `until` where those count as no load."""
        last, avg, dev, timer = self.state.get() if self.state.exists() else (None, 0.0, 0.0, None)
        rows = []
        ends = [*loads, (until, None)] if until is not None else loads
        for epoch, load in ends:
            between = range(last + 1, epoch) if self.fill and last is not None else ()
            for e, x in [*((e, 0) for e in between), *([(epoch, load)] if load is not None else [])]:
                before, avg = avg, (1 - self.w) * avg + self.w * x
                dev = (1 - self.w) * dev + self.w * abs(x - (avg if self.new else before))
                rows.append((key[0], e, x, avg, dev, avg + self.t * dev))
                last = e
        if self.fill:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = (last + 2) * self.ms  # the end of the next epoch
            self.handle.registerTimer(timer)
        self.state.update((last, avg, dev, timer))
        return pd.DataFrame(rows, columns=["model_id", "epoch", "load", "avg", "dev", "threshold"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        loads = sorted(pair for part in rows for pair in zip(part["epoch"].tolist(), part["load"].tolist(), strict=True))
        yield self._fold(key, loads)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() // self.ms  # the first epoch that is still open
        yield self._fold(key, [], closed)

    def close(self) -> None:
        pass


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def threshold_stream(
    events: DataFrame, out: str, checkpoint: str, seconds: int = 900, w: float = 0.3, t: float = 3.0, dev_against: str = "new",
    missing: str = "zero", late: str = "1 hour", once: bool = True,
) -> StreamingQuery:
    """(model_id, epoch, load, avg, dev, threshold) for each closed epoch of each model; events: (model_id, ts).

    avg = (1 - w) avg + w load, dev likewise from |load - avg| against the average after ("new") or before ("old") the epoch,
    threshold = avg + t dev. Loads are counted with map-side combining, so that a model with most events is no hot task;
    the state holds four numbers a model. Epochs arrive in order, as windows close by the watermark. Epochs of a model
    without events count as no load once a later one closes or the watermark passes them (missing "zero"),
    or are left out ("skip"). Restarts go on from the checkpoint; a batch that runs again overwrites its folder.
    """
    epoch = F.floor(F.unix_seconds("epoch_start") / seconds)
    # window_time keeps the watermark's column through the aggregation.
    window = F.window("ts", f"{seconds} seconds")
    counts = events.withWatermark("ts", late).groupBy("model_id", window.alias("w")).agg(F.count("*").alias("load"))
    counts = counts.select("model_id", F.window_time("w").alias("at"), F.col("w.start").alias("epoch_start"), "load")
    loads = counts.select("model_id", "at", epoch.alias("epoch"), "load")
    processor = _Threshold(seconds, w, t, dev_against, missing)
    rows = loads.groupBy("model_id").transformWithStateInPandas(processor, THRESHOLDS, "Append", "EventTime" if missing == "zero" else "None")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    # Keyed state needs RocksDB; a query keeps the setting that it was started with.
    conf = events.sparkSession.conf
    before = conf.get(ROCKS[0])
    conf.set(*ROCKS)
    try:
        return _sink(rows, each, checkpoint, once)
    finally:
        conf.set(ROCKS[0], before)


def usage_counts(samples: DataFrame, used: DataFrame, event_time: str | None = None, within: str = "1 hour") -> DataFrame:
    """(model_id, n_instances) as a running count; samples: (instance_id, tags map<string,long>).

    With event_time, a column of samples, a pair (model, instance) is remembered for `within` only: what comes again later counts
    anew, and the state is bounded by the pairs of that time. Without it every distinct pair is kept for good.
    """
    if event_time:
        samples = samples.withWatermark(event_time, within)
    own = [event_time] if event_time else []
    long = samples.select("instance_id", *own, F.explode(F.map_keys("tags")).alias("tag"))
    pairs = long.join(used.select("model_id", "tag"), "tag")
    pairs = pairs.dropDuplicatesWithinWatermark(["model_id", "instance_id"]) if event_time else pairs.dropDuplicates(["model_id", "instance_id"])
    return pairs.groupBy("model_id").agg(F.count("*").alias("n_instances"))
