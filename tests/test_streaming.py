"""Streams across batches, restarts and replays."""

import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tagquarry.operators import stats
from tagquarry.streaming import jobs

from .oracle import DATA

CHANGES = "changeset_id long, changes array<string>"


def drop_last_commit(checkpoint):
    """As if the driver had died between a batch's output and its commit."""
    folder = f"{checkpoint}/commits"
    last = max(int(n) for n in os.listdir(folder) if n.isdigit())
    for n in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{folder}/{n}"):
            os.remove(f"{folder}/{n}")


def add(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_each_changeset_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def run(done=None):
        jobs.extract_stream(spark.readStream.schema(CHANGES).parquet(source), out, checkpoint, 1, done=done).awaitTermination()
        return sorted((r.instance_id, r.tag, r.cnt) for r in spark.read.parquet(out).collect())

    done = spark.createDataFrame([(9,)], "instance_id long")
    add(spark, [(1, ["foo/foobar"]), (1, ["foo/foobar"]), (9, ["zoom/zoomed"])], CHANGES, source)
    first = run(done)
    assert {r[0] for r in first} == {1} and (1, "foo", 2) in first
    add(spark, [(1, ["other/others"]), (2, ["bar/barn"])], CHANGES, source)
    second = run(done)  # a restart in between; id 1 comes again with other paths
    assert {r for r in second if r[0] == 1} == set(first) and {r[0] for r in second} == {1, 2}
    drop_last_commit(checkpoint)
    assert run(done) == second


def thresholds(loads, w, t, new, first, last, fill):
    a = d = 0.0
    out = {}
    for e in range(first, last + 1) if fill else sorted(loads):
        x = loads.get(e, 0)
        before, a = a, (1 - w) * a + w * x
        d = (1 - w) * d + w * abs(x - (a if new else before))
        out[e] = (x, a, d, a + t * d)
    return out


@pytest.mark.parametrize("against,missing", [("new", "zero"), ("old", "skip")])
def test_thresholds_of_a_live_load_equal_the_batch_after_restart_and_replay(spark, tmp_path, against, missing):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    # Model b is silent for a while and ends early; model a is busy to the end.
    seconds = [[(m, e * 60 + i) for m, n in (("a", e % 4 + 1), ("b", 3 if e in (0, 1, 5) else 0)) for i in range(n)] for e in range(20)]
    events = [x for e in seconds for x in e]

    def run():
        stream = spark.readStream.schema("model_id string, s long").option("maxFilesPerTrigger", 1).parquet(source)
        stream = stream.select("model_id", F.timestamp_seconds("s").alias("ts"))
        jobs.threshold_stream(stream, out, checkpoint, 60, 0.3, 2.0, against, missing, "2 minutes").awaitTermination()
        return {(r.model_id, r.epoch): (r.load, r.avg, r.dev, r.threshold) for r in spark.read.parquet(out).collect()}

    for part in (events[:7], events[7:30], events[30:]):
        add(spark, part, "model_id string, s long", source)
        got = run()
    drop_last_commit(checkpoint)
    assert run() == got
    loads = defaultdict(dict)
    for m, s in events:
        loads[m][s // 60] = loads[m].get(s // 60, 0) + 1
    closed = (events[-1][1] - 120) // 60 - 1
    want = {}
    for m in loads:
        known = {e: n for e, n in loads[m].items() if e <= closed}
        rows = thresholds(known, 0.3, 2.0, against == "new", min(known), closed, missing == "zero")
        want |= {(m, e): v for e, v in rows.items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    if missing == "skip":  # and the batch operator's last row
        rows = [(m, e, n) for m in loads for e, n in loads[m].items() if e <= closed]
        batch = stats.ewma_forecast(spark.createDataFrame(rows, "model_id string, epoch long, load long"), 0.3, 2.0, against)
        for r in batch.collect():
            assert (r.avg, r.dev, r.threshold) == pytest.approx(got[r.model_id, max(e for m, e in got if m == r.model_id)][1:])


def test_usage_state_stops_growing(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "instance_id long, tags map<string,long>, s long"
    used = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b")], "model_id long, tag string")
    for k in range(8):  # an hour each
        rows = [(100 * k + i, {"a": 1, "b": 2}, 10_000 + 3600 * k + i) for i in range(50)]
        add(spark, rows + rows[:10], schema, source)
    kept = []
    for event_time in ("ts", None):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).withColumn("ts", F.timestamp_seconds("s"))
        counts = jobs.usage_counts(stream.drop("s"), used, event_time, "1 hour")
        out = {}

        def each(batch, _, out=out):
            out.update({r.model_id: r.n_instances for r in batch.collect()})

        q = counts.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", str(tmp_path / f"cp-{event_time}")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert out == {0: 400, 1: 400}
        kept.append([max(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]])
    assert max(kept[0]) <= 300 and kept[1][-1] == 800


@pytest.mark.parametrize("name", ["t1_score_stream", "t4_usage_within"])
def test_tags_are_extracted_once(spark, monkeypatch, name):
    """The samples and the stumps of a query come from one extraction."""
    from tagquarry import fixtures, queries

    calls, extract = [], fixtures.instance_tag
    monkeypatch.setattr(fixtures, "instance_tag", lambda *a: (calls.append(a), extract(*a))[1])
    assert queries.QUERIES[name](spark, DATA).count() and len(calls) == 1
