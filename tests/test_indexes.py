"""Operators that look things up by an index instead of comparing all with all."""

import itertools
import random

import duckdb
from pyspark.sql import functions as F

from tagquarry.operators import catalog, encode, filters, split, stats
from tagquarry.queries import QUERIES, SQL
from tagquarry.sources import files

from .oracle import DATA, oracle_rows, rows_of


def test_combinations_by_rank_equal_all_pairs(spark):
    r = random.Random(4)
    labels = sorted({f"{r.choice(['a', 'a-b', 'b', 'c', 'hot', 'hot', 'hot'])}=={r.randint(0, 30)}" for _ in range(40)})
    df = spark.createDataFrame([(x,) for x in labels + labels[:5]], "label string").repartition(5)
    bases = spark.createDataFrame([("u",), ("d",), ("u",)], "base string")
    pairs = [(x, y) for x, y in itertools.combinations(labels, 2) if x.split("==")[0] != y.split("==")[0]]
    whole = [(f"{x},{y}", b) for x, y in sorted(pairs) for b in ("d", "u")]
    for limit in (None, 1, 7, 100, 10**9):
        got = sorted(map(tuple, catalog.combinations(df, bases, 2, limit).collect()))
        assert got == sorted(whole[:limit])
    ones = [(x, b) for x in labels for b in ("d", "u")]
    assert sorted(map(tuple, catalog.combinations(df, bases, 1, 9).collect())) == sorted(ones[:9])
    assert catalog.combinations(df, bases.limit(0), 2, 9).count() == 0 and catalog.combinations(df.limit(0), bases, 2, 9).count() == 0


def test_only_the_pairs_of_the_limit_are_made(spark):
    df = spark.range(3000).select(F.concat_ws("==", F.concat(F.lit("p"), (F.col("id") % 1000).cast("string")), F.col("id").cast("string")).alias("label"))
    out = catalog.combinations(df, spark.createDataFrame([("u",)], "base string"), 2, 50)
    assert out.count() == 50  # of four million


def test_substring_index_equals_contains(spark):
    r = random.Random(7)
    text = lambda n: "".join(r.choice("abcé ") for _ in range(n))
    features = [text(r.randint(0, 12)) for _ in range(200)]
    for sizes in ((1, 2), (3, 6), (1, 5), (0, 0)):
        tags = [text(r.randint(*sizes)) for _ in range(8)] + ["zz", None]
        f = spark.createDataFrame([(x,) for x in features + [None]], "feature string")
        t = spark.createDataFrame([(x,) for x in tags], "tag string")
        got = {x.feature for x in files.holding_any(f, t).collect()}
        assert got == {x for x in features if any(y in x for y in tags if y is not None)}
    plan = files.holding_any(f, t.where("tag <> ''"))._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_saving_an_index_again(spark, tmp_path):
    path = str(tmp_path / "index")
    one = spark.createDataFrame([("a", 0), ("b", 1)], "tag string, idx long")
    for rows, model in ((one, "x"), (one, "x"), (one.limit(1), "y"), (one, "x")):
        encode.save_index(rows, path, model)
    assert sorted(map(tuple, encode.load_index(spark, path, "x").collect())) == [("a", 0), ("b", 1)]
    assert encode.load_index(spark, path, "y").count() == 1


def test_prediction_dumps_are_in_order(spark, tmp_path):
    said = spark.createDataFrame([(3, "b"), (3, "a"), (1, "c")], "instance_id long, label string")
    names = spark.createDataFrame([(i, f"n{i}.tag") for i in (3, 1, 2)], "instance_id long, name string")
    files.dump_predictions(said, names, str(tmp_path / "out"))
    lines = lambda part: [x for f in sorted((tmp_path / "out" / part).glob("part-*")) for x in f.read_text().splitlines()]
    assert lines("names") == ["n1.tag", "n2.tag", "n3.tag"] and lines("lists") == ["['c']", "[]", "['a', 'b']"]
    assert spark.read.json(str(tmp_path / "out" / "labels")).count() == 3


def test_durations_by_phase(spark):
    rows = [("a-x", "Succeeded", 0, 9), ("b-x", "Failed", 1, 2), ("c-x", "Running", 0, 5), ("d-x", "Succeeded", None, 5), ("e-x", "Failed", 3, None), ("f-y", "Succeeded", 0, 1)]
    df = spark.createDataFrame(rows, "name string, phase string, a long, b long")
    pods = df.select("name", "phase", F.timestamp_seconds("a").alias("start"), F.timestamp_seconds("b").alias("end"))
    got = {r.stage: (r.n, r.mean_seconds, r.unfinished) for r in stats.stage_durations(stats.run_seconds(pods), ["-x", "-y"]).collect()}
    assert got == {"-x": (2, 5.0, 3), "-y": (1, 1.0, 0)}


def test_regular_members_and_stratified_tables(spark, tmp_path):
    members = spark.createDataFrame([("lib/a", True), ("lib/b", False), ("lib/cache/c", True), ("d", True)], "path string, is_file boolean")
    assert [r.path for r in filters.site_package_files(members, "lib/").collect()] == ["lib/a"]
    rows = spark.createDataFrame([("x", i) for i in range(5)] + [("y", 0)], "label string, instance_id long")
    split.write_stratified(rows, str(tmp_path), 2, 4)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "test")).collect()} == {("x", 0), ("x", 1), ("y", 0)}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "train")).collect()} == {("x", 2), ("x", 3)}


def test_histogram_of_occurrences(spark):
    vec = spark.createDataFrame([("a", 0, 1), ("b", 0, 2), ("c", 0, 1), ("a", 2, 1), ("b", 3, 0)], "label string, idx int, cnt int")
    per = stats.feature_occurrence(vec)
    assert {(r.n_labels, r.n_features) for r in stats.occurrence_histogram(per).collect()} == {(0, 2), (1, 1), (2, 0), (3, 1)}
    chosen = stats.feature_occurrence(vec, spark.createDataFrame([("a",), ("b",)], "label string"))
    assert {(r.n_labels, r.n_features) for r in stats.occurrence_histogram(chosen, fill=False).collect()} == {(0, 2), (1, 1), (2, 1)}


def test_readable_weights_list_every_matching_weight(spark):
    r = random.Random(6)
    own = [(r.choice(["ab", "b", "xa", "zz"]), r.choice([0, 1, 1]), r.choice([-2.5, -1.0, 0.0, 0.25, 3.0])) for _ in range(300)]
    lines = spark.createDataFrame([(f"{f}[{c}]:{w}",) for f, c, w in own], "value string").repartition(5)
    tags = spark.createDataFrame([("a",), ("x",)], "tag string")
    want = sorted(w for f, c, w in own if c == 1 and ("a" in f or "x" in f))
    (got,) = files.readable_weights(lines, tags, 1).collect()
    assert (got.n, got.total, got.positives, got.weights) == (len(want), sum(want), sum(w > 0 for w in want), want)
    (none,) = files.readable_weights(lines, tags, 7).collect()
    assert (none.n, none.total, none.positives, none.weights) == (0, None, 0, [])


def test_readable_weights_of_empty_and_repeated_parts_equal_the_sql(spark, tmp_path):
    part = spark.read.parquet(f"{DATA}/part.parquet")
    for name, rows in (("none", part.limit(0)), ("thrice", part.union(part).union(part))):
        rows.write.parquet(str(tmp_path / name / "part.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path / name}/part.parquet/*.parquet'")
        names, got = rows_of(QUERIES["s15_readable_weights"](spark, str(tmp_path / name)))
        assert "weights" in names and (names, got) == oracle_rows(con, SQL["s15_readable_weights"])
