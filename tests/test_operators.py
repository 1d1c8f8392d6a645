"""Edge rules and brute-force restatements of operators that SQL does not cover."""

import io
import json
import math
import random
import statistics
import tarfile
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tagquarry.functions.components import connected_components
from tagquarry.functions.tables import global_index
from tagquarry.operators import encode, experts, filters, layers, metrics, rank, similarity, split, stats, tags, train
from tagquarry.sources import files

from .oracle import DATA


def brute_tags(paths, threshold):
    freq, kids = defaultdict(int), defaultdict(set)
    for path in paths:
        for token in path.split("/"):
            if token in tags.STOP_TOKENS:
                continue
            token = token.replace(":", "").replace("|", "")
            for n in range(3, len(token) + 1):
                freq[token[:n]] += 1
                if n < len(token):
                    kids[token[:n]].add(token[: n + 1])
    return {p: c for p, c in freq.items() if len(kids[p]) >= threshold}


def test_extract_tags_matches_brute_force(spark):
    r = random.Random(1)
    parts = ["usr", "lib", "python", "pytest", "pyth:on", "numpy", "num|py", "ab", "", "été", "étéx", "share", "shared"]
    sets = {i: ["/".join(r.choice(parts) for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 9))] for i in range(12)}
    df = spark.createDataFrame([(i, p) for i, ps in sets.items() for p in ps], "changeset_id long, path string")
    for threshold in (1, 2):
        got = {(x.instance_id, x.tag): x.cnt for x in tags.extract_tags(df, threshold).collect()}
        assert got == {(i, t): c for i, ps in sets.items() for t, c in brute_tags(ps, threshold).items()}
        lists = spark.createDataFrame([(i, [*ps, None]) for i, ps in sets.items()] + [(99, None)], "changeset_id long, changes array<string>")
        made = tags.extract_tags_of_lists(lists, threshold)
        assert {(x.instance_id, x.tag): x.cnt for x in made.collect()} == got
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_leaves_and_stop_words(spark):
    df = spark.createDataFrame([(1, "usr/bin/foobar"), (1, "foo"), (1, None)], "changeset_id long, path string")
    got = {(x.tag, x.cnt) for x in tags.extract_tags(df, 1).collect()}
    assert got == {("foo", 2), ("foob", 1), ("fooba", 1)}


def test_filter_comparators(spark):
    t = spark.createDataFrame([(1, "a", 3), (2, "b", 1)], "instance_id long, tag string, cnt long")
    df = spark.createDataFrame([("a", 5)], "tag string, n_labels long")
    assert [r.tag for r in filters.filter_by_frequency(t, df, 5).collect()] == ["b"]
    assert filters.filter_by_frequency(t, df, 6).count() == 2
    assert filters.remove_tags_by_total(t, 3).count() == 2
    assert [r.tag for r in filters.remove_tags_by_total(t, 2).collect()] == ["b"]


def test_global_index_is_dense(spark):
    df = spark.range(1000).withColumn("h", F.md5(F.col("id").cast("string"))).repartition(7)
    rows = global_index(df, ["h"]).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(1000)) and [r.h for r in rows] == sorted(r.h for r in rows)


def test_index_and_append(spark):
    v = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "tag string")
    known = encode.assign_index(v, "tag")
    more = encode.append_index(known, spark.createDataFrame([("0",), ("a",), ("z",)], "tag string"), "tag")
    assert {(r.tag, r.idx) for r in more.collect()} == {("a", 0), ("b", 1), ("0", 2), ("z", 3)}
    empty = encode.append_index(known.limit(0), v.dropna(), "tag")
    assert {(r.tag, r.idx) for r in empty.collect()} == {("a", 0), ("b", 1)}


def test_colliding_tags(spark):
    t = spark.createDataFrame([(1, "a", 3), (1, "b", 5), (2, "c", 7)], "instance_id long, tag string, cnt long")
    vocab = spark.createDataFrame([("a", 0), ("b", 2), ("c", 1)], "tag string, idx long")
    got = {(r.instance_id, r.idx, r.value) for r in encode.encode_features(t, vocab, input_size=2).collect()}
    assert got == {(1, 0, 5.0), (2, 1, 7.0)}


def test_folds_partition(spark):
    rows = spark.range(50).select(F.col("id").alias("instance_id"), (F.col("id") % 3).cast("string").alias("label"))
    folds = split.random_folds(rows, 4, 1).groupBy("fold").count().collect()
    assert sum(r["count"] for r in folds) == 50 and {r["count"] for r in folds} <= {12, 13}
    assert sorted(map(tuple, split.random_folds(rows, 4, 1).collect())) == sorted(map(tuple, split.random_folds(rows.repartition(5), 4, 1).collect()))
    groups = split.random_groups(spark.range(11).select(F.col("id").cast("string").alias("label")), 4, 4)
    assert groups.select("model_id").distinct().count() == 6  # a remainder makes more groups


def brute_density(costs, eps):
    order = sorted((c, label) for label, c in costs)
    clusters = []
    for c, label in order:
        if clusters and c - clusters[-1][-1][0] <= eps:
            clusters[-1].append((c, label))
        else:
            clusters.append([(c, label)])
    best = max(range(len(clusters)), key=lambda i: (i * len(clusters[i]), i))
    return {label for i in range(best) for _, label in clusters[i]}


def test_density_cut_matches_brute_force(spark):
    r = random.Random(2)
    data = {i: [(k, r.randint(0, 20) / 20) for k in range(r.randint(1, 12))] for i in range(40)}
    df = spark.createDataFrame([(i, k, c) for i, cs in data.items() for k, c in cs], "instance_id long, label_idx long, cost double")
    got = {(x.instance_id, x.label_idx) for x in rank.density_cut(df, 0.07).collect()}
    assert got == {(i, k) for i, cs in data.items() for k in brute_density(cs, 0.07)}


def brute_leaders(n, edges):
    seen, out = set(), {}
    for i in range(n):
        if i not in seen:
            for j in range(n):
                if j not in seen and (j == i or (min(i, j), max(i, j)) in edges):
                    out[j] = i
                    seen.add(j)
    return out


@pytest.mark.parametrize("most", [similarity.MOST_LINKS, 3])
def test_leader_clusters_match_the_greedy_order(spark, monkeypatch, most):
    monkeypatch.setattr(similarity, "MOST_LINKS", most)
    r = random.Random(3)
    for n, share in ((12, 0.2), (25, 0.1), (30, 0.3)) if most > 3 else ((25, 0.06),):
        edges = {(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < share}
        pairs = spark.createDataFrame([(a, b, 0.95) for a, b in edges], "a long, b long, cosine double")
        got = {x.id: x.leader for x in similarity.leader_clusters(pairs, spark.range(n)).collect()}
        assert got == brute_leaders(n, edges)


def test_leaders_of_a_long_chain(spark):
    """A hundred thousand items, each next to the one before: every other one leads."""
    n = 100_000
    pairs = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(0.95).alias("cosine"))
    out = similarity.leader_clusters(pairs, spark.range(n))
    assert out.count() == n and out.where("leader <> id - id % 2").count() == 0


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(5, 5), (None, 1)]
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for x in sorted(near):
        stack = [x] if x not in want else []
        while stack:
            y = stack.pop()
            if y not in want:
                want[y] = x
                stack += near[y]
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = connected_components(df).collect()
    assert {y.node: y.component for y in got} == want and len(got) == len(want)
    assert connected_components(df.limit(0)).count() == 0


def test_history_by_key_presence(spark):
    history = spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", False), (1, 2, "c", None)], "image long, pos int, created_by string, empty_layer boolean")
    own = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "z")], "image long, k int, layer string")
    got = {r.layer: r.created_by for r in layers.align_history(own, history).collect()}
    assert got == {"x": "a", "y": "c", "z": None}
    assert [r.layer for r in layers.unaligned_layers(own, history).collect()] == ["z"]


def test_metrics_of_unsupported_labels(spark):
    t = spark.createDataFrame([(1, "a"), (1, "a")], "instance_id long, label string")
    p = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "instance_id long, label string")
    r = {x.label: x for x in metrics.label_report(t, p).collect()}
    assert r["a"].f1 == 1 and r["b"].f1 == 0 and r["b"].support == 0
    a = metrics.averages(metrics.label_report(t, p)).first()
    assert math.isclose(a.f1_macro, 1 / 3) and a.f1_weighted == 1 and math.isclose(a.precision_micro, 1 / 3)
    kinds = {x.kind: (x.n, x.accuracy) for x in metrics.exact_match(t, p).collect()}
    assert kinds == {"single": (1, 0.0), "multi": (1, 0.0)}  # (a, a) is not (a)
    kinds = {x.kind: (x.n, x.accuracy) for x in metrics.exact_match(t, t).collect()}
    assert kinds == {"multi": (1, 100.0)}
    assert metrics.set_scores(t, p).first().accuracy == 0.5


def test_predictions_by_row_numbers(spark):
    rows = spark.createDataFrame([(0, 0, 7), (0, 1, 9), (1, 0, 9)], "model_id long, row long, instance_id long")
    said = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "b"), (1, 5, "c")], "model_id long, row long, label string")
    got = experts.merge_predictions(experts.to_instances(said, rows)).collect()
    assert {r.instance_id: r.labels for r in got} == {7: ["a"], 9: ["b", "b"]}


def test_single_task_free_statistics(spark):
    r = random.Random(6)
    values = [r.random() for _ in range(200)] + [0.5] * 30
    df = spark.createDataFrame([(v,) for v in values], "value double").repartition(5)
    for x in stats.empirical_cdf(df).collect():
        assert math.isclose(x.cdf, sum(v <= x.value for v in values) / len(values)) and x.n == values.count(x.value)
    cuts = statistics.quantiles(values, n=10, method="inclusive")
    want = Counter(sum(c < v for c in cuts) for v in values)
    assert {x.bin: x.n for x in stats.decile_bins(df).collect()} == want
    assert stats.decile_bins(df.limit(0)).count() == 0 and stats.empirical_cdf(df.limit(0)).count() == 0
    times = spark.createDataFrame([(i, float(i // 3)) for i in range(50)], "model_id long, value double")
    for x in stats.slowest_models(times, 7).collect():
        assert math.isclose(x.cdf, sum(i // 3 <= x.value for i in range(50)) / 50)


def test_folds_of_a_frequent_label(spark):
    rows = [(i, "hot" if i % 4 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "instance_id long, label string").repartition(6)
    seen, want = Counter(), {}
    for i, label in rows:
        want[i] = seen[label] % 3
        seen[label] += 1
    assert {x.instance_id: x.fold for x in split.stratified_folds(df, 3).collect()} == want


def test_boosting_learns_and_continues(spark):
    il = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(40)], "instance_id long, label string")
    t = spark.createDataFrame([(i, "tx" if i % 2 else "ty", 1) for i in range(40)], "instance_id long, tag string, cnt long")
    models = spark.createDataFrame([("x", 0), ("y", 0)], "label string, model_id long")
    stumps = train.train_stumps(t, il, models, rounds=8, rate=0.5)
    pred = experts.expert_inference(t, stumps)
    # both labels split on tx, so that the instances without it are skipped by the selector
    got = {(r.instance_id, r.label) for r in pred.collect()}
    assert got == {(i, "x") for i in range(40) if i % 2}
    half = train.train_stumps(t, il, models, rounds=4, rate=0.5)
    whole = train.train_stumps(t, il, models, rounds=4, start=half, rate=0.5)
    key = lambda df: sorted((r.label, r.round, r.tag, round(r.leaf_high, 9)) for r in df.collect())
    assert key(whole) == key(stumps)


def test_settings_of_a_cross_validation_do_not_touch_one_another(spark):
    r = random.Random(9)
    il = spark.createDataFrame([(i, f"p{i % 3}==v{i % 2}") for i in range(60)], "instance_id long, label string")
    rows = [(i, t, r.randint(1, 3)) for i in range(60) for t in {f"t{i % 6}", f"u{i % 3}", f"v{r.randrange(9)}"}]
    t = spark.createDataFrame(rows, "instance_id long, tag string, cnt long")
    grid = [{"n_models": 1, "freq": None, "rounds": 3}, {"n_models": 3, "freq": 5, "batch": 1, "grouping": "random"}, {"n_models": 2, "freq": None, "n_samples": 4}]
    whole = {x.run_id: x.asDict() | {"run_id": 0} for x in train.cross_validate(t, il, grid, 8, 0.25, rounds=2).collect()}
    for run, g in enumerate(grid):
        alone = train.cross_validate(t, il, [g], 8, 0.25, rounds=2).first().asDict()
        assert all(math.isclose(whole[run][k], alone[k], abs_tol=1e-12) for k in alone)
    assert whole[0]["f1_weighted"] > 0.5


def test_min_weight_blocks_small_splits(spark):
    il = spark.createDataFrame([(i, "x" if i < 3 else "y") for i in range(6)], "instance_id long, label string")
    t = spark.createDataFrame([(i, "a" if i < 3 else "b", 1) for i in range(6)], "instance_id long, tag string, cnt long")
    models = spark.createDataFrame([("x", 0), ("y", 0)], "label string, model_id long")
    assert train.train_stumps(t, il, models, rounds=1).count() == 0
    assert train.train_stumps(t, il, models, rounds=1, min_weight=0.5).count() == 2


def test_cost_model_separates_labels(spark):
    il = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(30)], "instance_id long, label string")
    t = spark.createDataFrame([(i, "t" + "xyz"[i % 3], 1) for i in range(30)], "instance_id long, tag string, cnt long")
    x = train.hashed_features(t)
    scores = train.predict_costs(x, train.train_costs(x, il, rounds=4))
    low = rank.top_k_labels(scores.select("instance_id", F.col("label").alias("label_idx"), F.col("score").alias("cost")), il.groupBy("instance_id").agg(F.count("*").alias("k")))
    assert {(r.instance_id, r.label_idx) for r in low.collect()} == {(r.instance_id, r.label) for r in il.collect()}
    best = train.best_label(train.predict_costs(x, train.train_costs(x, il, rounds=4, loss="logistic")))
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, il.collect()))


def test_read_tagsets_and_rejects(spark, tmp_path):
    (tmp_path / "a.tag").write_text("labels: [x, y]\ntags: {foo: 2, bar: 1}\n")
    (tmp_path / "b.tag").write_text("label: z\ntags: ['foo:2', 'foo:3', 'q']\n")
    (tmp_path / "c.tag").write_text("labels: [x\n")
    (tmp_path / "d.tag").write_text("labels: [x]\n")
    good, bad = files.read_tagsets(spark, str(tmp_path))
    got = {tuple(r.labels): r.tags for r in good.collect()}
    assert got == {("x", "y"): {"foo": 2, "bar": 1}, ("z",): {"foo": 5, "q": 1}}
    assert bad.count() == 2


def test_read_changesets(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("label: pip==1\nchanges: [usr/lib/pip, 'x:y']\n")
    (tmp_path / "b.yaml").write_text("[]")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_changesets(spark, str(tmp_path)).collect()}
    (tmp_path / "c.yaml").write_text("label: 3.10\nchanges: [a]\n")
    (tmp_path / "d.yaml").write_text("labels: x\nchanges: [1]\n")
    rows |= {r.path.rsplit("/", 1)[1]: r for r in files.read_changesets(spark, str(tmp_path)).collect()}
    assert rows["c.yaml"].labels == ["3.1"] and rows["d.yaml"].labels == ["x"] and rows["d.yaml"].changes == ["1"]
    assert rows["a.yaml"].labels == ["pip==1"] and rows["a.yaml"].changes == ["usr/lib/pip", "x:y"] and rows["b.yaml"].error


def test_many_documents_in_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PIECE", 10)
    (tmp_path / "a.yaml").write_text("# first\n---\nlabel: x\nchanges: [a]\n...\n---\nchanges: [\n---\r\nlabels: [y]\nchanges: [b, c]\n---\n")
    (tmp_path / "b.yaml").write_text("%YAML 1.1\n---\nlabel: z\nchanges: [d]\n")
    (tmp_path / "empty.yaml").write_text("\n")
    odd = "t\x7f\u2028\U0001f600"
    lines = [json.dumps({"label": i, "changes": [odd, "---"]}, ensure_ascii=i == 1) for i in (1, 2)] + ['{"label": 1e5, "changes": [3.10, 1.5e3, 007, true]}']
    (tmp_path / "c.yaml").write_text("\n---\n".join(lines))
    rows = [(r.path.rsplit("/", 1)[1], r.labels, r.changes, r.error is None) for r in files.read_changesets(spark, str(tmp_path)).collect()]
    bad = [r[0] for r in rows if not r[3]]
    assert sorted(bad) == ["a.yaml", "empty.yaml"]
    assert sorted(r[:3] for r in rows if r[3]) == [
        ("a.yaml", ["x"], ["a"]), ("a.yaml", ["y"], ["b", "c"]), ("b.yaml", ["z"], ["d"]),
        ("c.yaml", ["1"], [odd, "---"]), ("c.yaml", ["1e5"], ["3.1", "1.5e3", "7", "True"]), ("c.yaml", ["2"], [odd, "---"]),
    ]


def test_tagsets_of_one_file_keep_their_ids(spark, tmp_path):
    texts = spark.createDataFrame([(json.dumps({"id": i, "label": "x", "tags": {"foo": i}}),) for i in range(5)], "value string").coalesce(1)
    files.write_documents(texts, str(tmp_path / "t"), most=3)
    good, bad = files.read_tagsets(spark, str(tmp_path / "t"))
    assert sorted((r.id, r.tags["foo"]) for r in good.collect()) == [(str(i), i) for i in range(5)] and bad.count() == 0
    assert len(list((tmp_path / "t").glob("part-*"))) == 2


@pytest.mark.parametrize("name", ["s1_read_changesets", "s2_read_tagsets"])
def test_records_share_files(spark, tmp_path, monkeypatch, name):
    from tagquarry import queries

    monkeypatch.setattr(queries, "scratch", lambda s: str(tmp_path / "files"))
    assert queries.QUERIES[name](spark, DATA).count()
    assert 0 < len(list((tmp_path / "files").rglob("part-*"))) <= 8


def test_archives_and_image_metadata(spark, tmp_path):
    (tmp_path / "tar").mkdir()
    with tarfile.open(tmp_path / "tar/layer.tar", "w") as tar:
        tar.addfile(tarfile.TarInfo("usr/lib/x.py"), io.BytesIO())
        d = tarfile.TarInfo("usr/lib")
        d.type = tarfile.DIRTYPE
        tar.addfile(d)
    whole = (tmp_path / "tar/layer.tar").read_bytes()
    (tmp_path / "tar/bad.tar").write_text("no archive")
    (tmp_path / "tar/short.tar").write_bytes(whole[:700])
    rows = files.list_archives(spark, str(tmp_path / "tar")).collect()
    got = {(r.path, r.is_dir) for r in rows if r.archive.endswith("layer.tar")}
    assert got == {("usr/lib/x.py", False), ("usr/lib", True)}
    assert [r.path for r in rows if r.error and r.archive.endswith("bad.tar")] == [None]
    assert {r.path for r in rows if r.archive.endswith("short.tar")} >= {"usr/lib/x.py"}
    (tmp_path / "manifest.json").write_text('[{"Config": "c.json", "Layers": ["l0", "l1"]}]')
    (tmp_path / "c.json").write_text('{"history": [{"created": "2024-01-01T00:00:00Z", "created_by": "a"},\n {"created_by": "b", "empty_layer": true}]}')
    m = files.read_manifests(spark, str(tmp_path / "manifest.json")).collect()
    assert [(r.k, r.layer) for r in m] == [(0, "l0"), (1, "l1")]
    h = files.read_history(spark, str(tmp_path / "c.json")).collect()
    assert [(r.pos, r.created_by, r.empty_layer) for r in h] == [(0, "a", None), (1, "b", True)]


def test_ewma_both_ways(spark):
    load = spark.createDataFrame([("m", i, x) for i, x in enumerate((10, 20, 0, 5))], "model_id string, epoch long, load long")
    for kind in ("new", "old"):
        a = d = 0.0
        for x in (10, 20, 0, 5):
            b = 0.5 * a + 0.5 * x
            d = 0.5 * d + 0.5 * abs(x - (b if kind == "new" else a))
            a = b
        r = stats.ewma_forecast(load, 0.5, 2.0, kind).first()
        assert math.isclose(r.avg, a) and math.isclose(r.dev, d) and math.isclose(r.threshold, a + 2 * d)


def test_ewma_of_series_that_no_row_holds(spark, monkeypatch):
    monkeypatch.setattr(stats, "SERIES_BLOCK", 5)
    r = random.Random(8)
    data = {"long": [r.randint(0, 99) for _ in range(137)], "one": [7], "edge": [r.randint(0, 9) for _ in range(25)]}
    rows = [(m, e, x) for m, xs in data.items() for e, x in enumerate(xs)] + [(None, 1, 1), ("long", None, 5)]
    df = spark.createDataFrame(rows, "model_id string, epoch long, load long").repartition(6)
    for kind in ("new", "old"):
        got = {x.model_id: x for x in stats.ewma_forecast(df, 0.2, 1.5, kind).collect()}
        assert got.keys() == data.keys()
        for m, xs in data.items():
            a = d = 0.0
            for x in xs:
                b = 0.8 * a + 0.2 * x
                d = 0.8 * d + 0.2 * abs(x - (b if kind == "new" else a))
                a = b
            assert math.isclose(got[m].avg, a) and math.isclose(got[m].dev, d) and got[m].n_epochs == len(xs)
    assert stats.ewma_forecast(df.limit(0), 0.2, 1.5).count() == 0


def test_a_million_epochs_are_many_rows(spark):
    df = spark.range(1_000_000).select(F.lit("m").alias("model_id"), F.col("id").alias("epoch"), (F.col("id") % 7).alias("load"))
    a = d = 0.0
    for i in range(999_000, 1_000_000):
        b = 0.9 * a + 0.1 * (i % 7)
        d = 0.9 * d + 0.1 * abs(i % 7 - b)
        a = b
    row = stats.ewma_forecast(df, 0.1, 2.0).first()
    assert row.n_epochs == 1_000_000 and math.isclose(row.avg, a, rel_tol=1e-9) and math.isclose(row.dev, d, rel_tol=1e-9)


def test_mean_similarity_of_one_item(spark):
    rows = spark.createDataFrame([(1, 5, 2.0), (1, 6, 1.0)], "id long, idx long, value double")
    clusters = spark.createDataFrame([(1, 1)], "id long, leader long")
    assert similarity.group_similarity(clusters, rows).first().mean_similarity == 1.0


def test_tiles_give_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TILE", 7)
    r = random.Random(11)
    data = {i: {k: float(r.randint(1, 9)) for k in range(10) if r.random() < 0.3} for i in range(-3, 40)}
    rows = spark.createDataFrame([(i, k, v) for i, x in data.items() for k, v in x.items()], "id long, idx long, value double")
    norm = {i: math.sqrt(sum(v * v for v in x.values())) for i, x in data.items()}
    want = {}
    for i, j in [(i, j) for i in data for j in data if i < j and data[i].keys() & data[j].keys()]:
        want[i, j] = sum(data[i][k] * data[j][k] for k in data[i].keys() & data[j].keys()) / norm[i] / norm[j]
    got = similarity.cosine_pairs(rows).collect()
    assert len(got) == len(want) and all(math.isclose(x.cosine, want[x.a, x.b]) for x in got)
    assert similarity.cosine_pairs(rows.limit(0)).count() == 0


def test_similar_pairs_and_means_match_all_pairs(spark):
    r = random.Random(5)
    data = [(i, k, float(r.randint(1, 9))) for i in range(40) for k in range(12) if r.random() < (0.9 if k < 3 else 0.3)]
    rows = spark.createDataFrame(data, "id long, idx long, value double")
    pairs = {(x.a, x.b): x.cosine for x in similarity.cosine_pairs(rows).collect()}
    for t in (0.5, 0.8, 0.95):
        got = {(x.a, x.b): x.cosine for x in similarity.similar_pairs(rows, t).collect()}
        assert got.keys() == {p for p, c in pairs.items() if c > t} and all(math.isclose(c, pairs[p]) for p, c in got.items())
    ids = spark.range(42)  # two without features
    assert math.isclose(similarity.mean_similarity(rows, ids).first().mean_cosine, 2 * sum(pairs.values()) / (42 * 41))
    clusters = ids.select("id", (F.col("id") % 3).alias("leader"))
    for x in similarity.group_similarity(clusters, rows).collect():
        assert math.isclose(x.mean_similarity, 2 * sum(c for (a, b), c in pairs.items() if a % 3 == b % 3 == x.leader) / (x.n * (x.n - 1)))


@pytest.mark.parametrize("worth", [0, 1e9])
def test_similar_pairs_by_join_and_by_products(spark, monkeypatch, worth):
    for name, value in (("WORTH", worth), ("GROUP", 11), ("STRIP", 4), ("COLUMNS", 3)):
        monkeypatch.setattr(similarity, name, value)
    r = random.Random(7)
    data = {i: {k: float(r.randint(1, 3)) for k in range(8) if r.random() < 0.5} for i in range(30)}
    data[30], data[31] = {k: 1.0 for k in range(100, 112)}, {k: 1.0 for k in range(103, 115)}  # a cosine of 9 / 12
    rows = spark.createDataFrame([(i, k, x) for i, own in data.items() for k, x in own.items()], "id long, idx long, value double")
    norm = {i: math.sqrt(sum(x * x for x in own.values())) for i, own in data.items()}
    cosine = {(i, j): sum(x * data[j].get(k, 0) for k, x in data[i].items()) / norm[i] / norm[j] for i in data for j in data if i < j and data[i] and data[j]}
    got = {(x.a, x.b): x.cosine for x in similarity.similar_pairs(rows, 0.75).collect()}
    assert got.keys() == {p for p, c in cosine.items() if round(c, 9) > 0.75} and (30, 31) not in got
    assert all(math.isclose(c, cosine[p]) for p, c in got.items())


def test_leaders_of_rows_with_many_copies(spark):
    """Copies are not compared with each other: a hundred thousand links among them would be made."""
    r = random.Random(9)
    kinds = [{k: float(r.randint(1, 2)) for k in r.sample(range(6), 4)} for _ in range(12)]
    own = {i: kinds[r.randrange(12)] for i in range(1500)}
    rows = spark.createDataFrame([(i, k, x) for i, e in own.items() for k, x in e.items()], "id long, idx long, value double")
    norm = lambda e: math.sqrt(sum(x * x for x in e.values()))
    near = lambda a, b: round(sum(x * b.get(k, 0) for k, x in a.items()) / norm(a) / norm(b), 9) > 0.9
    leaders, want = [], {}
    for i, e in own.items():
        want[i] = next((x for x in leaders if near(own[x], e)), i)
        if want[i] == i:
            leaders.append(i)
    seen, pairs = [], similarity.similar_pairs
    try:
        similarity.similar_pairs = lambda kept, t: (seen.append(kept.select("id").distinct().count()), pairs(kept, t))[1]
        assert {x.id: x.leader for x in similarity.row_leaders(rows, 0.9).collect()} == want
    finally:
        similarity.similar_pairs = pairs
    assert seen[0] <= 12
