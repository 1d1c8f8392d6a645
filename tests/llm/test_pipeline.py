"""The pipeline's stages on small data, and the queries that SQL can say."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tagquarry.llm import queries
from tagquarry.llm.common import materialize

from ..oracle import DATA, connect, oracle_rows, rows_of
from .test_operators import brute_components, brute_lines, brute_targets


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, name):
    assert rows_of(queries.QUERIES[name](spark, DATA)) == oracle_rows(connect(), queries.SQL[name])


def test_stages(spark):
    docs = queries.table(spark, DATA, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, DATA).cache()
        assert docs.columns == columns and docs.count() > 0
        if name == "toxicity":
            assert docs.exceptAll(before).count() == 0
        if name == "line_dedup":
            assert docs.count() == before.count() and docs.where("n_chars <> length(text)").count() == 0
        if name == "jaccard_join":
            assert docs.exceptAll(before).count() == 0
        if name == "mixing":
            assert docs.groupBy("doc_id").count().where("count > 3").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert out.count() == docs.count() and out.where("NOT exact").count() == 0


def test_whole_run_against_brute_force(spark):
    """Each stage on all that the one before has kept, and the run as their chain."""
    spoken = {r.doc_id: r.predicted for r in queries.op9_toxicity(spark, DATA).collect()}
    docs = queries.table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = {(r.doc_id, r.text): r for r in docs.collect()}
        docs = materialize(stage(spark, docs, DATA))
        after = docs.collect()
        if name == "toxicity":
            assert {(r.doc_id, r.text) for r in after} == {k for k in before if not spoken[k[0]]} and len(after) < len(spoken)
        elif name == "line_dedup":
            assert sorted((r.doc_id, r.text) for r in after) == [(d, t) for d, _, _, t in brute_lines(list(before))]
        elif name == "jaccard_join":
            least = brute_components(list(before))
            assert {(r.doc_id, r.text) for r in after} == {k for k in before if least[k[0]][1] == k[0]} and len(after) < len(before)
        elif name == "mixing":
            sizes, taken = Counter(), Counter()
            for r in before.values():
                sizes[r.source] += len(r.text.split())
            for r in after:
                taken[r.source] += len(r.text.split())
            want = brute_targets(sizes)
            longest = max(len(r.text.split()) for r in before.values())
            assert all(abs(taken[s] - want[s]) <= longest for s in sizes)
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
            texts = {d: t for d, t in before}
            assert all(list(r.ids) == sp.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in after)
    ran = Counter((r.doc_id, r.source, tuple(r.ids)) for r in corpus_pipeline.run(spark, DATA).collect())
    assert ran == Counter((r.doc_id, r.source, tuple(r.ids)) for r in after)


def test_run_and_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    for t in ("documents", "labels"):
        queries.table(spark, DATA, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_odd_rows_and_columns(spark):
    long = " ".join(f"w{i % 3001}" for i in range(40_000))
    texts = [None, "", " \n ", long, "You stupid idiot, you moron. You disgusting idiot.", "a clean text of some few words"]
    rows = [(i if i % 4 else None, t, "s" if i % 2 else None) for i, t in enumerate(texts * 3)]
    rows += [(900, f"shared id {i} " + " ".join(f"x{i}y{j}" for j in range(30)), "t") for i in range(5)]
    names = ["_row", "row", "times", "key", "doc", "own", "score", "n_lines", "lines", "kept", "size", "sid", "p", "tie", "n", "keys"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(c) for c in names})
    kept, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, DATA))
        assert docs.columns == columns and all(x[c] == c for x in docs.collect() for c in names)
        kept[name] = Counter((x.doc_id, x.text) for x in docs.collect())
    toxic = texts[4]
    assert kept["toxicity"] == Counter(r[:2] for r in rows if r[1] != toxic)
    assert kept["line_dedup"].keys() <= {(i, t or "") for i, t in kept["toxicity"]} | {(i, "") for i, _ in kept["toxicity"]}
    assert sum(kept["line_dedup"].values()) == sum(kept["toxicity"].values())
    # rows without an id stay, as do the least of each group and texts without words
    assert sum(n for (i, _), n in kept["jaccard_join"].items() if i is None) == sum(n for (i, _), n in kept["line_dedup"].items() if i is None)
    assert sum(n for (i, _), n in kept["jaccard_join"].items() if i == 900) == 5
    ids = {t: sorted(i for i, x in kept["line_dedup"] if x == t and i is not None) for _, t in kept["line_dedup"]}
    left = {t: sorted(i for i, x in kept["jaccard_join"] if x == t and i is not None) for _, t in kept["line_dedup"]}
    assert all(left[t] == (ids[t] if not t.strip() or 900 in ids[t] else ids[t][:1]) for t in ids)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert out.count() == docs.count() and out.where("NOT exact").count() == 0


def test_mixing_stage_draws_rows_without_or_with_one_id(spark):
    r = random.Random(13)
    rows = [(i if i % 3 else None, r.choice("abc"), f"t{i} " + "w " * r.randint(0, 60)) for i in range(600)]
    rows += [(5000, r.choice("abc"), f"s{i} " + "w " * r.randint(0, 60)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    words = Counter()
    for _, s, t in rows:
        words[s] += len(t.split())
    want, out = brute_targets(words), corpus_pipeline.mix(spark, docs, DATA).collect()
    taken, drawn = Counter(), Counter((x.doc_id, x.source, x.text) for x in out)
    for x in out:
        taken[x.source] += len(x.text.split())
    assert all(abs(taken[s] - want[s]) < 5 for s in words)
    for row in rows:  # as often as its source's share says, rounded down or up
        assert abs(drawn.pop(row, 0) - want[row[1]] / words[row[1]]) < 1
    assert not drawn
