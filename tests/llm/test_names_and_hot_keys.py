"""Columns of any name, and tables where one key holds most rows."""

import importlib
import random

import pytest
from pyspark.sql import functions as F

from tagquarry.llm import line_dedup, mixing, pieces, queries, tokenfile, urls

corpus_pipeline = importlib.import_module("corpus_pipeline")
ODD = ["a.b", "c`d", "own.text", "x y"]


def odd_documents(spark, n=40):
    line = "a line that is long enough to be counted"
    rows = [(i, f"{line}\nown {i} words of document {i} are here", "en", "s", 1, "1", "2", "3", "4") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k0 string, k1 string, k2 string, k3 string")
    return df.toDF("doc_id", "text", "lang", "source", "n_chars", *ODD)


def held(df):
    return {tuple(r[c] for c in ODD) for r in df.collect()}


def test_columns_of_any_name_pass_the_operators(spark):
    docs = odd_documents(spark)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"] and held(out) == {("1", "2", "3", "4")}
    pages = docs.withColumn("url", F.lit("https://example.com/en/7"))
    assert held(urls.filter_urls(pages)) == {("1", "2", "3", "4")}
    encoded = pieces.encode_and_decode(docs, queries.tokenizer_path("piece_bpe_32k.model"))
    assert encoded.columns == [*docs.columns, "ids", "decoded"] and held(encoded) == {("1", "2", "3", "4")}


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_repeated_lines, corpus_pipeline.keep_one_of_each_group, corpus_pipeline.mix])
def test_columns_of_any_name_pass_the_stages(spark, stage):
    docs = odd_documents(spark)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns and held(out) == {("1", "2", "3", "4")}


def test_token_file_cuts_a_hot_doc_id(spark, tmp_path):
    r = random.Random(1)
    rows = [(None if i % 3 else i, " ".join(r.choice("abcdef") * 5 for _ in range(30))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "tokens")
    tokenfile.write_token_file(docs, path, queries.tokenizer_path("word_bpe_49k.json"))
    blocks = tokenfile.read_token_file(spark, path)
    digests = tokenfile.document_digests(blocks)
    got = digests.orderBy("start").collect()
    assert len(got) == 600 and [x.start for x in got] == [sum(y.n_tokens for y in got[:i]) for i in range(600)]
    assert [x.doc_id for x in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    per = [x["count"] for x in spark.read.parquet(path).select("part", F.explode("doc_ids").alias("d")).groupBy("part").count().collect()]
    assert max(per) < 0.6 * 600  # two thirds of the rows have no doc_id


def test_targets_of_many_sources_match_the_plain_rule(spark):
    r = random.Random(2)
    sizes = {f"s{i:03}": r.choice([1, 5, 50, 1000]) for i in range(150)} | {None: 70}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(sizes)
    while True:
        share = (sum(sizes.values()) - sum(target.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if share * w[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    target |= {s: share * w[s] for s in open_}
    got = {x.source: (x.target, x.place) for x in mixing.source_targets(df).collect()}
    assert got.keys() == target.keys()
    assert all(got[s][0] == pytest.approx(target[s]) and got[s][1] == order.index(s) for s in target)
