"""A training-corpus pipeline: each stage's output is written as Parquet and read by the next one.

Stages: toxicity (rejected documents go), line dedup (repeated lines go from the texts), n-gram
Jaccard join (the smallest doc_id of each component stays), mixing sources to target weights
(documents are dropped or repeated as drawn), SentencePiece encoding and decoding.

Defined cases: a null doc_id is judged like any other document until the Jaccard stage, where it
links with nothing and stays, and is mixed like any other; rows that share a doc_id are judged row by
row for toxicity, share the decisions of line dedup and the Jaccard stage, and are drawn apart; columns
of any name pass through unchanged up to the last stage, except text and n_chars after line dedup; the
last stage returns doc_id, source, n_tokens, ids and exact.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagquarry.llm import jaccard, line_dedup, mixing, pieces, toxicity
from tagquarry.llm.common import checkpoint_dir, columns, materialize, table
from tagquarry.llm.queries import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(spark, model)("text") < 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others repeat; documents left without text stay, empty."""
    whole = F.struct(*columns(docs.columns)).alias("doc")  # columns of any name stay apart from the operator's
    kept = line_dedup.dedup_lines(docs.select("doc_id", "text", whole))
    changed = {"text": F.col("text"), "n_chars": F.char_length("text")}
    return kept.select(*(changed.get(f.name, F.col("doc").getField(f.name)).cast(f.dataType).alias(f.name) for f in docs.schema))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component of near duplicates."""
    classes = jaccard.jaccard_join(docs)
    gone = classes.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*columns(docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    own = F.struct(*columns(docs.columns)).alias("doc")  # columns of any name stay apart from the draw's
    keyed = materialize(docs.select(own, F.monotonically_increasing_id().alias("row")))
    rows = keyed.select(*(F.col("doc").getField(c).alias(c) for c in ("doc_id", "source", "text")), F.col("row").alias("key"))
    drawn = mixing.mix_sources(rows, key="key").where("times > 0").select(F.col("key").alias("row"), "times")
    taken = keyed.join(drawn, "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return taken.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document: doc_id, source, n_tokens, ids, and whether decoding gives the text."""
    out = pieces.encode_and_decode(docs.select("doc_id", "source", "text"), tokenizer_path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"),
    )


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: The learned toxicity scores, the sampling and the pieces are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
