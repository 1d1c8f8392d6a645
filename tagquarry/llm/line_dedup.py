"""Line dedup: drop lines that many documents repeat, except in one of them.

Normalised lines are exploded once per document and hashed, distinct documents are counted per hash
with map-side combining, and the hashes over the threshold are joined back. Each document then
reassembles its remaining lines by position. Only (hash, doc_id) pairs are counted; texts move once.

Defined cases: a null or empty text is one empty line; a null doc_id holds lines for nobody and
loses none; rows that share a doc_id are one document for counting and each loses the same keys;
a line that a document repeats goes (or stays) at all its positions; ties cannot occur, the largest
doc_id keeps; an empty table gives an empty result; other columns pass through unless named
n_lines or n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, columns, lower_ascii, materialize


def line_key(line):
    """The line without white space at its ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(WS)))


def _hash(key):
    """128 bits of a key: at 10^12 lines a collision is rarer than 10^-14."""
    return F.unhex(F.md5(F.encode(key, "UTF-8")))


def repeated_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, _row, _lost array<int>): the positions of the lines that each document loses.

    _row is a fingerprint of the whole text, so that rows sharing a doc_id keep their own positions.
    """
    lines = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        "doc_id",
        F.xxhash64("text").alias("_row"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    )
    keys = lines.select("doc_id", "_row", "pos", line_key(F.col("line")).alias("key")).where(
        F.char_length("key") >= min_chars
    )
    held = materialize(keys.select(_hash(F.col("key")).alias("hash"), "doc_id", "_row", "pos"))
    # Written first, so that the join below reads plain shuffles, which Spark splits where one line is hot.
    often = materialize(
        held.select("hash", "doc_id")
        .distinct()
        .groupBy("hash")
        .agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("docs") >= min_docs)
        .select("hash", "keeper")
    )
    return (
        held.join(often, "hash")
        .where("doc_id <> keeper")
        .groupBy("doc_id", "_row")
        .agg(F.collect_list("pos").alias("_lost"))
    )


def dedup_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """documents with `text` reduced to the kept lines, and n_lines, n_dropped."""
    lost = repeated_lines(documents, min_chars, min_docs)
    own = [c for c in documents.columns if c not in ("n_lines", "n_dropped")]
    docs = documents.select(F.struct(*columns(own)).alias("own"), "doc_id", F.xxhash64("text").alias("_row"))
    lines = F.split(F.coalesce("own.text", F.lit("")), "\n")
    at = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "_lost")
    kept = F.when(F.col("_lost").isNull(), F.col("lines")).otherwise(F.transform(at, lambda i: F.get("lines", i)))
    done = docs.join(lost, ["doc_id", "_row"], "left").withColumn("lines", lines).withColumn("kept", kept)
    return done.select(
        *(F.array_join("kept", "\n").alias(c) if c == "text" else F.col("own").getField(c).alias(c) for c in own),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines").cast("long") - F.size("kept")).alias("n_dropped"),
    )
