"""Exact dedup by two-pass Bloom filtering.

Pass one sets the bits of each text's 64-bit hash in two bitmaps, "seen" and "seen twice" (`cells`): no row and no hash
is exchanged, only touched pieces of the bitmaps, whose size is bounded by `max_filter_bits`. Pass two tests every row
against the second bitmap, a Bloom filter of what may be repeated. A repeated text always passes; rows that fail are alone
and go straight through; only rows that pass are shuffled, and told apart by a 256-bit hash. A filter that fills
up lets more rows through but changes no result.

Defined cases: a null text counts as empty and equals every text of white space only; in rows that
share doc_id, text and length the first one stays; a null doc_id sorts after all others; an empty
table gives an empty result; other columns are ignored by the decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cells
from .common import WS, bound_batches, materialize, sha256_text


def squeezed(text) -> Column:
    """The text without white space; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WS, "")


def dedup_exact(documents: DataFrame, max_filter_bits: int = cells.MAX_CELLS, k: int = 2) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays, then the smallest
    doc_id.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    squeezed_text = squeezed(F.col("text"))
    sketch = cells.build(documents.select(F.xxhash64(squeezed_text).alias("h")), cells.sketch_cells(documents.count(), max_filter_bits, k), k)
    test = cells.tester(spark, sketch.twice, k)
    seen = documents.select(
        "doc_id",
        F.char_length(F.coalesce("text", F.lit(""))).alias("len"),
        squeezed_text.alias("squeezed"),
    ).select("doc_id", "len", F.xxhash64("squeezed").alias("h"), sha256_text("squeezed").alias("text_sha256"))
    seen = materialize(seen.withColumn("maybe", test("h")).drop("h"))
    alone = seen.where("NOT maybe").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    same = materialize(seen.where("maybe").groupBy("text_sha256", "doc_id", "len").agg(F.count("*").alias("n")))
    order = F.struct("len", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("first"))
    # Written first, so that the join below reads plain shuffles, which Spark splits where one text is hot.
    groups = materialize(
        same.groupBy("text_sha256").agg(
            F.max(F.struct(order.alias("order"), "doc_id")).alias("best"), F.sum("n").alias("group_size")
        )
    )
    shuffled = (
        same.join(groups, "text_sha256")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        .select(
            "doc_id",
            F.col("best.doc_id").alias("keep_id"),
            "group_size",
            (
                (F.col("copy") == 1)
                & (F.col("len") == F.col("best.order.len"))
                & F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
            ).alias("kept"),
            "text_sha256",
        )
    )
    return alone.unionByName(shuffled)
