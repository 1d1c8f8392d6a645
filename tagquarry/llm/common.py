"""Shared helpers of the training-data operators: table loading and lineage cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagquarry.functions.tables import checkpoint_dir, scratch, table  # noqa: F401

#: The white space that the operators' contracts name: space, tab, LF, VT, FF, CR.
WS = " \t\n\x0b\x0c\r"


def bound_batches(spark: SparkSession, most: str = "2m") -> None:
    """Give Python workers record batches of about 2 MB, unless the session asks for another size than
    Spark's own 64 MB: with copies on both sides of the pipe that is too much for a worker of long texts.

    The setting stays in the session, since results are lazy and read it when they run: later queries of the same
    session get such batches too, unless they set another size."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "64m", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def materialize(df: DataFrame) -> DataFrame:
    """Write df once as a Parquet table in the shared checkpoint folder and read it back.

    Cuts the lineage: later jobs survive lost executors without running the plan again.
    """
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns(names: list[str]) -> list[Column]:
    """The columns of these names, whatever dots or backticks they hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def lower_ascii(c):
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256_text(c):
    """Lowercase hex digest of a string column's UTF-8 bytes."""
    return F.sha2(F.encode(c, "UTF-8"), 256)
