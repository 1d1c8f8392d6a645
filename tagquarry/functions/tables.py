"""Loading tables, cutting lineage and numbering rows without a single-task sort."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """A folder of this application in the cluster's shared checkpoint folder, which goes when it ends.

    Where none is set, a local folder serves a local master; any other master is refused, since its
    executors would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not own.isDefined():
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tagquarry-"))
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = own.get()
    folder = f"{base}/tagquarry-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        system.mkdirs(path)
        system.deleteOnExit(path)
    return folder


def scratch(spark: SparkSession) -> str:
    """A new path in that folder."""
    return f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back, so that loops keep short plans."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*written: DataFrame | None) -> None:
    """Delete tables that materialize has made. Nothing that still reads them may run afterwards."""
    for df in written:
        if df is not None and getattr(df, "_written", None):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def global_index(df: DataFrame, order: list, name: str = "idx", deal: int | None = None) -> DataFrame:
    """df with a dense index from 0 in the order of the given columns.

    deal: rows are dealt to partitions by so many of the columns only (all of them by default), so that
    the driver's sample of bounds need not hold long texts.

    Rows are range-partitioned and numbered inside partitions; only one count per partition is
    summed up in order, so that no task sees all rows.
    """
    part, row = f"_{name}_part", f"_{name}_row"
    ranged = df.repartitionByRange(*order[:deal]).sortWithinPartitions(*order)
    ranged = materialize(
        ranged.withColumn(part, F.spark_partition_id()).withColumn(
            row, F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
        )
    )
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(part).agg(F.count("*").alias("_n"))
    offsets = offsets.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # One row per partition: bounded by spark.sql.shuffle.partitions.
    out = ranged.join(F.broadcast(offsets), part)
    return out.withColumn(name, F.col("_offset") + F.col(row)).drop(part, row, "_offset")


def running_total(df: DataFrame, order: list, amount: str, name: str) -> DataFrame:
    """df with the sum of `amount` over all rows up to each one, in the order of distinct keys.

    Rows are range-partitioned and summed inside partitions; only one sum per partition is added up in order.
    """
    part = f"_{name}_part"
    ranged = materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(part).agg(F.sum(amount).alias("_s"))
    sums = sums.select(part, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    # One row per partition: bounded by spark.sql.shuffle.partitions.
    out = ranged.withColumn(name, F.sum(amount).over(inside)).join(F.broadcast(sums), part)
    return out.withColumn(name, F.col(name) + F.col("_before")).drop(part, "_before")
