"""Lineage cuts: a table in the folder that all executors share; global numbers without one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """Where this run's tables go: the folder of ``spark.checkpoint.dir``, below the application's id. Where that is unset, a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='crawlsight-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write and read back, so that a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def portions(spark: SparkSession, rows: int, each: int) -> int:
    """How many tasks so many rows are dealt to: as many as run at once, and more of them, not larger ones, the more rows there are."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def drop_saved(spark: SparkSession) -> None:
    """Delete this application's tables, once nothing that reads them is needed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[Column], name: str, number: str) -> DataFrame:
    """Add ``number``, from 1 in the given order: ranges are sorted side by side, and only their sizes meet in one task."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = saved(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), name)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    return placed.join(starts, "_part").withColumn(number, F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start")
