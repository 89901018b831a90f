"""Where loops keep their intermediate tables, and numbering of all rows by an order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one, in local mode only: elsewhere the
    executors would write to disks that no other one reads."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or getattr(spark, "_sparkloom_store", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = spark._sparkloom_store = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    return where.rstrip("/")


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """df as Parquet in the shared folder, read again: no lineage, and nothing that is lost with an executor."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the number (from 1) of each row in the order of all rows. Rows are dealt to ranges of the order, counted
    per range and numbered inside it, so no task sorts them all; the counts are a row per range."""
    ranged = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    before = F.broadcast(sizes.select("_range", F.coalesce(ahead, F.lit(0)).alias("_before")))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(before, "_range").withColumn(name, (F.col("_before") + inside).cast("int")).drop("_range", "_before")
