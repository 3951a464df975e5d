"""Tables in the folder that all executors share; each is deleted when the application ends."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, or under a folder of our own only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints/beamline"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a written table: cuts lineage and survives the loss of any executor."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def numbered(rows: DataFrame, order: list[Column], name: str, kind: str = "int") -> DataFrame:
    """rows with their place in the whole order, from 1: sorted by range, each range numbered alone."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("nth", F.monotonically_increasing_id()), name)
    # The id holds the partition in its upper bits and the place within it in its lower 33.
    placed = placed.withColumn("range", F.shiftright("nth", 33)).withColumn("within", F.col("nth").bitwiseAND((1 << 33) - 1))
    ranges = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    first = ranges.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("first"))  # one row a range
    return placed.join(F.broadcast(first), "range").withColumn(name, (F.col("first") + F.col("within") + 1).cast(kind)).drop("nth", "range", "within", "first")
