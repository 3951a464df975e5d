"""Text sinks and sources: JSON lines, CSV and partitioned Parquet, each read back with its schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks that the rows of one value are dealt to, and so files of its folder at most.
FILES_A_VALUE = 8


def write_json_lines(rows: DataFrame, path: str, mode: str = "append") -> None:
    """An append-only log, one JSON object a line."""
    rows.write.mode(mode).json(path)


def read_json_lines(like: DataFrame, path: str) -> DataFrame:
    return like.sparkSession.read.schema(like.schema).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("nullValue", "\\N").csv(path)


def read_csv(like: DataFrame, path: str) -> DataFrame:
    return like.sparkSession.read.schema(like.schema).option("header", True).option("nullValue", "\\N").csv(path)


def write_partitioned(rows: DataFrame, path: str, by: str) -> None:
    """Parquet in a folder for each value, so that a filter on it prunes folders; the rows of a value are dealt to several tasks."""
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(FILES_A_VALUE))
    rows.repartition(by, salt).write.mode("overwrite").partitionBy(by).parquet(path)


def read_csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, all columns as text; a file that is missing is a frame without rows."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    schema = ", ".join(f"`{c}` string" for c in columns)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def catalog_faults(rows: DataFrame, label: str, kind: str) -> DataFrame:
    """(fault, n) of a catalog read as text: blank labels or types, labels that hold no digit, repeated and conflicting labels."""
    each = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(kind).alias("kinds"), F.count(F.when(F.coalesce(F.trim(kind), F.lit("")) == "", 1)).alias("blank"))
    none = F.coalesce(F.trim(label), F.lit("")) == ""
    count = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("long")
    one = each.agg(count(none, F.col("n")).alias("blank_label"), count(F.lit(True), F.col("blank")).alias("blank_type"), count(~none & ~F.col(label).rlike("[0-9]"), F.col("n")).alias("no_digit"), count(~none & (F.col("n") > 1), F.col("n") - 1).alias("repeated"), count(~none & (F.col("kinds") > 1), F.lit(1)).alias("conflicting"))
    return one.unpivot([], one.columns, "fault", "n")
