"""Scratch tables in the shared folder, and small column helpers used by several operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: In DuckDB, the table of CRC-32 by its rule, and the sum of a string's UTF-8 bytes.
CRC_TABLE_SQL = """list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), range(8)),
  lambda c, i: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END))"""


def crc_sql(text: str, table: str) -> str:
    data = f"list_transform(range(1, 2 * octet_length(encode({text})) + 1, 2), lambda i: CAST('0x' || substr(hex(encode({text})), i, 2) AS BIGINT))"
    full = "CAST(4294967295 AS BIGINT)"
    return f"xor({full}, list_reduce(list_prepend({full}, {data}), lambda c, v: xor(c >> 8, {table}[xor(c & 255, v) + 1])))"


#: Upper-case ASCII, lowered by translate(); other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; one of our own only where that is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints/beamline"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives the loss of any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(rows: DataFrame, keyed: DataFrame, keys: list[str], often: Column) -> DataFrame:
    """rows with the values that keyed has, once, for their keys; both are written tables.

    Keys where often holds go to all tasks, so that no task gets all rows of one; the caller bounds their number.
    """
    few = written(keyed.filter(often), "often")
    at_hand = rows.join(F.broadcast(few), keys)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(keyed.filter(~often), keys)
    return at_hand.unionByName(rest)


def numbered(rows: DataFrame, name: str, number: str) -> DataFrame:
    """rows, written, numbered from 1 in the order in which their partitions hold them; one row a partition gives what lies before it."""
    at = written(rows.withColumn("_at", F.monotonically_increasing_id()), name)
    at = at.withColumn("_part", F.shiftright("_at", 33))
    sizes = at.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return at.join(F.broadcast(before), "_part").withColumn(number, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11)).cast("double") * F.lit(2.0**-53)


def fresh(taken: list[str], name: str) -> str:
    """name, lengthened until no column of the input is called so."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
