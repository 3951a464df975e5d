"""Windowed counts, sessions and deduplication of the event stream.

Each is one function of a DataFrame, batch or streaming. The queries run it as a stream until the input is
read. Window counts and totals come in update mode: a micro-batch writes the rows that it changed to a
folder of its own, which a repeated batch overwrites, and the latest row of each key counts; the watermark
drops the state of old windows. Sessions, which have no update mode, come in complete mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import query
from ..sources.scratch import scratch_path

WATERMARK = "1 hour"


def hourly(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def totals(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"), F.max("value").alias("most"))


def streamed(spark: SparkSession, path: str, step: Callable[[DataFrame], DataFrame], keys: list[str] | None = None) -> DataFrame:
    """The result of step over the stream of the files of that name, when all are read; in update mode if it has keys."""
    base = scratch_path(spark, "stream")
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    out = step(spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")))
    put = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{base}/result/batch={batch if keys else 0}")
    out.writeStream.outputMode("update" if keys else "complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*out.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/result")
    if not keys:
        return rows.drop("batch")
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*out.columns), "batch").alias("last"))
    return latest.select("last.*")


@query("stream_hourly", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def stream_hourly(spark, sf_dir):
    return streamed(spark, f"{sf_dir}/events.parquet", hourly, ["start", "event_type"])


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_sessions(spark, sf_dir):
    return streamed(spark, f"{sf_dir}/events.parquet", sessions)


@query("stream_totals", "SELECT event_type, count(*) AS n, max(event_id) AS last, max(value) AS most FROM events GROUP BY event_type")
def stream_totals(spark, sf_dir):
    return streamed(spark, f"{sf_dir}/events.parquet", totals, ["event_type"])
