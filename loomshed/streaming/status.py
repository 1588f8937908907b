"""Status events as a stream: the same rollup serves batch frames and file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def by_window(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Events and sums by type and window; with ``late``, a watermark bounds the state kept."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late is not None:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """Append-only folder of newline-delimited JSON events."""
    return spark.readStream.schema(SCHEMA).json(path)


def start_rollup(spark: SparkSession, path: str, out: str, checkpoint: str, width: str = "1 hour", late: str = "1 hour"):
    """Append finished windows below ``out``; offsets and state live in ``checkpoint``, so a restart goes on where it was."""
    return by_window(
        read_status(spark, path), width, late
    ).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start()
