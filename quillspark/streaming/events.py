"""The document operators on streams, and windowed sums of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """event_type, hour, n, total: the same plan on a table and on a stream (with a watermark)."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    w = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select("event_type", F.col("w.start").alias("hour"), "n", "total")


def run_batches(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Row-local document operators as micro-batches into Parquet; a repeated batch overwrites its folder."""

    def write(df: DataFrame, k: int) -> None:
        step(df).write.mode("overwrite").parquet(f"{out}/batch={k}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
