"""Popularity by segment as a stream: counts per window that late rows still reach, and their upkeep in a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import shared_folder


def windowed_counts(stream: DataFrame, time: str, by: list[str], window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows window_start, by, n: a watermark bounds the state to windows that can still change."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *by, "n")


def keep_up(counts: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes the counts that change, batch by batch, under path; a batch that is tried again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The latest count of every key."""
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    return rows.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.parquet as a stream of files, run to its end: window_start, event_type, n."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    base = f"{shared_folder(spark)}/popularity-{uuid.uuid4().hex}"
    keep_up(windowed_counts(stream, "ts", ["event_type"]), f"{base}/counts", f"{base}/state").awaitTermination()
    return current(spark, f"{base}/counts", "window_start timestamp, event_type string, n bigint", ["window_start", "event_type"])
