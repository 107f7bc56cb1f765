"""Streaming jobs (extensions: the library's batch operators over arriving data).

Late data is held back by watermarks; state is bounded by them. The checkpoint location is the
caller's and must lie on storage that all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_folder(spark: SparkSession, path: str, schema: str, files: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def event_windows(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """STM-03: tumbling windows by event type; events later than ``late`` are left out."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def latest_states(log: DataFrame, key: str, order: str, late: str = "30 days") -> DataFrame:
    """STM-02: last state of every key of a log, in update mode. State is kept by key and day of
    ``order``; days older than ``late`` are let go, so that it does not grow with all keys ever seen. A key
    gives one row for each day it changes on: the reader keeps the latest."""
    rest = [c for c in log.columns if c != key]
    timed = log.withColumn(order, F.col(order).cast("timestamp")).withWatermark(order, late)
    best = timed.groupBy(key, F.window(order, "1 day").alias("day")).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(key, "r.*")


def proposals(docs: DataFrame, least: int = 3, time: str = "created_at", span: str = "30 days", late: str = "7 days") -> DataFrame:
    """STM-01: topics (language, keyword) that documents arriving within ``span`` support often enough."""
    k = F.from_json("metadata_json", "struct<keywords:array<string>>").getField("keywords")
    timed = docs.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    rows = timed.select("lang", time, F.explode(k).alias("keyword")).groupBy(F.window(time, span).alias("w"), "lang", F.lower("keyword").alias("topic"))
    return rows.agg(F.count("*").alias("support")).where(F.col("support") >= least).select(F.col("w.start").alias("since"), "lang", "topic", "support")


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> None:
    """Process what is there into a memory table, then stop."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
