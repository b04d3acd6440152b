"""Event-time windows with watermarks. Event times without a zone are read as UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, sf_dir: str, name: str, files: int | None = None) -> DataFrame:
    """A table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{sf_dir}/{name}.parquet*")


def timed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    g = timed(events).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return g.select(F.col("window.start").alias("start"), "event_type", "events", "value")


def sliding(events: DataFrame, size: str = "1 day", slide: str = "12 hours") -> DataFrame:
    g = timed(events).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("events"))
    return g.select(F.col("window.start").alias("start"), "event_type", "events")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    g = timed(events).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """The first event of each key.

    A watermark begins at 1970-01-01, so what is not later would be dropped; it runs on times moved a thousand years on.
    """
    moved = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("_moved", F.col("ts") + F.expr("INTERVAL 1000 YEAR"))
    return moved.withWatermark("_moved", late).dropDuplicatesWithinWatermark([key]).drop("_moved")
