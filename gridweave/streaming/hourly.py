"""Streaming twins of the batch series: hourly means, sessions, late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New Parquet files of an events folder, with the schema of what is there."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def hourly_means(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """(carrier, hr, mean, n) per hour; hours close when the watermark has passed them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    hours = timed.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("carrier"))
    return hours.agg(F.avg("value").alias("mean"), F.count("*").alias("n")).select("carrier", F.col("w.start").alias("hr"), "mean", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a longer gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    s = timed.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return s.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_end(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there, then stop; the result is the in-memory table ``name``."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
