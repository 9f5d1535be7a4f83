"""Structured Streaming variants: results as they arrive, deduplicated and summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def result_stream(spark: SparkSession, folder: str, schema, late: str = "30 days") -> DataFrame:
    """Results of a growing folder, each result_id once within the watermark."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["result_id"])


def accuracy_windows(stream: DataFrame, width: str = "7 days") -> DataFrame:
    """Counts and correct ones of each run and time window."""
    return stream.groupBy(F.window("created_at", width), "run_id").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))


def event_windows(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Count and sum of each event type and window; the same for a stream and a table."""
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


def resume_into(stream: DataFrame, folder: str, checkpoint: str):
    """Append what is new to the run's checkpoint folder, exactly once, and stop."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
