"""Attempt accounting over an event stream (Structured Streaming).

The batch ``eval_summary`` reads a finished attempt log. On a live log the
same totals are kept per event-time window: attempts, failed attempts and
an approximate count of distinct tasks, with a watermark bounding the state
kept for late events. Output is appended once a window closes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_event_stream(spark: SparkSession, directory: str, schema, glob: str = "*.parquet",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(directory)


def windowed_attempts(events: DataFrame, ts_col: str = "ts", task_col: str = "user_id",
                      failed=None, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Per event-time window: attempts, failures, distinct tasks (approx.), failure rate."""
    failed = failed if failed is not None else (F.col("event_type") == "error")
    # watermarks need TIMESTAMP; parquet here carries TIMESTAMP_NTZ (same wall-clock value in UTC)
    agg = (events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
           .groupBy(F.window(ts_col, window).alias("w"))
           .agg(F.count(F.lit(1)).alias("attempts"), F.count_if(failed).alias("failed"),
                F.approx_count_distinct(task_col).alias("tasks")))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "attempts", "failed", "tasks",
                      F.round(F.col("failed") / F.col("attempts"), 6).alias("failure_rate"))


def run_available_now(df: DataFrame, sink_dir: str, checkpoint_dir: str) -> StreamingQuery:
    """Process everything available, append closed windows as parquet, then stop."""
    return (df.writeStream.format("parquet").outputMode("append")
            .option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())
