"""Exit codes as a stream of appended text files (an extension: exit files only grow)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.history import parse_exits


def read_exit_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Exits of files as they arrive, with the time at which they were read.

    Order across files is that of their modification times; ``line_no`` is that time
    in microseconds, so a later file's code wins.
    """
    raw = spark.readStream.option("lineSep", "\n").text(folder).select(
        F.col("_metadata.file_path").alias("history_id"),
        F.unix_micros("_metadata.file_modification_time").alias("line_no"),
        F.col("value").alias("line"),
    )
    return parse_exits(raw)


def append_table(exits: DataFrame, path: str, checkpoint: str):
    """Append the stream to a Parquet table, exactly once; stops when the input is used up."""
    return (
        exits.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def failure_rates(exits: DataFrame, wide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Runs and failures by window of the recorded second; later records than ``late`` are dropped."""
    at = F.timestamp_seconds(F.split_part("ts_raw", F.lit("."), F.lit(1)).try_cast("bigint"))
    rows = exits.withColumn("at", at).withWatermark("at", late)
    return rows.groupBy(F.window("at", wide)).agg(
        F.count("*").alias("runs"), F.count_if(F.col("exit_code") != 0).alias("failures")
    )
