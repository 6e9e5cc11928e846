"""Following the change log as a stream of immutable files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fieldledger.schemas import CHANGE_LOG


def read_feed(spark: SparkSession, log_path: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """The entries of new log files as they appear."""
    return (
        spark.readStream.schema(CHANGE_LOG)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", "true")
        .parquet(log_path)
    )


def follow(
    spark: SparkSession,
    log_path: str,
    out_path: str,
    cursor_path: str,
    *,
    files_per_trigger: int = 1000,
    continuous: bool = False,
) -> StreamingQuery:
    """Copies new entries to a Parquet table; `cursor_path` remembers the position.

    Both paths must be shared by all executors. A restart with the same
    `cursor_path` goes on where the last run stopped, each entry written once.
    """
    feed = read_feed(spark, log_path, files_per_trigger=files_per_trigger)
    writer = (
        feed.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", cursor_path)
        .option("path", out_path)
    )
    if not continuous:
        writer = writer.trigger(availableNow=True)
    return writer.start()
