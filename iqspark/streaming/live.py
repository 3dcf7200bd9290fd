"""Live recordings: chunk files that land in a folder, decoded, checked and counted as a stream."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import stream_recording


def live_frames(spark: SparkSession, folder: str, num_tones: int | None = None, keep: int | None = None, records: int = 16384, per_trigger: int = 1 << 22) -> DataFrame:
    """Frames of a landing folder: empty chunks (keep-alives) give none, the short last record of a chunk is left out, and
    a chunk of any size is read in ranges. Order is (stream_id, chunk, seq): seq is the place in the chunk."""
    return stream_recording(spark, folder, num_tones, keep, records, per_trigger)


def with_event_time(frames: DataFrame, start: str, rate: float, counter: str = "packet_counter") -> DataFrame:
    """Adds ts = start + counter / rate. start is when the counter was 0; over wraps, give counter64 as the counter."""
    return frames.withColumn("ts", F.timestamp_micros((F.unix_micros(F.lit(start).cast("timestamp")) + F.col(counter) * 1e6 / rate).cast("long")))


def without_repeats(frames: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Frames of files that land twice count once, within a delay; needs ts."""
    return frames.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["stream_id", "packet_counter"])


def running_errors(frames: DataFrame) -> DataFrame:
    """Frames and errors by stream so far; write in update or complete mode."""
    return frames.groupBy("stream_id").agg(F.count("*").alias("n_frames"), F.sum(F.when(F.col("packet_error") != 0, 1).otherwise(0)).alias("n_errors"))


def record(frames: DataFrame, path: str, checkpoint: str, **trigger: Any):
    """Continuous Parquet recording with exactly-once files; trigger defaults to what has landed by now."""
    return frames.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("stream_id").trigger(**(trigger or {"availableNow": True})).start()
