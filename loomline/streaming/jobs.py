"""Streaming forms: first-seen dedup, windowed counts with late data, rebuild on arrival."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomline.functions import text as T


def documents_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def first_seen(stream: DataFrame, time_col: str, text: str = "text", within: str = "1 day") -> DataFrame:
    """Rows whose content wasn't seen within the watermark; state is bounded by it."""
    return stream.withColumn("content_hash", T.content_hash(T.clean(F.col(text)))).withWatermark(time_col, within).dropDuplicatesWithinWatermark(["content_hash"])


def windowed_counts(stream: DataFrame, time_col: str, key: str, window: str = "7 days", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), key).agg(F.count("*").alias("n"))


def rebuild_on_arrival(stream: DataFrame, rebuild, checkpoint: str):
    """Calls ``rebuild(batch, batch_id)`` for what has arrived, once, with offsets kept in ``checkpoint``."""
    return stream.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def next_run(schedule: str, now: datetime) -> datetime | None:
    """When a schedule is due next: once (never again), hourly, daily at 2, weekly on Sunday at 2; an unknown one is daily."""
    if schedule == "once":
        return None
    if schedule == "hourly":
        return now + timedelta(hours=1)
    due = now.replace(hour=2, minute=0, second=0, microsecond=0)
    if schedule == "weekly":
        due += timedelta(days=(6 - due.weekday()) % 7)
    return due if due > now else due + timedelta(days=7 if schedule == "weekly" else 1)
