"""Streams: job states from progress events, and arriving documents through the batch queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# A job's stages in order.
STAGES = ("uploaded", "analyzing", "extracting", "ocr", "layout", "reading_order", "arabic_analysis", "reconstruction", "review_ready", "rendering", "validating", "completed", "failed")


def job_states(events: DataFrame, job: str = "job_id", order: str = "event_id") -> DataFrame:
    """Latest stage and highest progress of each job; works on batches and streams alike.

    Progress never goes back, whatever order events come in. The state of a job is one row.
    """
    return events.groupBy(job).agg(F.count("*").alias("n_events"), F.max("progress").alias("progress"), F.max_by("stage", order).alias("stage"), F.max(order).alias("last_event"))


def event_windows(events: DataFrame, time: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by stage in tumbling windows; what comes later than ``late`` is left out and its state dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, length).alias("window"), "stage").agg(F.count("*").alias("n"))


def follow(spark: SparkSession, folder: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``handle(batch, number)`` over Parquet files as they arrive; the checkpoint makes a restart go on where it stopped."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
