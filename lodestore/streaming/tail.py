"""Following a commit log with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.log import EVENT


def follow(spark: SparkSession, log: str, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Start a query that hands each new lot of events to ``apply(events, number)``; the
    checkpoint makes every commit arrive once. ``once`` stops at the present end."""
    events = spark.readStream.schema(EVENT).json(log)
    writer = events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
