"""State that is carried from frame to frame: driver loops with checkpoints, and stateful streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frames(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], count: int, keep: int = 4) -> DataFrame:
    """``step`` applied ``count`` times; every ``keep`` steps the state is checkpointed, which cuts the plan.

    The checkpoint goes to the folder that the session names; without one, plans simply grow.
    """
    now = start
    for k in range(count):
        now = step(now, k)
        if (k + 1) % keep == 0 and now.sparkSession.sparkContext.getCheckpointDir():
            now = now.checkpoint()
    return now


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """A stream (or table) of events as sums by hour and kind; hours close when the watermark has passed them."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.rint(F.col("value") * 100).cast("bigint")).alias("cents")).select(F.col("w.start").alias("hour"), "event_type", "n", "cents")
