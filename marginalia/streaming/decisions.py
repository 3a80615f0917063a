"""The decision log as a stream: an extension, since the batch form is a fold over a finished log.

Re-delivered entries are dropped within the watermark; what counts is the latest entry of each change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.review import fold


def entries(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """events: (event_id, ts, change_id, decision), each at least once, up to ``late`` late. Each comes once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def decisions_per_window(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, decision, n) of each finished window."""
    counted = entries(events, late).groupBy(F.window("ts", width), "decision").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "decision", "n")


def append_batch(path: str):
    """A foreachBatch sink: each micro-batch is one folder named by its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current(log: DataFrame) -> DataFrame:
    """The decisions that stand, from what the sink has written. log: (change_id, decision, ts, event_id)."""
    return fold(log.withColumn("seq", F.struct("ts", "event_id")).select("change_id", "decision", "seq")).drop("seq")
