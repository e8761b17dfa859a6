"""Run modes over a stream of calls. An extension: the batch operators are in ``operators.runs``.

``first_calls`` keeps the first call of each name within a watermark;
``activity`` counts calls by name and time window, late ones up to the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_calls(calls: DataFrame, name: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """One call of each name for as long as the watermark keeps its state; Spark drops older state."""
    return calls.withWatermark(time, delay).dropDuplicatesWithinWatermark([name])


def activity(calls: DataFrame, name: str, time: str, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(start, end, name, calls): counts by name and tumbling window."""
    grouped = calls.withWatermark(time, delay).groupBy(F.window(time, window), name)
    found = grouped.agg(F.count(F.lit(1)).alias("calls"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), name, "calls")
