"""Seat activity from an event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seat_activity_stream(events: DataFrame, seat: Column, value: Column, ts: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(seat_id, start, activity, n): mean value of each seat and tumbling window, once the watermark has passed it.

    State is one sum and count for each open window and seat; events later than ``late`` are dropped.
    """
    out = events.withWatermark(ts, late).groupBy(F.window(ts, width), seat.alias("seat_id")).agg(F.avg(value).alias("activity"), F.count("*").alias("n"))
    return out.select("seat_id", F.col("window.start").alias("start"), "activity", "n")
