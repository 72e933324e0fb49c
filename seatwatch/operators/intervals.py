"""Pairs of overlapping intervals by equality joins on time buckets of several widths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import interval_iou

FINEST, STEP, TOP = 8.0, 4, 12  #: bucket widths are FINEST * STEP ** level seconds


def _width(level: Column) -> Column:
    return F.lit(FINEST) * F.pow(F.lit(float(STEP)), level)


def _bucketed(df: DataFrame, start: str, end: str, deeper: int) -> DataFrame:
    """df with _own (the level whose buckets are as wide as the interval or wider), and a row for each bucket that the
    interval touches at that level and so many more."""
    length = F.greatest((F.col(end) - F.col(start)) / FINEST, F.lit(1.0))
    own = F.least(F.ceil(F.round(F.log(length) / math.log(STEP), 9)), F.lit(TOP)).cast("int")
    levels = df.withColumn("_own", own).withColumn("_level", F.explode(F.sequence("_own", F.least(F.col("_own") + deeper, F.lit(TOP)))))
    at = lambda c: F.floor(F.col(c) / _width(F.col("_level")))
    return levels.where(F.col(end) > F.col(start)).withColumn("_bucket", F.explode(F.sequence(at(start), at(end))))


def interval_pairs(left: DataFrame, right: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """Rows of left (keys, l_start, l_end, ...) and right (keys, r_start, r_end, ...) whose intervals overlap, each pair
    once, with tiou; of at least ``least``.

    Intervals meet where they share a bucket about as wide as the longer of the two, so pairs are in proportion
    to overlaps, whatever the number of intervals of a key.  A bound on tiou bounds how far apart two lengths
    are, and so how many levels an interval has rows at (two for 0.3); without one it has rows at all wider ones.
    Null, empty and backward intervals overlap nothing.
    """
    deeper = TOP if least <= 0 else math.ceil(math.log(1 / least, STEP))
    a, b = _bucketed(left, "l_start", "l_end", deeper), _bucketed(right, "r_start", "r_end", deeper)
    met = None  # at the wider one's own level: short ones don't meet each other in the buckets of long ones
    for x, y in ((a.where("_level = _own"), b), (a.where("_level > _own"), b.where("_level = _own"))):
        pairs = x.drop("_own").join(y.drop("_own"), [*keys, "_level", "_bucket"])
        met = pairs if met is None else met.unionByName(pairs)
    once = F.col("_bucket") == F.floor(F.greatest("l_start", "r_start") / _width(F.col("_level")))
    met = met.where(once).withColumn("tiou", interval_iou(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end")))
    return met.where((F.col("tiou") > 0) & (F.col("tiou") >= least)).drop("_level", "_bucket")


def without_overlaps(rows: DataFrame, others: DataFrame, keys: list[str], least: float) -> DataFrame:
    """rows (keys, start_sec, end_sec, ...) that no other (same columns) of their key overlaps by ``least`` (above 0)."""
    span = lambda df, p: df.select(*keys, F.col("start_sec").alias(f"{p}_start"), F.col("end_sec").alias(f"{p}_end")).distinct()
    hit = interval_pairs(span(rows, "l"), span(others, "r"), keys, least).select(*keys, F.col("l_start").alias("start_sec"), F.col("l_end").alias("end_sec")).distinct()
    return rows.join(hit, [*keys, "start_sec", "end_sec"], "left_anti")
