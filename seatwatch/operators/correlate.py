"""Lagged correlation between seat series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params


def lag_bins(p: Params = DEFAULTS) -> int:
    return round(p.corr_lag_s / p.bin_s)


def lagged_correlation(scores: DataFrame, pairs: DataFrame, p: Params = DEFAULTS, window: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, window, seat_a, seat_b, corr, lag_s): the best Pearson correlation of z over lags.

    pairs (keys, seat_a, seat_b), or with window also (those columns, lo, hi): bins lo to hi - 1 only.
    keys name the recording, in pairs and scores: seats of different recordings never meet.
    A positive lag means that b follows a.  The best starts at 0, so negative correlations never
    win; of equal ones the lowest lag wins.  Overlaps of under 3 bins and constant series give 0.
    """
    window, keys = window or [], keys or []
    lead = [*keys, *window, "seat_a", "seat_b"]
    spans = pairs if window else pairs.withColumn("lo", F.lit(-(2**31) + 1)).withColumn("hi", F.lit(2**31 - 1))
    lags = F.explode(F.sequence(F.lit(-lag_bins(p)), F.lit(lag_bins(p)))).alias("lag")
    a = spans.join(scores.select(*keys, F.col("seat_id").alias("seat_a"), F.col("bin"), F.col("z").alias("x")), [*keys, "seat_a"]).where((F.col("bin") >= F.col("lo")) & (F.col("bin") < F.col("hi")))
    a = a.select(*lead, "lo", "hi", "bin", "x", lags).withColumn("_b", F.col("bin") + F.col("lag")).where((F.col("_b") >= F.col("lo")) & (F.col("_b") < F.col("hi")))
    b = scores.select(*keys, F.col("seat_id").alias("seat_b"), F.col("bin").alias("_b"), F.col("z").alias("y"))
    sums = a.join(b, [*keys, "seat_b", "_b"]).groupBy(*lead, "lag").agg(*(F.sum(e).alias(n) for n, e in (("n", F.lit(1)), ("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("syy", F.col("y") * F.col("y")), ("sxy", F.col("x") * F.col("y")))))
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    able = (F.col("n") >= 3) & (vx > 1e-12) & (vy > 1e-12)
    corr = F.when(able, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(F.when(able, vx * vy))).otherwise(0.0)
    best = sums.select(*lead, "lag", F.round(F.greatest(corr, F.lit(0.0)), 9).alias("corr"))
    best = best.groupBy(*lead).agg(F.max_by("lag", F.struct("corr", -F.col("lag"))).alias("lag"), F.max("corr").alias("corr"))
    none = F.col("corr") <= 0
    return best.select(*lead, "corr", F.when(none, 0.0).otherwise(F.col("lag") * p.bin_s).alias("lag_s"))


def survey(scores: DataFrame, pairs: DataFrame, p: Params = DEFAULTS, top: int = 12, keys: list[str] | None = None) -> DataFrame:
    """The ``top`` pairs of each recording by correlation: a report."""
    w = Window.partitionBy(*(keys or [])).orderBy(F.col("corr").desc(), "seat_a", "seat_b")
    return lagged_correlation(scores, pairs, p, keys=keys).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).drop("_n")


def strongest(correlations: DataFrame, keys: list[str]) -> DataFrame:
    """The best neighbour of each window; of equal ones the first in order."""
    w = Window.partitionBy(*keys).orderBy(F.col("corr").desc(), "ord")
    return correlations.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")
