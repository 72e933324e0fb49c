"""Rolling medians and robust z of seat series.

A seat's series is one array in one row (it is as long as a recording, not as the
data), so the rolling window needs no self-join and its edges can be replicated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..functions.geometry import stabilise


def window_bins(bins: int, p: Params = DEFAULTS) -> int:
    """The odd width of the rolling window for a series of so many bins (at least 1)."""
    w = max(3, round(p.baseline_s / p.bin_s) | 1)
    return max(1, min(w, bins if bins % 2 else bins - 1))


def _rolling(values: Column, width: int) -> Column:
    half = width // 2
    padded = F.concat(F.array_repeat(F.element_at(values, 1), half), values, F.array_repeat(F.element_at(values, -1), half))
    middle = F.lit(half + 1)
    return F.transform(values, lambda _, i: F.element_at(F.array_sort(F.slice(padded, i + 1, width)), middle))


def series_arrays(series: DataFrame, value: Column, keys: list[str]) -> DataFrame:
    """One row for each seat: bins and values in order of bin."""
    rows = F.array_sort(F.collect_list(F.struct("bin", value.alias("v"))))
    return series.groupBy(*keys).agg(rows.alias("_r")).select(*keys, F.transform("_r", lambda r: r["bin"]).alias("bins"), F.transform("_r", lambda r: r["v"]).alias("x"))


def rolling_median(series: DataFrame, width: int, value: str = "activity", keys: list[str] | None = None) -> DataFrame:
    """series with ``baseline``: the centred rolling median, the edge values repeated."""
    keys = keys or ["seat_id"]
    a = series_arrays(series, F.col(value), keys).withColumn("b", _rolling(F.col("x"), width))
    return a.select(*keys, F.explode(F.arrays_zip("bins", "x", "b")).alias("r")).select(*keys, F.col("r.bins").alias("bin"), F.col("r.x").alias(value), F.col("r.b").alias("baseline"))


def robust_z(series: DataFrame, width: int, p: Params = DEFAULTS, how: str = "sqrt", keys: list[str] | None = None) -> DataFrame:
    """(keys, bin, activity, x, baseline, scale, z) of dense series (keys, bin, activity).

    x is the stabilised activity; scale is the rolling median of the absolute residuals, but not under a
    share of the seat's own scale, nor of the 95th percentile of all x; z is at least 0.
    """
    keys = keys or ["seat_id"]
    x = series.withColumn("x", stabilise(F.col("activity"), how))
    a = series_arrays(x, F.struct("activity", "x"), keys)
    a = a.withColumn("activity", F.transform("x", lambda r: r["activity"])).withColumn("x", F.transform("x", lambda r: r["x"]))
    a = a.withColumn("b", _rolling(F.col("x"), width))
    a = a.withColumn("o", F.zip_with("x", "b", lambda v, b: F.abs(v - b)))
    a = a.withColumn("s", _rolling(F.col("o"), width))
    out = a.select(*keys, F.explode(F.arrays_zip("bins", "activity", "x", "b", "s")).alias("r")).select(*keys, F.col("r.bins").alias("bin"), "r.activity", "r.x", F.col("r.b").alias("baseline"), F.col("r.s").alias("_s"))
    out = out.join(scale_floors(series, p, how, keys), keys).withColumn("scale", F.greatest(p.mad_scale * F.col("_s"), F.col("floor")))
    return out.select(*keys, "bin", "activity", "x", "baseline", "scale", F.greatest((F.col("x") - F.col("baseline")) / F.col("scale"), F.lit(0.0)).alias("z"))


def scale_floors(series: DataFrame, p: Params = DEFAULTS, how: str = "sqrt", keys: list[str] | None = None) -> DataFrame:
    """(keys, floor): the least scale of each seat, by its own spread and its recording's level."""
    keys = keys or ["seat_id"]
    lead = keys[:-1]  # all but the seat: the recording
    x = series.withColumn("x", stabilise(F.col("activity"), how))
    median = x.groupBy(*keys).agg(F.percentile("x", F.lit(0.5)).alias("_m"))
    spread = x.join(median, keys).groupBy(*keys).agg(F.percentile(F.abs(F.col("x") - F.col("_m")), F.lit(0.5)).alias("_mad"))
    level = x.groupBy(*lead).agg(F.percentile("x", F.lit(0.95)).alias("_p95"))
    out = spread.join(level, lead) if lead else spread.join(F.broadcast(level), F.lit(True))  # one row
    return out.select(*keys, F.greatest(p.seat_scale_floor * p.mad_scale * F.col("_mad"), F.greatest(p.global_floor * F.col("_p95"), F.lit(1e-6))).alias("floor"))


def exceedance_rate(scores: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    return scores.groupBy(*(keys or [])).agg(F.avg((F.col("z") > p.z_threshold).cast("int")).alias("rate"), F.max("z").alias("max_z"), F.count("*").alias("n"))
