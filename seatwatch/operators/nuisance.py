"""Nuisance filters on a dense cube: periodic cells and illumination changes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params


def spectrum_peak(series: np.ndarray, bin_s: float, min_hz: float) -> tuple[float, float]:
    """(prominence, frequency) of the strongest line of one cell: its lobe's share of the power
    from min_hz up.  At the edge of the spectrum the lobe counts the peak twice."""
    x = np.asarray(series, float)
    power = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)))) ** 2
    hz = np.fft.rfftfreq(len(x), bin_s)
    power[(hz < min_hz) | (np.arange(len(power)) == 0)] = 0
    total, k = power.sum(), int(power.argmax())
    lobe = power[k] + power[max(k - 1, 0)] + power[min(k + 1, len(power) - 1)]
    return (float(lobe / total) if total > 0 else 0.0), float(hz[k])


def periodic_cells(cube: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """(keys, cy, cx, prominence, frequency, periodic) of each cell of a dense cube.

    Series of under 16 bins are not tested.  Where over distrust_share of a recording's
    cells look periodic, none is flagged.  One cell's series is one group.
    """
    keys = keys or []
    lead = [*keys, "cy", "cx"]

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        out = pdf[lead].iloc[:1].copy()
        prominence, hz = spectrum_peak(pdf["activity"].to_numpy(), p.bin_s, p.min_hz) if len(pdf) >= 16 else (0.0, 0.0)
        out["prominence"], out["frequency"], out["periodic"] = prominence, hz, prominence >= p.prominence
        return out

    types = dict(cube.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in lead) + ", prominence double, frequency double, periodic boolean"
    cells = cube.select(*lead, "bin", "activity").groupBy(*lead).applyInPandas(look, schema)
    share = cells.groupBy(*keys).agg((F.avg(F.col("periodic").cast("int")) <= p.distrust_share).alias("_trusted"))
    cells = cells.join(share, keys) if keys else cells.join(F.broadcast(share), F.lit(True))
    return cells.withColumn("periodic", F.col("periodic") & F.col("_trusted")).drop("_trusted")


def cell_scores(cube: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """cube with ``score``: the robust z of each cell against its own series."""
    lead = [*(keys or []), "cy", "cx"]
    median = cube.groupBy(*lead).agg(F.percentile("activity", F.lit(0.5)).alias("_median"))
    centred = cube.join(median, lead).withColumn("_off", F.abs(F.col("activity") - F.col("_median")))
    scale = centred.groupBy(*lead).agg(F.greatest(F.percentile("_off", F.lit(0.5)) * p.mad_scale, F.lit(1e-3)).alias("_scale"))
    return centred.join(scale, lead).withColumn("score", (F.col("activity") - F.col("_median")) / F.col("_scale")).drop("_off", "_scale")


def illumination_bins(cube: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None, hot: float = 3.0) -> DataFrame:
    """(keys, bin, hot_share, gated): bins in which most cells jump at once."""
    out = cell_scores(cube, p, keys).groupBy(*(keys or []), "bin").agg(F.avg((F.col("score") > hot).cast("int")).alias("hot_share"))
    return out.withColumn("gated", F.col("hot_share") >= p.illumination_share)


def apply_filters(cube: DataFrame, cells: DataFrame, bins: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The cube with periodic cells at 0, then gated bins at their cell's median over the other bins.

    Both masks come from the raw cube.
    """
    keys = keys or []
    place = [*keys, "bin", "cy", "cx"]
    zeroed = cube.select(*place, "activity").join(cells.select(*keys, "cy", "cx", "periodic"), [*keys, "cy", "cx"])
    zeroed = zeroed.select(*place, F.when(F.col("periodic"), 0.0).otherwise(F.col("activity")).alias("activity"))
    marked = zeroed.join(bins.select(*keys, "bin", "gated"), [*keys, "bin"])
    fill = marked.groupBy(*keys, "cy", "cx").agg(F.percentile(F.when(~F.col("gated"), F.col("activity")), F.lit(0.5)).alias("_fill"))
    return marked.join(fill, [*keys, "cy", "cx"]).select(*place, F.when(F.col("gated"), F.coalesce("_fill", F.lit(0.0))).otherwise(F.col("activity")).alias("activity"))


def camera_motion(coverage: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """(keys, residual, moving, note): the largest median motion of any bin of a recording, and a note where it exceeds
    camera_px, as a camera that turns looks like activity everywhere.  coverage (keys, bin, gmv_x, gmv_y)."""
    keys = keys or []
    out = coverage.groupBy(*keys).agg(F.coalesce(F.max(F.greatest(F.abs("gmv_x"), F.abs("gmv_y"))), F.lit(0.0)).alias("residual"))
    moving = F.col("residual") > p.camera_px
    note = F.format_string("residual global motion up to %.2f px/frame after median subtraction: the camera may be moving", "residual")
    return out.select(*keys, "residual", moving.alias("moving"), F.when(moving, note).alias("note"))
