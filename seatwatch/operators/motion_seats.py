"""Seats from motion alone, for recordings without a detector: local maxima of a smoothed energy map.

Spark averages the activity of each cell; what is left of a recording is one small map (a cell for
each 16 x 16 pixels), which is one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params

#: The pitch where a map shows none, and the farthest lag it is looked for (cells).
DEFAULT_PITCH, FARTHEST = 4.0, 40


def first_peak(profile: np.ndarray) -> float:
    """The first local maximum of an autocorrelation from lag 2 on (profile[0] is lag 0)."""
    seg = profile[2 : min(len(profile), FARTHEST)]
    top = np.flatnonzero((seg[1:-1] > seg[:-2]) & (seg[1:-1] >= seg[2:])) if len(seg) >= 3 else []
    return float(top[0] + 3) if len(top) else DEFAULT_PITCH


def pitch_of(energy: np.ndarray) -> tuple[float, float]:
    """Rows and columns between seats: the nearest peaks of the map's 2-D autocorrelation along its axes."""
    x = energy - energy.mean()
    if not x.any():
        return DEFAULT_PITCH, DEFAULT_PITCH
    h, w = x.shape
    f = np.fft.rfft2(x, s=(2 * h, 2 * w))
    ac = np.round(np.fft.irfft2(f * f.conj(), s=(2 * h, 2 * w)) / (x**2).sum(), 9)  # so that equal lags stay equal
    return first_peak(ac[:h, 0]), first_peak(ac[0, :w])


def smoothed(energy: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing to four sigma, the map mirrored at its edges (the edge cell included)."""
    reach = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    for axis in (0, 1):
        n = energy.shape[axis]
        place = np.arange(-reach, n + reach) % (2 * n)
        wide = np.take(energy, np.where(place < n, place, 2 * n - 1 - place), axis)
        energy = sum(w * np.take(wide, np.arange(n) + i, axis) for i, w in enumerate(weights))
    return energy


def local_maxima(energy: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Cells that no other exceeds within a frame of high x wide cells about them."""
    top = np.pad(energy, ((high // 2, high // 2), (wide // 2, wide // 2)), mode="edge")
    top = np.lib.stride_tricks.sliding_window_view(top, (high, wide)).max((2, 3))
    return energy >= top


def labelled(mask: np.ndarray) -> np.ndarray:
    """8-connected parts of a mask, numbered from 1 by their first cell; 0 outside."""
    lab = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        wide = np.pad(np.where(mask, lab, mask.size + 1), 1, constant_values=mask.size + 1)
        new = np.where(mask, np.lib.stride_tricks.sliding_window_view(wide, (3, 3)).min((2, 3)), 0)
        if (new == lab).all():
            return np.searchsorted(np.unique(np.append(lab, 0)), lab)
        lab = new


def owners(mask: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """The nearest peak's number for each cell of the mask, of equally near ones the peak cell that comes first."""
    at, own = np.argwhere(peaks > 0), np.zeros(mask.shape, int)
    for y, x in np.argwhere(mask):
        near = at[((at - (y, x)) ** 2).sum(1).argmin()]
        own[y, x] = peaks[tuple(near)]
    return own


def seats_of_map(energy: np.ndarray, p: Params = DEFAULTS) -> tuple[list[dict], float, float]:
    """The seats of one map: cells, their mean place and energy, in order of their peaks; the pitch."""
    high, wide = pitch_of(energy)
    smooth = np.round(smoothed(energy, max(0.6, min(high, wide) / 3)), 9)
    mask = smooth > np.percentile(smooth, p.motion_percentile)
    odd = lambda v: max(3, int(round(v)) | 1)
    peaks = labelled(local_maxima(smooth, odd(high), odd(wide)) & mask)
    own = owners(mask, peaks) if peaks.any() else peaks
    out = []
    for k in range(1, int(peaks.max(initial=0)) + 1):
        cells = np.argwhere(own == k)
        if len(cells) >= p.motion_cells:
            y, x = cells.mean(0)
            out.append({"cluster": k, "cells": cells.tolist(), "cy": float(y), "cx": float(x), "energy": float(energy[own == k].mean())})
    return out, high, wide


def energy_map(cube: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None, bins: float | None = None) -> DataFrame:
    """(keys, cy, cx, energy): the mean activity of each cell in the first calibration_s of its recording.

    cube (keys, bin, cy, cx, activity), dense: a recording that is shorter gives what it has."""
    n = round(p.calibration_s / p.bin_s) if bins is None else bins
    return cube.where(F.col("bin") < n).groupBy(*(keys or []), "cy", "cx").agg(F.avg("activity").alias("energy"))


def seats_from_motion(cube: DataFrame, rows: int, cols: int, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """(keys, seat_number, row, col, x0 .. y1, cy, cx, energy, cells, pitch_h, pitch_w) of recordings of rows x cols cells.

    A seat is the cells nearest to one peak; boxes are in pixels, cy and cx the cells' mean.  Seats whose means
    follow within row_gap pitches form a row.  Recordings without a cell above the threshold have none.
    """
    keys = keys or []
    lead = keys or ["_all"]
    energy = energy_map(cube, p, keys)
    energy = energy if keys else energy.withColumn("_all", F.lit(0))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((rows, cols))
        grid[pdf["cy"], pdf["cx"]] = pdf["energy"]
        found, high, wide = seats_of_map(grid, p)
        out = pd.DataFrame(found, columns=["cluster", "cells", "cy", "cx", "energy"]).assign(pitch_h=high, pitch_w=wide, **{k: pdf[k].iloc[0] for k in lead})
        return out[[*lead, "cluster", "cy", "cx", "energy", "pitch_h", "pitch_w", "cells"]]

    types = dict(energy.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in lead) + ", cluster int, cy double, cx double, energy double, pitch_h double, pitch_w double, cells array<array<int>>"
    found = energy.groupBy(*lead).applyInPandas(find, schema)
    cell = lambda i: F.transform("cells", lambda c: c[i])
    found = found.select("*", *(e.alias(n) for n, e in (("x0", F.array_min(cell(1)) * p.cell_px), ("y0", F.array_min(cell(0)) * p.cell_px), ("x1", (F.array_max(cell(1)) + 1) * p.cell_px), ("y1", (F.array_max(cell(0)) + 1) * p.cell_px))))
    by = Window.partitionBy(*lead).orderBy("cy", "cx")
    gap = F.col("cy") - F.lag("cy").over(by) > F.col("pitch_h") * p.row_gap
    found = found.withColumn("_new", F.coalesce(gap.cast("int"), F.lit(0))).withColumn("row", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    found = found.withColumn("col", (F.row_number().over(Window.partitionBy(*lead, "row").orderBy("cx", "cy")) - 1).cast("int"))
    found = found.withColumn("seat_number", F.row_number().over(Window.partitionBy(*lead).orderBy("row", "col")))
    return found.select(*keys, "seat_number", "row", "col", "x0", "y0", "x1", "y1", "cy", "cx", "energy", "cells", "pitch_h", "pitch_w")
