"""Robust z of running recordings: seat bins arrive as a stream, z leaves it once its windows are complete.

State is what two rolling medians still need of one seat: four half windows of activity (121 values at a width of
61), whatever the length of the recording.  z of a bin comes out when the bin two half windows later has arrived;
the last ones with the end of the recording, whose edge values repeat as in the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULTS, Params

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rolling_middle(values: np.ndarray, half: int, at_start: bool, at_end: bool) -> np.ndarray:
    """Medians of 2 * half + 1 values about each that has them all; at either end of a series the edge value repeats."""
    if not len(values):
        return values
    values = np.concatenate([np.repeat(values[:1], half if at_start else 0), values, np.repeat(values[-1:], half if at_end else 0)])
    if len(values) < 2 * half + 1:
        return values[:0]
    return np.sort(np.lib.stride_tricks.sliding_window_view(values, 2 * half + 1), axis=1)[:, half]


def complete_bins(tail: np.ndarray, first: int, done: int, ended: bool, half: int, floor: float, mad_scale: float) -> pd.DataFrame:
    """(bin, activity, x, baseline, scale, z) of the bins from ``done`` on whose windows are complete; tail: activity from
    bin ``first`` on, with two half windows before ``done`` or all."""
    x = np.sqrt(np.maximum(tail, 0.0))
    start = first == 0
    baseline = rolling_middle(x, half, start, ended)
    b0 = 0 if start else half  # the place in tail of the first baseline
    spread = rolling_middle(np.abs(x[b0 : b0 + len(baseline)] - baseline), half, start, ended)
    s0 = b0 if start else b0 + half
    at = np.arange(max(s0, done - first), s0 + len(spread))
    scale = np.maximum(mad_scale * spread[at - s0], floor)
    z = np.maximum((x[at] - baseline[at - b0]) / scale, 0.0)
    return pd.DataFrame({"bin": at + first, "activity": tail[at], "x": x[at], "baseline": baseline[at - b0], "scale": scale, "z": z})


class SeatScore(StatefulProcessor):
    def __init__(self, keys: list[str], width: int, mad_scale: float):
        self.keys, self.half, self.mad_scale = keys, width // 2, mad_scale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.series = handle.getValueState("series", "first long, done long, ended boolean, tail binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("bin")
        first, done, ended, tail = self.series.get() if self.series.exists() else (0, 0, False, b"")
        tail = np.frombuffer(tail, float)
        if not ended:
            end = new.loc[new["activity"].isna(), "bin"].min()  # the bins' number, once the recording is over
            seen = new[new["activity"].notna() & (new["bin"] >= first + len(tail))].drop_duplicates("bin")
            reach = int(max(seen["bin"].max() + 1 if len(seen) else 0, first + len(tail), 0 if np.isnan(end) else end))
            more = np.zeros(reach - first - len(tail))  # a bin without a row is still
            more[(seen["bin"] - first - len(tail)).to_numpy(int)] = seen["activity"]
            tail, ended = np.concatenate([tail, more]), not np.isnan(end)
            out = complete_bins(tail, first, done, ended, self.half, float(new["floor"].iloc[0]), self.mad_scale)
            done += len(out)
            drop = max(0, done - 2 * self.half - first)
            tail, first = (tail[:0], first) if ended else (tail[drop:], first + drop)
            self.series.update((first, done, ended, tail.tobytes()))
            for k, v in zip(self.keys, key):
                out[k] = v
            yield out[[*self.keys, "bin", "activity", "x", "baseline", "scale", "z"]]

    def close(self) -> None:
        pass


def online_z(bins: DataFrame, floors: DataFrame, width: int, keys: list[str] | None = None, p: Params = DEFAULTS) -> DataFrame:
    """(keys, bin, activity, x, baseline, scale, z) of a stream of bins, row for row what robust_z gives of the whole.

    bins (keys, bin, activity), a stream: rows of one seat come with rising bins from batch to batch, in any order
    within one; a bin without a row is still; a row with a null activity says that the recording has ``bin``
    bins and is over.  What comes after that, or again, is ignored.  floors (keys, floor), static: the least scale of each
    seat (score.scale_floors of an earlier recording, or of the calibration); 1e-6 where it has none.
    """
    keys = keys or ["seat_id"]
    bins.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    types = dict(bins.dtypes)
    rows = bins.select(*keys, F.col("bin").cast("long").alias("bin"), F.col("activity").cast("double").alias("activity")).join(floors.select(*keys, F.col("floor").alias("_floor")), keys, "left").withColumn("floor", F.coalesce("_floor", F.lit(1e-6))).drop("_floor")
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", bin long, activity double, x double, baseline double, scale double, z double"
    return rows.groupBy(*keys).transformWithStateInPandas(SeatScore(keys, width, p.mad_scale), schema, "Append", "None")
