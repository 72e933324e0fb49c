"""Seats of whole recordings: calibration windows, sampled frames, clusters of persons, one merged grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..operators import detections as D
from ..operators import motion_seats, seats


def calibration_samples(recordings: DataFrame, frames: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """(keys, window_id, sample, t): seat_samples frames of each calibration window, evenly spread.

    recordings (keys, duration_s), frames (keys, t).  A target past the last frame has none; a frame may serve two.
    """
    starts = recordings.select(*keys, F.posexplode(seats.calibration_starts(F.col("duration_s"), p)).alias("window_id", "_start"))
    targets = starts.select(*keys, "window_id", F.posexplode(D.sample_targets(F.col("_start"), F.lit(p.calibration_s), F.lit(p.seat_samples))).alias("_i", "target"))
    targets = targets.select(*keys, (F.col("window_id") * p.seat_samples + F.col("_i")).alias("sample"), "target")
    found = D.first_frames_after(targets, frames, keys)
    return found.select(*keys, F.floor(F.col("sample") / p.seat_samples).cast("int").alias("window_id"), "sample", "t")


def calibrate_seats(recordings: DataFrame, frames: DataFrame, detections: DataFrame, cube: DataFrame, rows: int, cols: int, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """(keys, seat_number, row, col, x0 .. y1, energy, windows) of each recording.

    recordings (keys, duration_s), frames (keys, t), detections (keys, t, det_idx, cls_id, conf, x0 .. y1), cube (keys,
    bin, cy, cx, activity) of rows x cols cells, dense.  A seat's energy is the mean activity of its cells in
    the recording's first calibration_s; boxes and energies of the windows' seats are averaged as they merge.
    """
    window = [*keys, "window_id"]
    samples = calibration_samples(recordings, frames, keys, p)
    seen = samples.join(detections, [*keys, "t"])
    clusters = seats.seat_clusters(seen, samples, p, window, ["sample", "det_idx"])
    energy = motion_seats.energy_map(cube, p, keys)
    clusters = seats.with_energy(seats.number_rows(clusters, p, window), energy, rows, cols, p, keys, "window_id")
    merged = seats.number_rows(seats.merge_windows(clusters, p, keys), p, keys)
    return merged.select(*keys, "seat_number", "row", "col", *(F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")), "energy", "windows")
