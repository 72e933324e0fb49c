"""The first stage end to end: motion vectors to a budgeted shortlist of windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..operators import motion, nuisance, score, segment


def triage_scores(vectors: DataFrame, seat_cells: DataFrame, bins: int, rows: int | str, cols: int | str, p: Params = DEFAULTS, recordings: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Robust z of each seat and bin: dense cube, nuisance filters, seat means.

    vectors (keys, frame, bin, cy, cx, motion_x, motion_y), seat_cells (keys, seat_id, cy, cx).  Of several
    recordings (keys, one row each in ``recordings``) each is scored by itself.  The cube and the series feed several
    aggregates, so they are kept (memory, then disk; made again from lineage if an executor goes): clear the
    session's cache when the scores are stored.
    """
    keys = keys or []
    cube = motion.dense_cube(motion.cell_cube(vectors, [*keys, "frame"]), bins, rows, cols, recordings, keys).persist()
    clean = nuisance.apply_filters(cube, nuisance.periodic_cells(cube, p, keys), nuisance.illumination_bins(cube, p, keys), keys)
    series = motion.seat_series(clean, seat_cells, keys).persist()
    return score.robust_z(series, score.window_bins(bins, p), p, keys=[*keys, "seat_id"])


def shortlist(scores: DataFrame, seats: int, bins: int, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """The candidates of each recording that fit its review budget of so many seat-seconds."""
    return segment.budget_shortlist(segment.candidates(scores, p, [*(keys or []), "seat_id"]).persist(), seats * bins * p.bin_s, p, keys)


def candidate_windows(candidates: DataFrame, seats: DataFrame, edges: DataFrame, pad_s: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """candidates (keys, seat_id, start_sec, end_sec, ...) with x0 .. y1 of their seat, neighbours (its adjacent seats in
    order, with their boxes) and the padded span t0 to t1.  Candidates of unknown seats are left out."""
    keys = keys or []
    boxes = ["x0", "y0", "x1", "y1"]
    near = edges.select(*keys, F.col("a").alias("seat_id"), F.col("b").alias("_b")).distinct().join(seats.select(*keys, F.col("seat_id").alias("_b"), *boxes), [*keys, "_b"])
    near = near.groupBy(*keys, "seat_id").agg(F.array_sort(F.collect_list(F.struct(F.col("_b").alias("seat_id"), *boxes))).alias("neighbours"))
    out = candidates.join(seats.select(*keys, "seat_id", *boxes), [*keys, "seat_id"]).join(near, [*keys, "seat_id"], "left")
    none = F.array().cast(dict(near.dtypes)["neighbours"])
    return out.withColumns({"neighbours": F.coalesce("neighbours", none), "t0": F.greatest(F.lit(0.0), F.col("start_sec") - pad_s), "t1": F.col("end_sec") + pad_s})
