"""Seat grids: discovery from persons, merging, cells, adjacency, rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, PERSON, Params
from ..functions.geometry import to_cell


def iou_many(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """IoU of a box with each of many boxes."""
    w = np.maximum(np.minimum(one[2], many[:, 2]) - np.maximum(one[0], many[:, 0]), 0)
    h = np.maximum(np.minimum(one[3], many[:, 3]) - np.maximum(one[1], many[:, 1]), 0)
    shared = w * h
    union = (one[2] - one[0]) * (one[3] - one[1]) + (many[:, 2] - many[:, 0]) * (many[:, 3] - many[:, 1]) - shared
    return np.where((shared > 0) & (union > 0), shared / np.where(union > 0, union, 1), 0.0)


class Clusters:
    """Clusters of boxes that come in order, a part at a time, and their running mean boxes.

    A box joins the cluster of the highest IoU of at least ``join`` (of ties the first, or the last), or
    with first_match the first such; else it founds one.  Boxes are chosen for many at a time by the means before them,
    and the choices are checked against the means that they lead to: up to the first that differs they are those
    of a walk.
    """

    MOST, FEW = 512, 64  #: boxes tried at a time; clusters up to which that pays

    def __init__(self, join: float, first_match: bool = False, last_tie: bool = False):
        self.join, self.first_match, self.last_tie = join, first_match, last_tie
        self.mean, self.size, self.k, self.ahead = np.zeros((16, 4)), np.zeros(16, int), 0, 8

    def _chosen(self, boxes: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """The cluster of each box by mean (boxes or 1, clusters, 4), -1 for none."""
        w = np.maximum(np.minimum(boxes[:, None, 2], mean[..., 2]) - np.maximum(boxes[:, None, 0], mean[..., 0]), 0)
        h = np.maximum(np.minimum(boxes[:, None, 3], mean[..., 3]) - np.maximum(boxes[:, None, 1], mean[..., 1]), 0)
        shared = w * h
        union = ((boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]))[:, None] + (mean[..., 2] - mean[..., 0]) * (mean[..., 3] - mean[..., 1]) - shared
        v = np.where((shared > 0) & (union > 0), shared / np.where(union > 0, union, 1), 0.0)
        good = v >= self.join if self.join > 0 else v > 0
        top = good.argmax(1) if self.first_match else v.shape[1] - 1 - v[:, ::-1].argmax(1) if self.last_tie else v.argmax(1)
        return np.where(good.any(1), top, -1)

    def _one(self, b: np.ndarray, weight: int) -> int:
        m = self.mean[: self.k]
        near = np.flatnonzero((m[:, 0] < b[2]) & (m[:, 2] > b[0]) & (m[:, 1] < b[3]) & (m[:, 3] > b[1]))  # the others have 0
        v = iou_many(b, m[near])
        good = np.flatnonzero(v >= self.join if self.join > 0 else v > 0)
        top = -1 if not len(good) else int(near[good[0] if self.first_match else len(v) - 1 - int(v[::-1].argmax()) if self.last_tie else int(v.argmax())])
        if top < 0:
            top, self.k = self.k, self.k + 1
            if self.k > len(self.size):
                self.mean, self.size = np.concatenate([self.mean, np.zeros_like(self.mean)]), np.concatenate([self.size, np.zeros_like(self.size)])
            self.mean[top], self.size[top] = b, weight
        else:
            self.mean[top] = (self.mean[top] * self.size[top] + b * weight) / (self.size[top] + weight)
            self.size[top] += weight
        return top

    def _many(self, boxes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Clusters of the first boxes, as far as they are sure."""
        k, n = self.k, len(boxes)
        own = self._chosen(boxes, self.mean[None, :k])
        n = int(np.append(own < 0, True).argmax())
        own, boxes = own[:n], boxes[:n]
        after, order = np.zeros((n, 4)), np.argsort(own, kind="stable")
        cut = np.searchsorted(own[order], np.arange(k + 1))
        count, mean, size = np.diff(cut), self.mean[:k].copy(), self.size[:k].copy()
        for r in range(int(count.max(initial=0))):  # the r-th box of every cluster
            c = np.flatnonzero(count > r)
            i = order[cut[c] + r]
            mean[c] = (mean[c] * size[c, None] + boxes[i] * weights[i, None]) / (size[c] + weights[i])[:, None]
            size[c] += weights[i]
            after[i] = mean[c]
        latest = np.zeros((n + 1, k), int)  # 1 + the last box before it that each cluster took
        latest[np.arange(1, n + 1), own] = np.arange(1, n + 1)
        latest = np.maximum.accumulate(latest, 0)[:n]
        before = np.where((latest > 0)[..., None], after[latest - 1], self.mean[None, :k]) if n else np.zeros((0, k, 4))
        sure = int(np.append(self._chosen(boxes, before) != own, True).argmax()) if n else 0
        for c in np.unique(own[:sure]):
            mine = np.flatnonzero(own[:sure] == c)
            self.mean[c] = after[mine[-1]]
            self.size[c] += int(weights[mine].sum())
        return own[:sure]

    def add(self, boxes: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """The cluster of each box.  weights: how many boxes each stands for (1)."""
        weights = np.ones(len(boxes), int) if weights is None else weights
        out, i = np.zeros(len(boxes), int), 0
        while i < len(boxes):
            if 0 < self.k <= self.FEW and self.ahead >= 8:
                own = self._many(boxes[i : i + self.ahead], weights[i : i + self.ahead])
                out[i : i + len(own)] = own
                i += len(own)
                if len(own) >= self.ahead:
                    self.ahead = min(2 * self.ahead, self.MOST)
                    continue
                self.ahead = max(8, self.ahead // 2)
            if i < len(boxes):
                out[i] = self._one(boxes[i], int(weights[i]))
                i += 1
        return out


def agglomerate(boxes: np.ndarray, join: float, first_match: bool = False, last_tie: bool = False, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cluster of each box, in order, and the clusters' running mean boxes; see Clusters."""
    found = Clusters(join, first_match, last_tie)
    own = found.add(boxes, weights)
    return own, found.mean[: found.k]


def seat_clusters(detections: DataFrame, frames: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """(keys, cluster, x0 .. y1, n, occupancy): places where a person persistently is.

    detections (keys, t, det_idx, cls_id, conf, x0 .. y1), frames (keys, t): a row for each sampled frame, those that hold
    nothing too.  A group is one calibration window; its boxes are taken in ``order``, by (t, det_idx) or by sample.
    """
    keys, order = keys or ["window_id"], order or ["t", "det_idx"]
    persons = detections.where((F.col("cls_id") == PERSON) & (F.col("conf") >= p.detection_conf))

    types = dict(detections.dtypes)
    head = {k: types[k] for k in keys}

    def done(key: tuple, found: Clusters, n: np.ndarray, seen: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame({"cluster": range(found.k), **{c: found.mean[: found.k, i] for i, c in enumerate(("x0", "y0", "x1", "y1"))}, "n": n[: found.k], "seen": seen[: found.k]})
        return out.assign(**dict(zip(keys, key)))[[*keys, "cluster", "x0", "y0", "x1", "y1", "n", "seen"]]

    def clusters(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Windows come one after another, in parts: only clusters are kept of them."""
        key = None
        for pdf in parts:
            same = pdf["_window"].to_numpy()
            for a, b in zip(cuts := np.flatnonzero(np.append(True, same[1:] != same[:-1])), [*cuts[1:], len(pdf)]):
                if same[a] != key:
                    if key is not None:
                        yield done(names, found, n, seen)
                    key, names, found, n, seen, last = same[a], tuple(pdf[k].iloc[a] for k in keys), Clusters(p.seat_join_iou), np.zeros(0, int), np.zeros(0, int), np.zeros(0)
                own, t = found.add(pdf[["x0", "y0", "x1", "y1"]].to_numpy(float)[a:b]), pdf["t"].round(3).to_numpy(float)[a:b]
                more = found.k - len(n)
                n, seen, last = np.append(n, np.zeros(more, int)), np.append(seen, np.zeros(more, int)), np.append(last, np.full(more, np.nan))
                n += np.bincount(own, minlength=found.k)
                times = pd.DataFrame({"own": own, "t": t}).drop_duplicates()  # times rise within a window
                seen += np.bincount(times["own"], minlength=found.k) - np.bincount(times["own"], times["t"].to_numpy() == last[times["own"]], minlength=found.k).astype(int)
                ends = times.drop_duplicates("own", keep="last")
                last[ends["own"]] = ends["t"]
        if key is not None:
            yield done(names, found, n, seen)

    schema = ", ".join(f"{k} {t}" for k, t in head.items()) + ", cluster int, x0 double, y0 double, x1 double, y1 double, n long, seen long"
    some = persons.select(*keys, "t", *(c for c in order if c != "t"), "x0", "y0", "x1", "y1").withColumn("_window", F.to_json(F.struct(*keys)))
    found = some.repartition(*keys).sortWithinPartitions("_window", *order).drop(*(c for c in order if c != "t")).mapInPandas(clusters, schema)
    total = frames.groupBy(*keys).agg(F.count("*").alias("_frames"))
    found = found.join(total, keys).withColumn("occupancy", F.col("seen") / F.col("_frames"))
    return found.where(F.col("occupancy") >= p.occupancy).drop("_frames", "seen")


def merge_windows(clusters: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """(keys, cluster, x0 .. y1, windows): seats of several calibration windows, taken in order of window and
    row; a seat joins the first merged one of enough IoU.  Boxes are whole pixels before they merge.  Where clusters
    have an energy, a merged seat's is the running mean of theirs."""
    extra = ["energy"] if "energy" in clusters.columns else []
    keys = keys or []
    lead = keys or ["_all"]
    source = clusters if keys else clusters.withColumn("_all", F.lit(0))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["window_id", "row", "col"])
        own, mean = agglomerate(np.trunc(pdf[["x0", "y0", "x1", "y1"]].to_numpy(float)), p.seat_merge_iou, first_match=True)
        windows = pdf.assign(cluster=own).groupby("cluster")["window_id"].nunique()
        out = pd.DataFrame(mean, columns=["x0", "y0", "x1", "y1"])
        out["cluster"], out["windows"] = range(len(out)), windows.to_numpy()
        for c in extra:  # a mean that takes one at a time
            out[c] = [running_mean(pdf[c].to_numpy(float)[own == i]) for i in range(len(out))]
        for k in lead:
            out[k] = pdf[k].iloc[0]
        return out[[*lead, "cluster", "x0", "y0", "x1", "y1", "windows", *extra]]

    types = dict(source.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in lead) + ", cluster int, x0 double, y0 double, x1 double, y1 double, windows long" + "".join(f", {c} double" for c in extra)
    out = source.select(*lead, "window_id", "row", "col", "x0", "y0", "x1", "y1", *extra).groupBy(*lead).applyInPandas(merge, schema)
    return out if keys else out.drop("_all")


def running_mean(values: np.ndarray) -> float:
    mean = 0.0
    for i, v in enumerate(values):
        mean = (mean * i + v) / (i + 1)
    return mean


def with_energy(clusters: DataFrame, energy: DataFrame, rows: int, cols: int, p: Params = DEFAULTS, keys: list[str] | None = None, window: str = "window_id") -> DataFrame:
    """clusters (keys, window, cluster, x0 .. y1, ...) with energy: the mean of the cells their boxes touch.

    energy (keys, cy, cx, energy) of a grid of rows x cols cells; cells that it lacks count as still."""
    keys = keys or []
    own = [*keys, window, "cluster"]
    span = lambda a, b, n: F.explode(F.sequence(to_cell(F.col(a), p.cell_px, n), to_cell(F.col(b), p.cell_px, n)))
    cells = clusters.select(*own, "x0", "x1", span("y0", "y1", rows).alias("cy")).select(*own, "cy", span("x0", "x1", cols).alias("cx"))
    mean = cells.join(energy, [*keys, "cy", "cx"], "left").groupBy(*own).agg(F.avg(F.coalesce("energy", F.lit(0.0))).alias("energy"))
    return clusters.join(mean, own)


def pitch(seats: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """(keys, pitch_h, pitch_w) in cells: the median seat box."""
    return seats.groupBy(*(keys or [])).agg((F.percentile(F.col("y1") - F.col("y0"), F.lit(0.5)) / p.cell_px).alias("pitch_h"), (F.percentile(F.col("x1") - F.col("x0"), F.lit(0.5)) / p.cell_px).alias("pitch_w"))


def _with(left: DataFrame, right: DataFrame, keys: list[str] | None) -> DataFrame:
    """right has one row for each recording (or one row)."""
    return left.join(right, keys) if keys else left.join(F.broadcast(right), F.lit(True))


def number_rows(seats: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """seats (keys, x0 .. y1) with row, col and seat_number: seats whose centres follow within row_gap of the
    median box height form a row; numbers run by row, then x."""
    keys = keys or []
    cy, cx = (F.col("y0") + F.col("y1")) / 2, (F.col("x0") + F.col("x1")) / 2
    s = _with(seats.withColumn("_cy", cy).withColumn("_cx", cx), pitch(seats, p, keys), keys)
    by = Window.partitionBy(*keys).orderBy("_cy", "_cx")
    gap = F.abs(F.col("_cy") - F.lag("_cy").over(by)) > F.col("pitch_h") * p.cell_px * p.row_gap
    s = s.withColumn("_new", F.coalesce(gap.cast("int"), F.lit(0))).withColumn("row", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    s = s.withColumn("col", (F.row_number().over(Window.partitionBy(*keys, "row").orderBy("_cx", "_cy")) - 1).cast("int"))
    s = s.withColumn("seat_number", F.row_number().over(Window.partitionBy(*keys).orderBy("row", "col")))
    return s.drop("_cy", "_cx", "_new", "pitch_h", "pitch_w")


def seat_cells(seats: DataFrame, rows: int, cols: int, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """(keys, seat_id, cy, cx): the grid cells of each seat's box, both ends inclusive."""
    span = lambda a, b, n: F.explode(F.sequence(to_cell(F.col(a), p.cell_px, n), to_cell(F.col(b), p.cell_px, n)))
    keys = keys or []
    return seats.select(*keys, "seat_id", "x0", "x1", span("y0", "y1", rows).alias("cy")).select(*keys, "seat_id", "cy", span("x0", "x1", cols).alias("cx"))


def seat_edges(seats: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None, gap: float | None = None) -> DataFrame:
    """(keys, a, b, distance): pairs a < b of one recording whose centres lie within ``gap`` pitches.

    The pitch is the diagonal of the median seat box.  Seats meet only those of their own and the
    neighbouring strips, each as high as the reach, so the join has an equality.
    """
    keys = keys or []
    gap = p.adjacency_gap if gap is None else gap
    unit = F.greatest(F.hypot("pitch_h", "pitch_w"), F.lit(1e-6)) * p.cell_px
    s = _with(seats, pitch(seats, p, keys), keys).select(*keys, "seat_id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), unit.alias("unit"))
    strip = F.floor(F.col("cy") / (F.col("unit") * gap))
    a = s.select(*keys, F.col("seat_id").alias("a"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), "unit", F.explode(F.array(strip - 1, strip, strip + 1)).alias("_strip"))
    b = s.select(*keys, F.col("seat_id").alias("b"), F.col("cx").alias("bx"), F.col("cy").alias("by"), strip.alias("_strip"))
    out = a.join(b, [*keys, "_strip"]).where(F.col("a") < F.col("b")).withColumn("distance", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) / F.col("unit"))
    return out.where(F.col("distance") <= gap).select(*keys, "a", "b", "distance")


def both_ways(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))


def neighbour_pairs(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Undirected distinct pairs (keys, seat_a < seat_b)."""
    return edges.select(*(keys or []), F.least("a", "b").alias("seat_a"), F.greatest("a", "b").alias("seat_b")).distinct()


def calibration_starts(duration: Column, p: Params = DEFAULTS, start: Column | None = None) -> Column:
    """Array of the starts of the calibration windows: one for short recordings, else evenly to the end."""
    start = F.lit(0.0) if start is None else start
    if p.seat_windows <= 1:
        return F.array(start)
    last = duration - p.calibration_s
    many = F.transform(F.sequence(F.lit(0), F.lit(p.seat_windows - 1)), lambda i: start + last * i / (p.seat_windows - 1))
    return F.when(duration <= 1.5 * p.calibration_s, F.array(start)).otherwise(many)
