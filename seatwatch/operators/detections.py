"""Detections: sampling, suppression, assignment to seats, fixtures, linking, interpolation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BOOK, DEFAULTS, PERSON, PHONE, Params
from ..functions.geometry import BOX, box, box_iou, centre, contains, diagonal, touching
from .seats import Clusters, agglomerate


# --- frames ------------------------------------------------------------------


def sample_targets(start: Column, span: Column, n: Column) -> Column:
    """Array of n even times from start, the end left out."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: start + span * i / n)).otherwise(F.array().cast("array<double>"))


def sweep_samples(duration: Column, p: Params = DEFAULTS) -> Column:
    """How many samples a sparse sweep takes: sweep_step_s apart or more, 1 to sweep_samples."""
    step = F.greatest(F.lit(p.sweep_step_s), duration / p.sweep_samples)
    return F.least(F.greatest(F.floor(duration / step), F.lit(1)), F.lit(p.sweep_samples)).cast("int")


#: Seconds of a recording whose frames are walked together.
FRAME_BLOCK_S = 600.0


def first_frames_after(targets: DataFrame, frames: DataFrame, keys: list[str], tolerance: float = 1e-6, block_s: float = FRAME_BLOCK_S) -> DataFrame:
    """targets (keys, sample, target) with ``t``: the first frame at or after the target; targets past the end drop.

    Blocks of block_s seconds are walked apart, from their end: the next frame is the last one met.  A block that has none
    left takes the first frame of the next block that holds any, from one row a block.
    """
    marks = targets.select(*keys, "sample", "target", (F.col("target") - tolerance).alias("_at"), F.lit(None).cast("double").alias("_t"))
    times = frames.select(*keys, F.lit(None).cast(dict(targets.dtypes)["sample"]).alias("sample"), F.lit(None).cast("double").alias("target"), F.col("t").alias("_at"), F.col("t").alias("_t"))
    both = marks.unionByName(times).withColumn("_block", F.floor(F.col("_at") / block_s)).where(F.col("_block").isNotNull())
    back = Window.partitionBy(*keys, "_block").orderBy(F.col("_at").desc(), F.col("_t").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_own", F.last("_t", ignorenulls=True).over(back)).where(F.col("sample").isNotNull())
    later = Window.partitionBy(*keys).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy(*keys, "_block").agg(F.min("_t").alias("_first")).withColumn("_later", F.last("_first", ignorenulls=True).over(later))
    out = met.join(blocks.drop("_first"), [*keys, "_block"]).withColumn("t", F.coalesce("_own", "_later"))
    return out.where(F.col("t").isNotNull()).select(*keys, "sample", "target", "t")


def thin_frames(frames: DataFrame, fps: float | None, keys: list[str], p: Params = DEFAULTS, block_s: float = FRAME_BLOCK_S) -> DataFrame:
    """The frames (keys, t) that a greedy reader at ``fps`` (None: the parameters') keeps: the next is due 1 / fps after the last kept.

    Blocks of block_s seconds are walked apart.  What a block keeps follows from the first frame that it keeps; each that may
    be that one (those of its first step) is followed to the block's end, and one pass over these few rows a block finds
    where each block starts.
    """
    step = 1.0 / (fps or p.fps)
    block = F.floor(F.col("t") / block_s).cast("long").alias("_block")
    at = frames.where(F.col("t").isNotNull()).select(*keys, block, F.col("t").cast("double").alias("t"))
    types = dict(at.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in [*keys, "_block"])

    def like(table: pa.Table, **columns) -> pa.Table:
        """columns under the keys of the table's one group."""
        n = len(next(iter(columns.values())))
        lead = {k: table[k].take(np.zeros(n, int)) for k in table.column_names if k in keys or k == "_block"}
        return pa.table({**lead, **{c: pa.array(v) for c, v in columns.items()}})

    def ways(table: pa.Table) -> pa.Table:
        t = np.sort(table["t"].to_numpy())
        after = np.searchsorted(t, t + step)
        last = np.where(after < len(t), after, np.arange(len(t)))
        while (last[last] != last).any():  # twice as far in each round
            last = last[last]
        some = int(after[0]) + 1  # the last frame before the block may be due as late as the first one's next
        return like(table, t=t[:some], due=t[last[:some]] + step)

    def starts(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_block", "ascending"), ("t", "ascending")])
        block, t, due = (table[c].to_numpy() for c in ("_block", "t", "due"))
        cuts = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
        rows, at = [], -np.inf
        for a, b in zip(cuts, [*cuts[1:], len(t)]):
            i = a + int(np.searchsorted(t[a:b], at))
            if i < b:
                rows.append(i)
                at = due[i]
        return table.take(np.array(rows, int)).select([*keys, "_block", "t"])

    def keep(table: pa.Table, start: pa.Table) -> pa.Table:
        t = np.sort(table["t"].to_numpy())
        after = np.searchsorted(t, t + step)
        kept, i = [], int(np.searchsorted(t, start["t"][0].as_py())) if len(start) else len(t)
        while i < len(t):
            kept.append(i)
            i = int(after[i])
        return like(table, t=t[np.array(kept, int)]).drop_columns("_block")

    first = at.groupBy(*keys, "_block").applyInArrow(ways, f"{head}, t double, due double").groupBy(*keys).applyInArrow(starts, f"{head}, t double")
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "t double"])
    return at.groupBy(*keys, "_block").cogroup(first.groupBy(*keys, "_block")).applyInArrow(keep, schema)


def scan_detections(detections: DataFrame, least: dict[int, float]) -> DataFrame:
    """Detections of the wanted classes with at least their class's confidence; the conditions reach a Parquet scan."""
    wanted = F.lit(False)
    for cls, conf in least.items():
        wanted = wanted | ((F.col("cls_id") == cls) & (F.col("conf") >= conf))
    return detections.where(wanted)


# --- suppression ---------------------------------------------------------------


def detection_sizes(width: Column, height: Column, p: Params = DEFAULTS) -> Column:
    """Input sizes at which a crop is searched for small objects: the fixed ones, and its own longer side rounded to
    scale_step, within least_scale and most_scale, if that is another."""
    native = F.least(F.greatest(F.bround(F.greatest(width, height) / p.scale_step) * p.scale_step, F.lit(p.least_scale)), F.lit(p.most_scale)).cast("int")
    return F.array_distinct(F.array(*map(F.lit, p.scales), native))


def to_frame(detections: DataFrame, rois: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes found in a window's crop as boxes of the whole frame.  rois (keys, x0, y0, ...): where the crops lie."""
    at = rois.select(*keys, F.col("x0").alias("_x"), F.col("y0").alias("_y"))
    moved = {c: F.col(c) + F.col("_x" if c[0] == "x" else "_y") for c in BOX}
    return detections.join(at, keys).withColumns(moved).select(*detections.columns)


def merge_scales(scales: list[DataFrame], p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """Detections of several input sizes as one set, without doubles."""
    keys = keys or ["frame"]
    out = scales[0].withColumn("scale", F.lit(0))
    for i, s in enumerate(scales[1:], 1):
        out = out.unionByName(s.withColumn("scale", F.lit(i)))
    order = Window.partitionBy(*keys).orderBy("scale", "det_idx")
    return suppress(out.withColumn("det_idx", F.row_number().over(order).cast("long")).drop("scale"), p, keys)


def kept_boxes(boxes: np.ndarray, most: float) -> np.ndarray:
    """Which of boxes (in order of rank) greedy suppression keeps: those that no kept one before them overlaps by more than ``most``.

    Boxes lie in a grid by their first corner.  Boxes that overlap by more than a share have sides and corners that differ
    by little, so a kept box looks at the cells nearby only, and at boxes that are still open.
    """
    whole = np.isfinite(boxes).all(axis=1)
    wide, high = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
    keep = ~(whole & (wide > 0) & (high > 0))  # the rest overlap nothing
    area, slack = wide * high, (1 - most) / most if most > 0 else np.inf
    todo = np.flatnonzero(~keep)
    gone = keep.copy()
    while len(todo):
        x, y = boxes[todo, 0], boxes[todo, 1]
        cell = lambda at, side: max(float(np.median(side[todo])) / 2, float(np.ptp(at)) / 255, 1e-9)
        cx, cy, left, top = cell(x, wide), cell(y, high), float(x.min()), float(y.min())
        column, row = ((x - left) // cx).astype(np.int64), ((y - top) // cy).astype(np.int64)
        columns, rows = int(column.max()) + 1, int(row.max()) + 1
        place = row * columns + column
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(rows * columns + 1)).tolist()
        own = todo[order]
        closed, limit = 0, max(64, len(todo) // 2)
        for i in todo.tolist():
            if gone[i]:
                continue
            gone[i] = keep[i] = True
            x0, y0, x1, y1 = boxes[i].tolist()
            dx, dy = slack * (x1 - x0) * (1 + 1e-9) + 1e-9 * cx, slack * (y1 - y0) * (1 + 1e-9) + 1e-9 * cy
            at = lambda v, last: int(min(max(v, 0), last))
            c0, c1 = at((x0 - dx - left) / cx - 1e-6, columns - 1), at((x0 + dx - left) / cx + 1e-6, columns - 1)
            r0, r1 = at((y0 - dy - top) / cy - 1e-6, rows - 1), at((y0 + dy - top) / cy + 1e-6, rows - 1)
            near = np.concatenate([own[cuts[r * columns + c0] : cuts[r * columns + c1 + 1]] for r in range(r0, r1 + 1)])
            near = near[~gone[near]]
            closed += 1
            if len(near):
                b = boxes[near]
                w = np.maximum(np.minimum(x1, b[:, 2]) - np.maximum(x0, b[:, 0]), 0.0)
                h = np.maximum(np.minimum(y1, b[:, 3]) - np.maximum(y0, b[:, 1]), 0.0)
                shared = w * h
                hit = near[(shared > 0) & (shared / (area[i] + area[near] - shared) > most)]
                gone[hit] = True
                closed += len(hit)
            if closed > limit:
                break
        todo = todo[~gone[todo]]  # a new grid of those that are open
    return np.flatnonzero(keep)


def suppress(detections: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """Greedy non-maximum suppression: by falling confidence (then det_idx) a box stays unless a kept one of
    its frame and class overlaps it by more than nms_iou.  A suppressed box suppresses nothing.  A group is one
    class of a frame."""
    lead = [*(keys or ["frame"]), "cls_id"]

    def stay(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("_null", "descending"), ("conf", "descending"), ("det_idx", "ascending")]))
        boxes = np.stack([table[c].cast(pa.float64()).to_numpy() for c in BOX], 1)
        return table.take(kept_boxes(boxes, p.nms_iou)).drop_columns("_null")

    rows = detections.withColumn("_null", F.col("conf").isNull())
    return rows.groupBy(*lead).applyInArrow(stay, detections.schema)


def perceive(persons: DataFrame, objects: DataFrame, keys: list[str]) -> DataFrame:
    """Tracked persons and small objects of one window's frames (keys, t) as one set; times meet on four decimals."""
    at = F.round("t", 4)
    return persons.withColumn("t", at).unionByName(objects.withColumn("t", at), allowMissingColumns=True)


# --- seats ---------------------------------------------------------------------


def assign_seats(detections: DataFrame, window_seats: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """detections (keys, frame, det_idx, x0 .. y1) with seat_id and how (iou, centre, or null).

    The seat of the highest IoU, of equal ones the first by ``ord``, if that is at least assign_iou; else
    of the seats that contain the centre the one whose own centre is nearest.  window_seats (keys, seat_id,
    ord, x0 .. y1); a detection meets only its own window's seats.
    """
    d = box()
    cx, cy = centre(d)

    def rank(m):
        sx, sy = centre(_sides(m["s"]))
        strong = m["iou"] >= p.assign_iou
        far = F.when(contains(_sides(m["s"]), cx, cy), F.round(F.hypot(cx - sx, cy - sy), 9))
        return F.struct(F.when(strong, m["iou"]).alias("iou"), F.when(~strong, -far).alias("near"), (-m["s"]["ord"]).alias("o"), m["s"]["seat_id"].alias("seat_id"))

    # a window's few seats stand beside each of its detections: no rows are multiplied, nothing is grouped again
    pairs = detections.join(window_seats.groupBy(*keys).agg(F.collect_list(F.struct("seat_id", "ord", *(F.col(c).cast("double").alias(c) for c in BOX))).alias("_seats")), keys, "left")
    met = F.transform(_met(F.col("_seats"), d), lambda m: F.struct(m["s"].alias("s"), F.round(m["iou"], 12).alias("iou")))
    ranks = F.transform(met, rank)
    best = pairs.withColumn("_best", F.array_max(F.filter(ranks, lambda r: r["iou"].isNotNull() | r["near"].isNotNull())))
    return best.select(*detections.columns, F.col("_best.seat_id").alias("seat_id"), F.when(F.col("_best.iou").isNotNull(), "iou").when(F.col("_best.near").isNotNull(), "centre").alias("how"))


def assign_sweep(detections: DataFrame, seats: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """As assign_seats for sparse sweeps: the highest IoU above 0, else the first seat that contains the centre; of equal
    ones the smallest seat_id.  Detections without a seat are left out.

    seats (keys, seat_id, x0 .. y1): all of a recording.
    """
    d = box()
    cx, cy = centre(d)
    near = _beside(detections, seats, keys)
    good = F.filter(_met(F.col("_seats"), d), lambda m: (m["iou"] > 0) | contains(_sides(m["s"]), cx, cy))
    ranks = F.transform(good, lambda m: F.struct(F.round(m["iou"], 12).alias("iou"), (-m["s"]["seat_id"]).alias("o"), m["s"]["seat_id"].alias("seat_id")))
    # exploded, not filtered: a filter would be moved below and rank everything twice
    best = near.withColumn("_best", F.explode(F.array_compact(F.array(F.array_max(ranks)))))
    return best.select(*detections.columns, F.col("_best.seat_id").alias("seat_id"))


def _sides(s: Column) -> tuple:
    return tuple(s[c] for c in BOX)


def _met(seats: Column, d: tuple) -> Column:
    """Of an array of seats those that touch box d, as array<struct<s, iou>>.  The formula of
    box_iou in steps, as a lambda computes anew whatever its text repeats."""

    def shared(s):
        w, h = F.least(d[2], s["x1"]) - F.greatest(d[0], s["x0"]), F.least(d[3], s["y1"]) - F.greatest(d[1], s["y0"])
        return F.struct(s.alias("s"), (F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))).alias("shared"))

    def union(m):
        s = m["s"]
        return F.struct(s.alias("s"), m["shared"].alias("shared"), ((d[2] - d[0]) * (d[3] - d[1]) + (s["x1"] - s["x0"]) * (s["y1"] - s["y0"]) - m["shared"]).alias("union"))

    def iou(m):
        return F.struct(m["s"].alias("s"), F.when((m["shared"] > 0) & (m["union"] > 0), m["shared"] / m["union"]).otherwise(0.0).alias("iou"))

    near = F.filter(seats, lambda s: touching(d, _sides(s)))
    return F.transform(F.transform(F.transform(near, shared), union), iou)


def _beside(detections: DataFrame, seats: DataFrame, keys: list[str] | None) -> DataFrame:
    """detections with _seats: the seats of their camera (tens), as an array; of the keys' recording, or of all, which
    then must be one recording's."""
    if not keys and "video" in seats.columns:
        raise ValueError("seats of several recordings need keys")
    s = seats.groupBy(*(keys or [])).agg(F.collect_list(F.struct("seat_id", *(F.col(c).cast("double").alias(c) for c in BOX))).alias("_seats"))
    return detections.join(s, keys, "left") if keys else detections.join(F.broadcast(s), F.lit(True))  # one row


def unseated_persons(detections: DataFrame, seats: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """Persons that no seat (of their recording, the keys) overlaps by unseated_iou."""
    persons = _beside(detections.where(F.col("cls_id") == PERSON), seats, keys)
    taken = F.exists(_met(F.col("_seats"), box()), lambda m: m["iou"] >= p.unseated_iou)
    return persons.where(~F.coalesce(taken, F.lit(False))).select(*detections.columns)


def unseated_counts(frames: DataFrame, detections: DataFrame, seats: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None, recording: list[str] | None = None) -> DataFrame:
    """frames (keys, ...) with the number of unseated persons (0 kept) and the box around them (null at 0).
    recording: those of the keys that seats have too."""
    keys = keys or ["frame"]
    groups = unseated_persons(detections, seats, p, recording).groupBy(*keys).agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return frames.join(groups, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def person_counts(frames: DataFrame, detections: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """frames (keys, ...) with how many persons each holds; 0 is kept."""
    keys = keys or ["frame"]
    n = detections.where((F.col("cls_id") == PERSON) & (F.col("conf") >= p.detection_conf)).groupBy(*keys).agg(F.count("*").alias("n"))
    return frames.join(n, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def persons_tracked(windows: DataFrame, detections: DataFrame, keys: list[str]) -> DataFrame:
    """windows (keys, ...) with n_persons: how many different tracked persons each saw; 0 is kept."""
    n = detections.where(F.col("cls_id") == PERSON).groupBy(*keys).agg(F.countDistinct("track_id").alias("n_persons"))
    return windows.join(n, keys, "left").withColumn("n_persons", F.coalesce("n_persons", F.lit(0)))


# --- fixtures ------------------------------------------------------------------


def all_frames(sweep: DataFrame, evidence: DataFrame) -> DataFrame:
    """Detections of the sweep and of all evidence windows as one set: what the fixture map is made of, as the sweep
    alone misses small objects that the windows see.  Columns that one part lacks are null; nothing is dropped,
    as a window may see a frame again."""
    return sweep.unionByName(evidence, allowMissingColumns=True)


def hull(points: list[list[float]]) -> list[list[float]]:
    """The corners of the points' convex hull."""
    points = sorted(set(map(tuple, points)))
    if len(points) < 3:
        return [list(x) for x in points]
    sides = []
    for row in (points, points[::-1]):
        side: list[tuple] = []
        for c in row:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (c[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (c[0] - side[-2][0]):
                side.pop()
            side.append(c)
        sides += side[:-1]
    return [list(x) for x in sides]


def fixture_map(detections: DataFrame, frames: DataFrame, p: Params = DEFAULTS, classes: list[int] | None = None, keys: list[str] | None = None, block_s: float | None = None) -> DataFrame:
    """(keys, cls_id, cluster, x0 .. y1, n, presence, span_s, drift): small objects that are long there and do not move.

    detections (keys, t, det_idx, cls_id, x0 .. y1), frames (keys, t).  Recordings of under fixture_samples frames have none.
    Boxes are clustered in order of (t, det_idx), those of one class and recording in one walk, of which only the clusters are
    held; with block_s in blocks of so many seconds, each a walk of its own, whose clusters are then clustered in the same way,
    each weighing as many boxes as it has.  So the walks are spread; a cluster that the walk over all boxes would have
    joined late may stay apart, or join another.
    """
    keys = keys or []
    lead = [*keys, "cls_id"]
    some = detections.where(F.col("cls_id").isin(classes)) if classes else detections
    block = F.floor(F.col("t") / block_s).cast("long") if block_s else F.lit(0).cast("long")
    types = dict(detections.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in lead) + ", block long"

    def done(key: tuple, found: Clusters, state: dict) -> pd.DataFrame:
        out = pd.DataFrame({"part": range(found.k), **{c: found.mean[: found.k, i] for i, c in enumerate(BOX)}, **state})
        return out.assign(**dict(zip([*lead, "block"], key)))[names]

    def cluster(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups come one after another, in parts: of their boxes only the clusters are kept, of a cluster's centres those
        that can be the farthest from a point, its hull."""
        key = None
        for pdf in parts:
            same = pdf["_group"].to_numpy()
            for a, b in zip(cuts := np.flatnonzero(np.append(True, same[1:] != same[:-1])), [*cuts[1:], len(pdf)]):
                if same[a] != key:
                    if key is not None:
                        yield done(group, found, state)
                    key, group, found = same[a], tuple(pdf[k].iloc[a] for k in [*lead, "block"]), Clusters(p.fixture_iou, last_tie=True)
                    state = {c: [] for c in ("size", "n", "start", "stop", "sx", "sy", "hull", "times")}
                boxes, t = pdf[list(BOX)].to_numpy(float)[a:b], pdf["t"].to_numpy(float)[a:b]
                at = np.stack([(boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2], 1)
                own, rounded = found.add(boxes), pdf["_rounded"].to_numpy(float)[a:b]
                order = np.argsort(own, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                    c = int(own[rows[0]])
                    while len(state["n"]) <= c:
                        for name, new in zip(state, (0, 0, np.inf, -np.inf, 0.0, 0.0, [], [])):
                            state[name].append(new if not isinstance(new, list) else list(new))
                    times, before = np.unique(rounded[rows]), state["times"][c]
                    times = times[times > before[-1]] if before else times  # they rise within a group
                    state["n"][c] += len(times)
                    state["times"][c] = [*before, *times.tolist()] if block_s else [*before, *times.tolist()][-1:]
                    state["size"][c] += len(rows)
                    state["start"][c], state["stop"][c] = min(state["start"][c], t[rows].min()), max(state["stop"][c], t[rows].max())
                    state["sx"][c], state["sy"][c] = state["sx"][c] + at[rows, 0].sum(), state["sy"][c] + at[rows, 1].sum()
                    state["hull"][c] = hull([*state["hull"][c], *at[rows].tolist()])
        if key is not None:
            yield done(group, found, state)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "part"])
        own, mean = agglomerate(pdf[list(BOX)].to_numpy(float), p.fixture_iou, last_tie=True, weights=pdf["size"].to_numpy(int))
        out = pdf[[*lead, "block", "part"]].assign(cluster=own)
        for i, c in enumerate(BOX):
            out[c] = mean[own, i]
        return out

    sides = "x0 double, y0 double, x1 double, y1 double"
    names = [*lead, "block", "part", *BOX, "size", "n", "start", "stop", "sx", "sy", "hull", "times"]
    group = F.to_json(F.struct(*lead, block.alias("block"))).alias("_group")
    slim = some.select(*lead, block.alias("block"), F.col("t").cast("double").alias("t"), F.round(F.col("t").cast("double"), 3).alias("_rounded"), "det_idx", *BOX, group)
    ordered = slim.repartition(*lead, "block").sortWithinPartitions("_group", "t", "det_idx").drop("det_idx")
    found = ordered.mapInPandas(cluster, f"{head}, part int, {sides}, size long, n long, start double, stop double, sx double, sy double, hull array<array<double>>, times array<double>")
    if block_s:
        found = found.persist()  # read twice: to merge, and for what is summed up of the merged
        merged = found.select(*lead, "block", "part", "size", *BOX).groupBy(*lead).applyInPandas(merge, f"{head}, part int, cluster int, {sides}")
        whole = found.drop(*BOX).join(merged, [*lead, "block", "part"]).groupBy(*lead, "cluster", *BOX)
        found = whole.agg(
            *(F.sum(c).alias(c) for c in ("size", "sx", "sy")), F.size(F.array_distinct(F.flatten(F.collect_list("times")))).cast("long").alias("n"),
            F.min("start").alias("start"), F.max("stop").alias("stop"), F.flatten(F.collect_list("hull")).alias("hull"),
        )
    else:
        found = found.withColumnRenamed("part", "cluster")
    far = F.array_max(F.transform("hull", lambda c: F.hypot(c[0] - F.col("sx") / F.col("size"), c[1] - F.col("sy") / F.col("size"))))
    found = found.select(*lead, "cluster", *BOX, "n", (F.col("stop") - F.col("start")).alias("span_s"), far.alias("_far"))
    total = frames.groupBy(*keys).agg(F.countDistinct("t").alias("_frames"), (F.max("t") - F.min("t")).alias("_span"))
    found = found.join(total, keys) if keys else found.join(F.broadcast(total), F.lit(True))
    drift = F.col("_far") / F.greatest(diagonal(box()), F.lit(1.0))
    found = found.withColumn("presence", F.col("n") / F.col("_frames")).withColumn("drift", drift)
    need = F.least(F.lit(p.fixture_span_s), F.col("_span") * p.fixture_span_share)
    good = (F.col("_frames") >= p.fixture_samples) & (F.col("n") >= p.fixture_samples) & (F.col("presence") >= p.fixture_presence) & (F.col("span_s") >= need) & (F.col("drift") <= p.fixture_drift)
    return found.where(good).select(*lead, "cluster", *BOX, "n", "presence", "span_s", "drift")


def drop_fixtures(detections: DataFrame, fixtures: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """detections without those that a fixture of their class overlaps by fixture_iou."""
    lead = [*(keys or []), "cls_id"]
    f = fixtures.select(*(F.col(k).alias(f"f_{k}") for k in (*lead, *BOX)))
    on = box_iou(box(), box("f_")) >= p.fixture_iou
    for k in lead:
        on = on & (F.col(k) == F.col(f"f_{k}"))
    return detections.join(f, on, "left_anti")


# --- tracks --------------------------------------------------------------------


def nearest_free(at: np.ndarray, last: np.ndarray, reach: float, dense: int = 40_000) -> np.ndarray:
    """For each point of ``at``, in order, the nearest of ``last`` (strictly under reach, of equal ones the first) that none before
    it has taken, or -1.

    Many points lie in a grid with few to a cell, which is made anew as they are taken; a point looks at rings of cells until
    none farther out can be nearer.  Points at one place are one entry.
    """
    out = np.full(len(at), -1)
    whole = np.flatnonzero(np.isfinite(last).all(axis=1))
    asked = np.flatnonzero(np.isfinite(at).all(axis=1))
    if len(asked) * len(whole) <= dense:
        far = np.sqrt((at[asked, None, 0] - last[whole][None, :, 0]) ** 2 + (at[asked, None, 1] - last[whole][None, :, 1]) ** 2)
        for i, row in zip(asked, far):
            if len(whole) and row[k := int(row.argmin())] < reach:
                out[i] = whole[k]
                far[:, k] = np.inf
        return out
    taken, free, built = np.zeros(len(last), bool), len(whole), 0
    for i in asked.tolist():
        if not free:
            break
        if not built or free < built // 2:
            left = whole[~taken[whole]]
            (x0, y0), (wide, high) = last[left].min(axis=0).tolist(), np.ptp(last[left], axis=0).tolist()
            side = max(math.sqrt(wide * high / len(left)), max(wide, high) / len(left), 1e-9) * 1.5
            cells: dict[tuple[int, int], dict[tuple[float, float], list[int]]] = {}
            for k, (x, y) in zip(left[::-1].tolist(), last[left[::-1]].tolist()):  # the first of a place is on top
                cells.setdefault((int((x - x0) // side), int((y - y0) // side)), {}).setdefault((x, y), []).append(k)
            columns, rows, built = int(wide // side), int(high // side), len(left)
        x, y = at[i].tolist()
        cx, cy = int((x - x0) // side), int((y - y0) // side)
        r = max(0, -cx, cx - columns, -cy, cy - rows)  # rings before it lie outside
        final = max(cx, columns - cx, cy, rows - cy)
        best, first, where = reach, -1, None
        while r <= final and (r - 1) * side <= best:
            if r:
                ring = [(c, d) for d in {cy - r, cy + r} if 0 <= d <= rows for c in range(max(cx - r, 0), min(cx + r, columns) + 1)]
                ring += [(c, d) for c in {cx - r, cx + r} if 0 <= c <= columns for d in range(max(cy - r + 1, 0), min(cy + r - 1, rows) + 1)]
            else:
                ring = [(cx, cy)]
            for c in ring:
                for place, stack in cells.get(c, {}).items():
                    dx, dy = x - place[0], y - place[1]
                    far = math.sqrt(dx * dx + dy * dy)
                    if far < best or (far == best and first >= 0 and stack[-1] < first):
                        best, first, where = far, stack[-1], (c, place)
            r += 1
        if where:
            out[i] = first
            taken[first] = True
            free -= 1
            c, place = where
            cells[c][place].pop()
            if not cells[c][place]:
                del cells[c][place]
    return out


def link_centroids(detections: DataFrame, max_dist: float | str, start_id: int | str, keys: list[str] | None = None) -> DataFrame:
    """detections of each window and class with track_id, by greedy nearest-centroid linking.
    max_dist, start_id: numbers, or columns that hold one for each window and class.

    In order of frame and det_idx a box takes the nearest centroid (strictly under max_dist, of equal ones the
    first) of the last frame that had any, if its id is free in this frame; else a new id.  Ids of a window say
    nothing about another.
    """
    lead = [*(keys or ["window_id"]), "cls_id"]

    def link(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("t", "ascending"), ("det_idx", "ascending")]))
        side = {c: table[c].cast(pa.float64()).to_numpy() for c in BOX}
        centres = np.stack([(side["x0"] + side["x1"]) / 2, (side["y0"] + side["y1"]) / 2], 1)
        one = lambda x: table[x][0].as_py() if isinstance(x, str) else x
        reach, fresh = float(one(max_dist)), int(one(start_id))
        ids = np.zeros(len(centres), np.int64)
        last = np.zeros(0, int)
        frames = np.flatnonzero(np.diff(table["t"].cast(pa.float64()).to_numpy(), prepend=np.nan) != 0)
        for a, b in zip(frames, [*frames[1:], len(centres)]):
            found = nearest_free(centres[a:b], centres[last], reach)
            new = found < 0
            ids[a:b][~new] = ids[last[found[~new]]]
            ids[a:b][new] = np.arange(fresh, fresh + new.sum())
            fresh += int(new.sum())
            last = np.arange(a, b)
        return table.append_column("track_id", pa.array(ids))

    some = detections.drop("track_id")
    return some.groupBy(*lead).applyInArrow(link, ", ".join(f"`{n}` {t}" for n, t in some.dtypes) + ", track_id long")


def link_objects(detections: DataFrame, rois: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """Phones and papers of each window with track_id: a link spans link_share of the width of the window's region
    (rois: keys, x0, x1), link_least pixels at least.  The two classes' ids begin apart; other classes are left out."""
    keys = keys or ["window_id"]
    reach = rois.select(*keys, F.greatest(F.lit(p.link_least), (F.col("x1") - F.col("x0")) * p.link_share).alias("_reach"))
    start = F.when(F.col("cls_id") == BOOK, p.paper_ids).otherwise(p.phone_ids).alias("_start")
    some = detections.where(F.col("cls_id").isin(PHONE, BOOK)).join(reach, keys).select("*", start)
    return link_centroids(some, "_reach", "_start", keys).drop("_reach", "_start")


def displacement(tracks: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """(keys, track_id, n, displacement): twice the farthest distance from the track's mean centre, in its own
    median diagonals.  tracks (keys, track_id, cx, cy, diag).  Short tracks and specks are left out."""
    lead = [*(keys or ["window_id"]), "track_id"]
    mean = tracks.groupBy(*lead).agg(F.avg("cx").alias("_mx"), F.avg("cy").alias("_my"))
    out = tracks.join(mean, lead).groupBy(*lead).agg(F.count("*").alias("n"), F.max(F.hypot(F.col("cx") - F.col("_mx"), F.col("cy") - F.col("_my"))).alias("_far"), F.percentile("diag", F.lit(0.5)).alias("_diag"))
    out = out.where((F.col("n") >= p.transit_frames) & (F.col("_diag") > 1.0))
    return out.select(*lead, "n", (2 * F.col("_far") / F.col("_diag")).alias("displacement"))


def person_roles(tracks: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """Every track's role: staff where its displacement reaches the transit threshold, else student."""
    lead = [*(keys or ["window_id"]), "track_id"]
    moved = displacement(tracks, p, keys)
    return tracks.select(*lead).distinct().join(moved, lead, "left").select(*lead, F.when(F.col("displacement") >= p.transit_displacement, "staff").otherwise("student").alias("role"))


def interpolate(samples: DataFrame, targets: DataFrame, values: list[str], keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """targets (keys, t) with values interpolated between the samples (keys, t, values) around them.

    Outside the samples the nearest one holds for hold_s; targets beyond that drop.  Several samples of one
    time stand in for one another (the first by value).  One pass in order of time.
    """
    s = samples.groupBy(*keys, "t").agg(F.min(F.struct(*values)).alias("_s")).select(*keys, "t", F.struct("t", "_s.*").alias("_s"), F.lit(False).alias("_target"))
    q = targets.select(*keys, "t", F.lit(None).cast(s.schema["_s"].dataType).alias("_s"), F.lit(True).alias("_target"))
    by, back = Window.partitionBy(*keys).orderBy("t", "_target"), Window.partitionBy(*keys).orderBy(F.col("t").desc(), F.col("_target").desc())
    u = s.unionByName(q)
    # both run from an end: a window to the last row is walked anew for each row
    u = u.withColumn("_before", F.last("_s", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_after", F.last("_s", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    u = u.where("_target")
    a, b, t = F.col("_before"), F.col("_after"), F.col("t")
    share = (t - a["t"]) / F.greatest(b["t"] - a["t"], F.lit(1e-6))
    held = (a.isNotNull() & b.isNotNull()) | (b["t"] - t <= p.hold_s) | (t - a["t"] <= p.hold_s)
    mixed = [F.when(a.isNull(), b[v]).when(b.isNull(), a[v]).otherwise(a[v] + share * (b[v] - a[v])).alias(v) for v in values]
    return u.where(held).select(*keys, "t", *mixed)
