"""Person tracks: constant-velocity Kalman states and two-stage assignment within each window.

A window's detections are grouped state: its frames are walked once in order of time, and every
track's state is predicted a frame at a time.  Confident boxes are assigned first, by overlap
weighted with their confidence; tracks that go without are offered the faint boxes, which
keeps a half-hidden person's id but starts none.  Ids count from 1 in each window and say nothing
about another.  Tracks and boxes that hang together by overlaps are assigned apart from the others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, PERSON, Params
from ..functions.geometry import BOX

#: Noise of a state as shares of a box's height (places, speeds), and of its aspect ratio (fixed values).
PLACE, SPEED, ASPECT, ASPECT_SPEED, ASPECT_SEEN = 1 / 20, 1 / 160, 1e-2, 1e-5, 1e-1


def assign(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Pairs (row, column) of the one-to-one assignment with the least sum of cost - limit, pairs below the limit only.

    Shortest augmenting paths over the shorter side; of equal paths the first column.
    """
    if not cost.size or not (cost < limit).any():
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T, limit))
    gain = np.minimum(cost - limit, 0.0)
    n, m = gain.shape
    row_of, u, v = np.full(m + 1, -1), np.zeros(n), np.zeros(m + 1)  # the last column is where a path begins
    for i in range(n):
        row_of[m], j = i, m
        least, via, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while row_of[j] >= 0:
            done[j] = True
            reach = gain[row_of[j]] - u[row_of[j]] - v[:m]
            shorter = ~done[:m] & (reach < least)
            least[shorter], via[shorter] = reach[shorter], j
            k = int(np.where(done[:m], np.inf, least).argmin())
            step = least[k]
            u[row_of[done]] += step
            v[done] -= step
            least[~done[:m]] -= step
            j = k
        while j != m:
            row_of[j], j = row_of[via[j]], via[j]
    return sorted((int(r), c) for c, r in enumerate(row_of[:m]) if r >= 0 and cost[r, c] < limit)


def _shared_out(gain: np.ndarray, room: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) with the least sum of gain; a column holds up to ``room`` rows and only pairs below 0 count.  What hangs
    together by such pairs is solved apart."""
    out, able = [], gain < 0
    of_row, of_column = np.arange(len(gain)), np.full(gain.shape[1], len(gain))
    while able.any():
        of_column = np.where(able, of_row[:, None], len(gain)).min(0)
        least = np.minimum(of_row, np.where(able, of_column[None, :], len(gain)).min(1))
        if (least == of_row).all():
            break
        of_row = least
    for part in np.unique(of_column[of_column < len(gain)]):
        rows, columns = np.flatnonzero(of_row == part), np.flatnonzero(of_column == part)
        own, least = gain[np.ix_(rows, columns)], room[columns]
        if len(columns) > len(rows) and least.max() == 1:
            taken = _flow(own.T, np.ones(len(rows), int))
            out += [(rows[r], columns[c]) for c, r in enumerate(taken) if r >= 0]
        else:
            out += [(rows[r], columns[c]) for r, c in enumerate(_flow(own, least)) if c >= 0]
    return out


def _flow(gain: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The column of each row, -1 for none: rows come one by one, each along the shortest path over columns.

    over[j, k] is the least that a row of the full column j adds by going to k, who[j, k] that row; the last column is
    for those that go without.  A path's work depends on the columns only, not on how many rows they hold.
    """
    n, m = gain.shape
    cost = np.concatenate([np.where(gain < 0, gain, np.inf), np.zeros((n, 1))], 1)
    every, at, free = np.arange(m + 1), np.full(n, m), np.append(room, n)
    over, who, best = np.full((m, m + 1), np.inf), np.zeros((m, m + 1), int), cost.argmin(1)
    for i in range(n):
        end = int(best[i])
        via = None
        if not free[end]:
            dist, via, full = cost[i].copy(), np.full(m + 1, -1), free == 0
            todo = np.flatnonzero(full & (dist < np.inf))
            for _ in range(m):
                step = dist[todo, None] + over[todo]
                by = step.argmin(0)
                step = step[by, every]
                better = step < dist - 1e-12
                dist[better], via[better] = step[better], todo[by[better]]
                todo = np.flatnonzero(better & full)
                if not len(todo):
                    break
            end = int(np.where(full, np.inf, dist).argmin())
        free[end] -= 1
        path = [end]
        while via is not None and via[end] >= 0:
            j = int(via[end])
            at[who[j, end]], end = end, j
            path.append(j)
        at[i] = end
        for j in path:
            if j < m and not free[j]:
                held = np.flatnonzero(at == j)
                more = cost[held] - cost[held, j][:, None]
                by = more.argmin(0)
                over[j], who[j] = more[by, every], held[by]
                over[j, j] = np.inf
    return np.where(at < m, at, -1)


def _apart(a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) in parts such that boxes of different parts share nothing, by cuts across and down."""
    out, todo, both = [], [(np.arange(len(a) + len(b)), 0, 0)], np.concatenate([a, b])
    while todo:
        some, axis, stuck = todo.pop()
        some = some[np.argsort(both[some, axis], kind="stable")]
        cuts = np.flatnonzero(both[some[1:], axis] >= np.maximum.accumulate(both[some, axis + 2])[:-1]) + 1
        if not len(cuts) and stuck:
            some = np.sort(some)
            out.append((some[some < len(a)], some[some >= len(a)] - len(a)))
            continue
        for part in np.split(some, cuts):
            if part.min() < len(a) <= part.max():
                todo.append((part, 1 - axis, 0 if len(cuts) else stuck + 1))
    return out


#: Overlaps that are computed at a time.
OVERLAPS = 1_000_000


def meeting(a: np.ndarray, b: np.ndarray, weight: np.ndarray, limit: float, dense: int = 40_000) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b, pair by pair, of the best assignment by 1 - IoU * weight (of b) below limit.

    Up to ``dense`` pairs are one matrix.  Of more, only boxes that can share anything are held against each other, and
    equal boxes of equal weight stand as one with room for as many, of which the first are taken; the sum is the
    same least one, and of equally good assignments another may be met.
    """
    if len(a) * len(b) <= dense:
        pairs = assign(1 - overlaps(a, b) * weight[None, :], limit)
        return np.array([r for r, _ in pairs], int), np.array([c for _, c in pairs], int)
    kinds, kind, room = np.unique(np.concatenate([b, weight[:, None]], 1), axis=0, return_inverse=True, return_counts=True)
    pairs = []
    for rows, columns in [(np.arange(len(a)), np.arange(len(kinds)))] if limit > 1 else _apart(a, kinds[:, :4]):
        step, own = max(1, OVERLAPS // len(columns)), kinds[columns]
        gain = np.concatenate([1 - overlaps(a[rows[i : i + step]], own[:, :4]) * own[None, :, 4] - limit for i in range(0, len(rows), step)])
        pairs += [(rows[r], columns[c]) for r, c in _shared_out(gain, room[columns])]
    pairs.sort()
    r, c = np.array([x for x, _ in pairs], int), np.array([x for _, x in pairs], int)
    order = np.argsort(c, kind="stable")  # by kind, then row: the n-th row of a kind takes its n-th box
    held, first = np.argsort(kind.reshape(-1), kind="stable"), np.cumsum(room) - room
    place = np.zeros(len(c), int)
    place[order] = np.arange(len(c)) - np.searchsorted(c[order], c[order])
    return r, held[first[c] + place]


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of each of many boxes with each of many others."""
    w = np.maximum(np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]), 0)
    h = np.maximum(np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]), 0)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None, :] - w * h
    return np.where((w * h > 0) & (union > 0), w * h / np.where(union > 0, union, 1), 0.0)


def _measured(boxes: np.ndarray) -> np.ndarray:
    """Centre, aspect ratio and height of boxes (at least 1e-6 high)."""
    high = np.maximum(boxes[:, 3] - boxes[:, 1], 1e-6)
    return np.stack([(boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2, (boxes[:, 2] - boxes[:, 0]) / high, high], 1)


@dataclass
class Tracks:
    """State of a window's tracks, a row each.  Coordinates are independent: of each its value, speed and the three
    entries of their covariance."""

    x: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))
    speed: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))
    xx: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))
    xv: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))
    vv: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))
    id: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # the frame of the last box
    sure: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # confirmed by a second box, or from the first frame

    def boxes(self) -> np.ndarray:
        w = self.x[:, 2] * self.x[:, 3]
        return np.stack([self.x[:, 0] - w / 2, self.x[:, 1] - self.x[:, 3] / 2, self.x[:, 0] + w / 2, self.x[:, 1] + self.x[:, 3] / 2], 1)

    def predict(self, lost: np.ndarray) -> None:
        """A frame on; the height of a track that was not seen in the last frame stops growing."""
        self.speed[lost, 3] = 0.0
        high = self.x[:, 3:4]
        place = np.concatenate([high * PLACE, high * PLACE, np.full_like(high, ASPECT), high * PLACE], 1)
        speed = np.concatenate([high * SPEED, high * SPEED, np.full_like(high, ASPECT_SPEED), high * SPEED], 1)
        self.x = self.x + self.speed
        self.xx, self.xv, self.vv = self.xx + 2 * self.xv + self.vv + place**2, self.xv + self.vv, self.vv + speed**2

    def correct(self, rows: np.ndarray, seen: np.ndarray, frame: int) -> None:
        high = self.x[rows, 3:4]
        noise = np.concatenate([high * PLACE, high * PLACE, np.full_like(high, ASPECT_SEEN), high * PLACE], 1) ** 2
        total = self.xx[rows] + noise
        gain, pull, off = self.xx[rows] / total, self.xv[rows] / total, seen - self.x[rows]
        self.x[rows] += gain * off
        self.speed[rows] += pull * off
        self.vv[rows] -= pull * self.xv[rows]
        self.xv[rows] -= gain * self.xv[rows]
        self.xx[rows] -= gain * self.xx[rows]
        self.seen[rows], self.sure[rows] = frame, True

    def begin(self, seen: np.ndarray, ids: np.ndarray, frame: int) -> None:
        high = seen[:, 3:4]
        place = np.concatenate([2 * high * PLACE, 2 * high * PLACE, np.full_like(high, ASPECT), 2 * high * PLACE], 1)
        speed = np.concatenate([10 * high * SPEED, 10 * high * SPEED, np.full_like(high, ASPECT_SPEED), 10 * high * SPEED], 1)
        new = {"x": seen, "speed": np.zeros_like(seen), "xx": place**2, "xv": np.zeros_like(seen), "vv": speed**2, "id": ids, "seen": np.full(len(ids), frame), "sure": np.full(len(ids), frame == 0)}
        for name, rows in new.items():
            setattr(self, name, np.concatenate([getattr(self, name), rows]))

    def keep(self, rows: np.ndarray) -> None:
        for name in self.__dataclass_fields__:
            setattr(self, name, getattr(self, name)[rows])


def walk(frame: np.ndarray, boxes: np.ndarray, conf: np.ndarray, frames: int, p: Params = DEFAULTS, dense: int = 40_000) -> np.ndarray:
    """The track id of each box of one window, 0 for none; ``frame`` (0 to frames - 1) rises.

    A box that only begins a track has its id once a box of the next frame confirms it; tracks from the
    window's first frame need no confirmation.  A track ends track_buffer frames after its last box.
    """
    tracks, out, fresh, waiting = Tracks(), np.zeros(len(boxes), np.int64), 1, {}
    cut = np.searchsorted(frame, np.arange(frames + 1))
    for f in range(frames):
        if not len(tracks.id) and cut[f] == cut[f + 1]:
            continue
        own = np.arange(cut[f], cut[f + 1])
        tracks.predict(tracks.seen < f - 1)
        at = tracks.boxes()
        strong, faint = own[conf[own] >= p.track_high], own[(conf[own] > p.track_low) & (conf[own] < p.track_high)]
        sure, free = np.flatnonzero(tracks.sure), np.ones(len(tracks.id), bool)

        def meet(rows: np.ndarray, found: np.ndarray, limit: float, fuse: bool) -> np.ndarray:
            """Assigns found boxes to rows; what is left of found."""
            r, c = meeting(at[rows], boxes[found], conf[found] if fuse else np.ones(len(found)), limit, dense)
            r, c = rows[r], found[c]
            if len(r):
                tracks.correct(r, _measured(boxes[c]), f)
                out[c], free[r] = tracks.id[r], False
            return np.setdiff1d(found, c)

        left = meet(sure, strong, p.track_match, True)
        meet(sure[free[sure] & (tracks.seen[sure] == f - 1)], faint, p.track_faint_match, False)
        left = meet(np.flatnonzero(~tracks.sure & free), left, p.track_confirm_match, True)
        for row in np.flatnonzero(tracks.sure & (tracks.seen == f)):
            if (first := waiting.pop(int(tracks.id[row]), None)) is not None:
                out[first] = tracks.id[row]
        new = left[conf[left] >= p.track_new]
        ids = np.arange(fresh, fresh + len(new))
        tracks.keep(np.flatnonzero(tracks.sure & (f - tracks.seen <= p.track_buffer)))
        tracks.begin(_measured(boxes[new]), ids, f)
        fresh += len(new)
        waiting = {}
        if f == 0:
            out[new] = ids
        else:
            waiting = dict(zip(ids.tolist(), new.tolist()))
    return out


def track_persons(detections: DataFrame, frames: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """detections with track_id (null for none) in place of any they had: persons get one, other classes none.

    detections (keys, t, det_idx, cls_id, conf, x0 .. y1, ...), frames (keys, t) with those that hold nothing, as
    a track is predicted over them too.  A group is one window (its length bounds it).  Boxes without a place,
    time or confidence get no id.
    """
    rest = [c for c in detections.columns if c not in (*keys, "track_id")]
    persons = detections.drop("track_id").where(F.col("cls_id") == PERSON)
    other = detections.drop("track_id").where(~F.coalesce(F.col("cls_id") == PERSON, F.lit(False)))
    types = dict(detections.dtypes)

    def track(own: pd.DataFrame, times: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["t", "det_idx"], kind="stable")
        whole = own[["t", "conf", *BOX]].notna().all(axis=1).to_numpy()
        some, ids = own[whole], np.zeros(len(own), np.int64)
        t = some["t"].to_numpy(float)
        times = np.unique(np.concatenate([times["t"].dropna().to_numpy(float), t]))
        ids[whole] = walk(np.searchsorted(times, t), some[list(BOX)].to_numpy(float), some["conf"].to_numpy(float), len(times), p)
        return own.assign(track_id=pd.array(ids, "Int64")).assign(track_id=lambda d: d["track_id"].mask(d["track_id"] == 0))

    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, *rest]) + ", track_id long"
    times = frames.select(*keys, "t").distinct()
    tracked = persons.select(*keys, *rest).groupBy(*keys).cogroup(times.groupBy(*keys)).applyInPandas(track, schema)
    return tracked.unionByName(other.select(*keys, *rest, F.lit(None).cast("long").alias("track_id")))
