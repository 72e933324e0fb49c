"""Person tracks against a plain tracker: full covariance matrices, assignments by trying all."""

from itertools import combinations, permutations

import numpy as np
import pytest

from seatwatch.config import DEFAULTS as P
from seatwatch.operators import tracking


def all_assignments(cost, limit):
    """The least sum of cost - limit over every one-to-one assignment."""
    n, m = len(cost), len(cost[0]) if len(cost) else 0
    best, pairs = 0.0, []
    for k in range(1, min(n, m) + 1):
        for rows in combinations(range(n), k):
            for cols in permutations(range(m), k):
                total = sum(cost[r][c] - limit for r, c in zip(rows, cols))
                if total < best - 1e-12 and all(cost[r][c] < limit for r, c in zip(rows, cols)):
                    best, pairs = total, sorted(zip(rows, cols))
    return best, pairs


def test_assignment_equals_trying_all():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, m = rng.integers(0, 5), rng.integers(0, 6)
        cost = np.round(rng.random((n, m)), 1 + rng.integers(3))
        got = tracking.assign(cost, 0.6)
        assert len({r for r, _ in got}) == len({c for _, c in got}) == len(got)
        assert abs(sum(cost[r, c] - 0.6 for r, c in got) - all_assignments(cost.tolist(), 0.6)[0]) < 1e-9


def crowd(seed, people, frames=8):
    """Boxes of five places, many of them equal, and confidences of four steps."""
    rng = np.random.default_rng(seed)
    k, step = rng.integers(0, 5, (frames, people)), rng.integers(0, 4, (frames, people)) * 1.0
    x, y = 110.0 * k + step, 200 + 150.0 * (k % 2) - step
    return np.repeat(np.arange(frames), people), np.stack([x, y, x + 70 + step, y + 140], 2).reshape(-1, 4), rng.choice([0.15, 0.29, 0.5, 0.8], frames * people)


def test_assignment_in_parts_has_the_least_sum():
    """Boxes of several places, equal ones among them, against the dense matrix; unequal ones give the same pairs."""
    rng = np.random.default_rng(1)
    for i in range(120):
        n, m = rng.integers(0, 40, 2)
        a = rng.uniform(0, 300, (n, 4)) if i % 2 else crowd(i, n, 1)[1] + rng.normal(0, 2, (n, 4))
        b, weight = (rng.uniform(0, 300, (m, 4)), rng.random(m)) if i % 2 else crowd(i + 1000, m, 1)[1:]
        a, b = (np.concatenate([x[:, :2], x[:, :2] + np.maximum(x[:, 2:] - x[:, :2], 5 + x[:, 2:] / 4)], 1) for x in (a, b))
        limit = (0.5, 0.8, 1.2)[i % 3]
        cost = 1 - tracking.overlaps(a, b) * weight[None, :]
        (r, c), want = tracking.meeting(a, b, weight, limit, dense=0), tracking.assign(cost, limit)
        assert len(set(r)) == len(set(c)) == len(r) and (cost[r, c] < limit).all()
        assert abs((cost[r, c] - limit).sum() - sum(cost[j, k] - limit for j, k in want)) < 1e-9
        assert limit > 1 or i % 2 == 0 or list(zip(r, c)) == want


def test_tracks_of_thousands_in_a_frame():
    """A dense matrix of 3,000 x 3,000 takes minutes a frame."""
    from time import monotonic

    frame, boxes, conf = crowd(0, 3000, 4)
    began = monotonic()
    ids = tracking.walk(frame, boxes, conf, 4)
    assert monotonic() - began < 30
    for f in range(4):
        own = ids[frame == f]
        assert len(np.unique(own[own > 0])) == (own > 0).sum() > 2000
        assert all(len(np.unique(boxes[(ids == t), 0] // 110)) == 1 for t in own[own > 0][:50])  # a track keeps its place


def share(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


class Plain:
    """One track: an eight-dimensional Kalman filter with whole matrices."""

    def __init__(self, z, f):
        h = z[3]
        self.m = np.array([*z, 0, 0, 0, 0])
        self.c = np.diag([2 * h / 20, 2 * h / 20, 1e-2, 2 * h / 20, 10 * h / 160, 10 * h / 160, 1e-5, 10 * h / 160]) ** 2
        self.f, self.sure, self.id = f, f == 0, None

    def predict(self, f):
        if self.f < f - 1:
            self.m[7] = 0
        h = self.m[3]
        go = np.eye(8) + np.eye(8, k=4)
        self.m = go @ self.m
        self.c = go @ self.c @ go.T + np.diag([h / 20, h / 20, 1e-2, h / 20, h / 160, h / 160, 1e-5, h / 160]) ** 2

    def correct(self, z, f):
        h = self.m[3]
        see = np.eye(4, 8)
        s = see @ self.c @ see.T + np.diag([h / 20, h / 20, 1e-1, h / 20]) ** 2
        gain = self.c @ see.T @ np.linalg.inv(s)
        self.m, self.c = self.m + gain @ (z - see @ self.m), self.c - gain @ s @ gain.T
        self.f, self.sure = f, True

    def box(self):
        x, y, a, h = self.m[:4]
        return [x - a * h / 2, y - h / 2, x + a * h / 2, y + h / 2]


def plain_walk(by_frame):
    """by_frame: for each frame a list of (index, box, conf) -> {index: track}."""
    tracks, out, count = [], {}, 0
    for f, boxes in enumerate(by_frame):
        for t in tracks:
            t.predict(f)
        where = {id(t): t.box() for t in tracks}
        strong = [b for b in boxes if b[2] >= P.track_high]
        faint = [b for b in boxes if P.track_low < b[2] < P.track_high]

        def meet(some, found, limit, fuse):
            cost = [[1 - share(where[id(t)], b[1]) * (b[2] if fuse else 1) for b in found] for t in some]
            _, pairs = all_assignments(cost, limit)
            for r, c in pairs:
                b = found[c][1]
                some[r].correct(np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, (b[2] - b[0]) / (b[3] - b[1]), b[3] - b[1]]), f)
                out[found[c][0]] = some[r].id
                if some[r].first is not None:
                    out[some[r].first] = some[r].id
            used = {c for _, c in pairs}
            return [some[r] for r in range(len(some)) if r not in {r for r, _ in pairs}], [b for c, b in enumerate(found) if c not in used]

        sure, unsure = [t for t in tracks if t.sure], [t for t in tracks if not t.sure]
        lone, left = meet(sure, strong, P.track_match, True)
        meet([t for t in lone if t.f == f - 1], faint, P.track_faint_match, False)
        _, left = meet(unsure, left, P.track_confirm_match, True)
        tracks = [t for t in tracks if t.sure and f - t.f <= P.track_buffer]
        for i, b, conf in left:
            if conf >= P.track_new:
                t = Plain(np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, (b[2] - b[0]) / (b[3] - b[1]), b[3] - b[1]]), f)
                count += 1
                t.id, t.first = count, i
                if f == 0:
                    out[i] = count
                tracks.append(t)
    return out


def scene(seed, people=3, frames=60):
    """People who walk, meet, fade and vanish for a while; false boxes in between."""
    rng = np.random.default_rng(seed)
    rows = []
    start, pace = rng.uniform(0, 200, (people, 2)), rng.uniform(-4, 4, (people, 2))
    for f in range(frames):
        for k in range(people):
            if rng.random() < 0.12 or (k == 1 and 15 < f < 30):
                continue
            x, y = start[k] + pace[k] * f + rng.normal(0, 1, 2)
            rows.append(tuple(map(float, (f / 5, x, y, x + 40 + rng.normal(), y + 80 + rng.normal(), rng.choice([0.05, 0.18, 0.5, 0.9], p=[0.05, 0.25, 0.3, 0.4])))))
        if rng.random() < 0.2:
            x, y = rng.uniform(0, 300, 2)
            rows.append(tuple(map(float, (f / 5, x, y, x + 30, y + 60, rng.uniform(0.1, 0.6)))))
    return rows


def test_tracks_equal_a_plain_tracker(spark):
    rows, frames, want = [], [], {}
    for w in range(6):
        own = scene(w)
        by_frame = [[] for _ in range(60)]
        for i, r in enumerate(own):
            rows.append(("cam.mp4", w, r[0], i, 0, r[5], *r[1:5], 99, "x"))
            by_frame[round(r[0] * 5)].append((i, r[1:5], r[5]))
        frames += [("cam.mp4", w, f / 5) for f in range(60)]
        want |= {(w, i): t for i, t in plain_walk(by_frame).items()}
    rows += [("cam.mp4", 0, 0.2, 900, 67, 0.9, 0.0, 0.0, 9.0, 9.0, 5, "phone"), ("cam.mp4", 0, 0.4, 901, 0, None, 0.0, 0.0, 9.0, 9.0, 5, "no confidence")]
    d = spark.createDataFrame(rows, "video string, window_id int, t double, det_idx long, cls_id int, conf double, x0 double, y0 double, x1 double, y1 double, track_id int, name string")
    got = tracking.track_persons(d, spark.createDataFrame(frames, "video string, window_id int, t double"), ["video", "window_id"]).collect()
    assert len(got) == len(rows)
    assert {(r["window_id"], r["det_idx"]): r["track_id"] for r in got if r["track_id"] is not None} == want
    assert len({t for (w, _), t in want.items() if w == 0}) < 12  # tracks last


def test_a_faint_box_keeps_an_id_but_starts_none():
    box = [0.0, 0.0, 40.0, 80.0]
    frame, conf = np.arange(6), np.array([0.9, 0.9, 0.15, 0.15, 0.9, 0.9])
    assert tracking.walk(frame, np.array([box] * 6), conf, 6).tolist() == [1] * 6
    assert tracking.walk(frame, np.array([box] * 6), np.full(6, 0.15), 6).tolist() == [0] * 6


def test_an_id_ends_after_the_buffer_and_frames_without_boxes_count():
    box = np.array([[0.0, 0.0, 40.0, 80.0]] * 4)
    assert tracking.walk(np.array([0, 1, 31, 32]), box, np.full(4, 0.9), 33).tolist() == [1, 1, 1, 1]
    assert tracking.walk(np.array([0, 1, 33, 34]), box, np.full(4, 0.9), 35).tolist() == [1, 1, 2, 2]


@pytest.mark.parametrize("frames", [[], [(1, 0.0)]])
def test_windows_without_detections(spark, frames):
    d = spark.createDataFrame([], "window_id int, t double, det_idx long, cls_id int, conf double, x0 double, y0 double, x1 double, y1 double")
    assert tracking.track_persons(d, spark.createDataFrame(frames, "window_id int, t double"), ["window_id"]).count() == 0


def test_registered_tracks_equal_a_plain_tracker(spark, folder):
    from seatwatch.plans.queries import QUERIES
    from seatwatch.plans.views import Views

    persons = Views(spark, folder).walking_detections().where("cls_id = 0").toPandas()
    want = {}
    for (video, window), own in persons.groupby(["video", "window_id"]):
        by_frame = [[] for _ in range(40)]
        for r in own.sort_values(["frame", "det_idx"]).itertuples():
            by_frame[r.frame % 40].append(((video, window, r.frame, r.det_idx), [r.x0, r.y0, r.x1, r.y1], r.conf))
        want |= plain_walk(by_frame)
    got = QUERIES["person_tracks"](spark, folder).collect()
    assert len(got) == len(persons)
    assert {(r["video"], r["window_id"], r["frame"], r["det_idx"]): r["track_id"] for r in got if r["track_id"] is not None} == want
    assert len(want) > 200


def test_windows_are_named_from_tracks(spark):
    """The labels' evidence comes from the tracks: transit names the track that crosses."""
    from pyspark.sql import functions as F

    from seatwatch.operators import rules
    from seatwatch.plans import perception
    from seatwatch.plans.queries import QUERIES, WINDOW, _rois
    from seatwatch.plans.views import Views

    folder = "/root/testdata/sf0.01"
    v = Views(spark, folder)
    evidence = perception.window_evidence(v.walking_detections(), v.window_frames(), _rois(v), v.window_seats(), WINDOW).persist()
    paths = perception.person_paths(evidence, WINDOW)
    assert paths.count() == paths.select(*WINDOW, "track_id", "t").distinct().count()  # a track has one box a frame
    crossing = {(r["video"], r["window_id"]) for r in rules.transit(v.windows(), paths, keys=WINDOW).collect()}
    assert {(a, b) for a in range(3) for b in range(18) if (a * 18 + b) % 5 < 2} <= crossing
    named = {(r["video"], r["window_id"]): r["label"] for r in QUERIES["named_windows"](spark, folder).collect()}
    assert len(named) == 54 and {k for k, x in named.items() if x == "staff_or_transit"} == crossing
    assert evidence.where(F.col("cls_id").isin(67, 73) & F.col("track_id").isNull()).count() == 0
