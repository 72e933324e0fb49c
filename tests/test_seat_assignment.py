"""Detections at seats against plain walks over all seats."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seatwatch.operators import detections

SEATS = "video string, seat_id int, ord int, x0 double, y0 double, x1 double, y1 double"
DETECTIONS = "video string, frame int, det_idx int, cls_id int, conf double, x0 double, y0 double, x1 double, y1 double"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = max(w, 0.0) * max(h, 0.0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return shared / union if shared > 0 and union > 0 else 0.0


def holds(b, x, y):
    return b[0] <= x <= b[2] and b[1] <= y <= b[3]


def of_sweep(d, seats):
    best = [(-round(iou(d, s), 12), i) for i, s in seats if iou(d, s) > 0]
    if best:
        return min(best)[1]
    return min((i for i, s in seats if holds(s, (d[0] + d[2]) / 2, (d[1] + d[3]) / 2)), default=None)


def of_window(d, seats, least=0.10):
    x, y = (d[0] + d[2]) / 2, (d[1] + d[3]) / 2
    best = [(-round(iou(d, s), 12), i) for i, s in seats if round(iou(d, s), 12) >= least]
    if best:
        return min(best)[1], "iou"
    near = [(round(math.hypot(x - (s[0] + s[2]) / 2, y - (s[1] + s[3]) / 2), 9), i) for i, s in seats if holds(s, x, y)]
    return (min(near)[1], "centre") if near else (None, None)


def boxes(rng, n):
    """Boxes of all sizes, on round coordinates, outside of the picture, empty, far off and huge."""
    out = []
    for _ in range(n):
        side = rng.choice([0, 1, 16, 63, 64, 65, 128, 200, 256, 512, 700, 2048, 3000, 40000])
        w, h = rng.choice([(side, side), (side, side / 2), (side / 3, side), (side, 0)])
        x, y = rng.choice([rng.uniform(-200, 1500), 64.0 * rng.randrange(20), -20000.0, 17000.0, 30000.0]), rng.choice([rng.uniform(-200, 900), 64.0 * rng.randrange(12)])
        out.append((x, y, x + w, y + h))
    return out


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(11)
    seats = {v: list(enumerate([*boxes(rng, 25), *((240.0 * (i % 5), 130.0 * (i // 5), 240.0 * (i % 5) + 200, 130.0 * (i // 5) + 120) for i in range(25))])) for v in "ab"}
    found = {v: boxes(rng, 400) for v in "abc"}
    s = spark.createDataFrame([(v, i, i, *b) for v in seats for i, b in seats[v]] + [("a", 99, 99, None, 0.0, 5.0, 5.0), ("b", 98, 98, 0.0, 0.0, 5.0, None)], SEATS)
    d = spark.createDataFrame([(v, k, 0, 0, 0.9, *b) for v in found for k, b in enumerate(found[v])] + [("a", 1000, 0, 0, 0.9, None, 0.0, 1.0, 1.0), (None, 1001, 0, 0, 0.9, 0.0, 0.0, 1.0, 1.0)], DETECTIONS)
    return seats, found, s.persist(), d.persist()


def test_sweep_equals_all_seats(spark, both):
    seats, found, s, d = both
    want = {(v, k): t for v in found for k, b in enumerate(found[v]) if (t := of_sweep(b, seats.get(v, []))) is not None}
    got = detections.assign_sweep(d, s, ["video"]).collect()
    assert {(r["video"], r["frame"]): r["seat_id"] for r in got} == want and len(got) == len(want)
    assert len(want) > 300


def test_windows_equal_all_seats(spark, both):
    seats, found, s, d = both
    want = {(v, k): of_window(b, seats.get(v, [])) for v in found for k, b in enumerate(found[v])} | {("a", 1000): (None, None), (None, 1001): (None, None)}
    got = detections.assign_seats(d, s, ["video"]).collect()
    assert {(r["video"], r["frame"]): (r["seat_id"], r["how"]) for r in got} == want and len(got) == d.count()
    assert {how for _, how in want.values()} == {"iou", "centre", None}


def test_unseated_equals_all_seats(spark, both):
    seats, found, s, d = both
    want = sorted((v, k) for v in found for k, b in enumerate(found[v]) if not any(iou(b, x) >= 0.25 for _, x in seats.get(v, []))) + [("a", 1000)]
    got = detections.unseated_persons(d.where("video is not null"), s, keys=["video"]).collect()
    assert sorted((r["video"], r["frame"]) for r in got) == sorted(want)


def test_repeated_rows_and_other_columns_stay(spark, both):
    seats, found, s, d = both
    one = d.where("video = 'a'").drop("video").withColumn("side", F.lit("left"))
    twice, own = one.unionAll(one), s.where("video = 'a'").drop("video")
    a, b = detections.assign_sweep(one, own), detections.assign_sweep(twice, own)
    assert b.count() == 2 * a.count() > 0 and a.columns == [*one.columns, "seat_id"]
    assert sorted(map(repr, b.collect())) == sorted([*map(repr, a.collect())] * 2)
    assert detections.assign_sweep(one, own.limit(0)).count() == 0
    assert detections.unseated_persons(one, own.limit(0)).count() == one.count()
