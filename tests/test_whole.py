"""Queries take every row of their tables."""

import duckdb

from seatwatch.plans.queries import QUERIES
from seatwatch.plans.views import with_views


def _sql(folder, select, *views):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "nation"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con.execute(with_views(select, *views)).fetchall()


def test_transit_of_every_window(spark, folder):
    want = {w for (w,) in _sql(folder, "SELECT DISTINCT window_id FROM v_moved WHERE displacement >= 0.5", "v_moved")}
    assert any(w % 3 for w in want)
    number = lambda r: r["video"] * 18 + r["window_id"]
    assert {number(r) for r in QUERIES["rule_transit"](spark, folder).collect()} == want
    labels = {number(r): r["label"] for r in QUERIES["classify_windows"](spark, folder).collect()}
    assert {w for w, label in labels.items() if label == "staff_or_transit"} == want


def test_scales_of_every_frame(spark, folder):
    frames = {f for (f,) in _sql(folder, "SELECT DISTINCT frame FROM v_detections", "v_detections")}
    assert {r["frame"] for r in QUERIES["multi_scale_merge"](spark, folder).collect()} == frames


def test_seats_of_every_window(spark):
    folder = "/root/testdata/sf0.01"  # the smaller one has too few persons for any seat
    assert {r["window_id"] for r in QUERIES["seat_discovery"](spark, folder).collect()} == set(range(15))
    assert {r["windows"] for r in QUERIES["seat_merge"](spark, folder).collect()} == {15}


def test_fixtures_span_all_frames(spark, folder):
    from pyspark.sql import functions as F

    from seatwatch.plans import queries
    from seatwatch.plans.views import Views

    phones = {(a, b): n for a, b, n in _sql(folder, "SELECT window_id // 18, frame, count(*) FROM v_window_detections WHERE cls_id = 67 GROUP BY ALL", "v_window_detections")}
    d, frames = queries._still(Views(spark, folder))
    assert {(r["video"], r["frame"]): r["count"] for r in d.groupBy("video", "frame").count().collect()} == phones
    assert frames.agg(F.count("*"), F.max("t")).first() == (3 * 720, 719 / 5)


def test_fixture_map_equals_a_plain_walk(spark, folder):
    """Every box of the query's input goes to the cluster of the highest overlap, of equal ones the last."""
    import math

    from seatwatch.plans import queries
    from seatwatch.plans.views import Views

    def overlap(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        shared = max(w, 0) * max(h, 0)
        return shared / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared)

    def add(found, box, weight, rows):
        """To the cluster of the highest overlap, of equal ones the last."""
        best, top = 0.3, None
        for f in found:
            if (v := overlap(f[0], box)) >= best:
                best, top = v, f
        if top is None:
            found.append([box, weight, list(rows)])
        else:
            top[0], top[1] = [(m * top[1] + b * weight) / (top[1] + weight) for m, b in zip(top[0], box)], top[1] + weight
            top[2] += rows

    boxes, _ = queries._still(Views(spark, folder))
    want = {"fixture_map": set(), "fixture_map_blocks": set()}
    for video in range(3):
        rows = [(r["t"], [r["x0"], r["y0"], r["x1"], r["y1"]]) for r in sorted(boxes.where(f"video = {video}").collect(), key=lambda r: (r["t"], r["det_idx"]))]
        whole, merged = [], []
        for r in rows:
            add(whole, r[1], 1, [r])
        for block in sorted({t // 30 for t, _ in rows}):
            part = []
            for r in rows:
                if r[0] // 30 == block:
                    add(part, r[1], 1, [r])
            for f in part:
                add(merged, f[0], f[1], f[2])
        for name, found in (("fixture_map", whole), ("fixture_map_blocks", merged)):
            for (x0, y0, x1, y1), _, own in found:
                times, centres = [t for t, _ in own], [((b[0] + b[2]) / 2, (b[1] + b[3]) / 2) for _, b in own]
                mx, my = (sum(c[i] for c in centres) / len(centres) for i in (0, 1))
                drift = max(math.hypot(x - mx, y - my) for x, y in centres) / max(math.hypot(x1 - x0, y1 - y0), 1)
                n, span = len({round(t, 3) for t in times}), max(times) - min(times)
                if n >= 8 and span >= min(300, 0.25 * 719 / 5) and drift <= 0.75:
                    want[name].add((video, 67, n, *(round(x, 4) for x in (x0, y0, x1, y1, n / 720, span, drift))))
    for name, rows in want.items():
        got = {(r["video"], r["cls_id"], r["n"], *(round(r[c], 4) for c in ("x0", "y0", "x1", "y1", "presence", "span_s", "drift"))) for r in QUERIES[name](spark, folder).collect()}
        assert got == rows and len(rows) >= 4
    # how far the two differ: every fixture of one has its like in the other
    for one, other in (want.values(), [*want.values()][::-1]):
        near = [f for f in one if any(f[0] == g[0] and overlap(f[3:7], g[3:7]) > 0.8 for g in other)]
        assert len(near) >= 0.9 * len(one)


def test_union_of_all_events(spark, folder):
    want = _sql(folder, "SELECT video, CAST(seat_id AS VARCHAR), round(start_sec, 6) FROM v_manifest", "v_manifest")
    got = [tuple(r[c] for c in ("video", "seat_id", "start_sec")) for r in QUERIES["event_union"](spark, folder).collect()]
    crowds = QUERIES["crowd_events"](spark, folder).count()
    assert sorted(r for r in got if r[0]) == sorted(want)
    assert sum(r[0] is None for r in got) == crowds
