from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seatwatch.config import DEFAULTS as P
from seatwatch.functions import geometry, review
from seatwatch.operators import correlate, detections, evaluate, nuisance, rules, score, seats, segment
from seatwatch.sources import readers, sinks


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


# --- functions


def test_box_iou(spark):
    b = lambda *x: tuple(F.lit(float(v)) for v in x)
    assert value(spark, geometry.box_iou(b(0, 0, 10, 10), b(5, 0, 15, 10))) == pytest.approx(1 / 3)
    assert value(spark, geometry.box_iou(b(0, 0, 10, 10), b(10, 0, 20, 10))) == 0  # touching
    assert value(spark, geometry.box_iou(b(0, 0, 0, 0), b(0, 0, 0, 0))) == 0


def test_interval_iou_and_blend(spark):
    lit = F.lit
    assert value(spark, geometry.interval_iou(lit(0.0), lit(10.0), lit(5.0), lit(15.0))) == pytest.approx(1 / 3)
    assert value(spark, geometry.interval_iou(lit(3.0), lit(3.0), lit(3.0), lit(3.0))) == 0
    assert value(spark, geometry.blend(lit(2.0), lit(2.0))) == 0.97
    assert value(spark, geometry.blend(lit(-1.0), lit(0.4))) == pytest.approx(0.2)


def test_display_columns(spark):
    assert value(spark, review.hms(F.lit(363661.9))) == "101:01:01"
    assert value(spark, review.camera_label(F.lit("hall one.MKV"))) == "HALL ONE"
    assert value(spark, review.priority(F.lit(0.4))) == "medium"
    assert value(spark, review.label_text(F.lit("some_new_label"))) == "some new label"
    assert value(spark, review.detector_text(F.lit("book (COCO 73), used as a proxy"))) == "book"
    assert value(spark, review.display_activity(F.lit(0.1))) == 1
    assert value(spark, review.display_activity(F.lit(None).cast("double"))) == 0
    assert value(spark, review.hours_label(F.lit(7697.0))) == "2h 08m"


# --- series


def series(spark, x, seat=0):
    return spark.createDataFrame([(seat, i, float(v)) for i, v in enumerate(x)], "seat_id int, bin int, activity double")


def median_filter(x, w):
    padded = np.pad(x, w // 2, mode="edge")
    return np.array([np.median(padded[i : i + w]) for i in range(len(x))])


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_robust_z_equals_numpy(spark, n):
    rng = np.random.default_rng(n)
    a = rng.gamma(1, 3, n)
    a[n // 2] += 100
    w = min(score.window_bins(n), 7)
    x = np.sqrt(a)
    base = median_filter(x, w)
    mad = np.median(np.abs(x - np.median(x)))
    floor = max(0.25 * 1.4826 * mad, max(0.05 * np.percentile(x, 95), 1e-6))
    scale = np.maximum(1.4826 * median_filter(np.abs(x - base), w), floor)
    want = np.maximum((x - base) / scale, 0)
    got = score.robust_z(series(spark, a), w).orderBy("bin").toPandas()
    assert np.allclose(got["z"], want) and np.allclose(got["baseline"], base)


def test_constant_series_has_no_z(spark):
    got = score.robust_z(series(spark, [4.0] * 30), 7).toPandas()
    assert (got["z"] == 0).all() and (got["scale"] > 0).all()


def brute_partition(x, penalty):
    n = len(x)
    cost = lambda i, j: float(((x[i:j] - x[i:j].mean()) ** 2).sum())
    best, back = [-penalty] + [np.inf] * n, [0] * (n + 1)
    for e in range(2, n + 1):
        for s in range(0, e - 1):
            if (s == 0 or s >= 2) and best[s] + cost(s, e) + penalty < best[e] - 1e-12:
                best[e], back[e] = best[s] + cost(s, e) + penalty, s
    return best[n]


@pytest.mark.parametrize("seed", range(6))
def test_change_points_are_optimal(seed):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(0, 6, 5), rng.integers(4, 12, 5)) + rng.normal(0, 1, 0 or 1)
    x = x + rng.normal(0, 1, len(x))
    cuts = segment.change_points(x, 10.0)
    edges = [0, *cuts, len(x)]
    total = sum(float(((x[a:b] - x[a:b].mean()) ** 2).sum()) + 10.0 for a, b in zip(edges, edges[1:])) - 10.0
    assert total == pytest.approx(brute_partition(x, 10.0))
    assert all(b - a >= 2 for a, b in zip(edges, edges[1:]))


def test_short_series_has_no_change_points():
    assert segment.change_points(np.array([0, 0, 0, 90, 90, 90, 90.0]), 1.0) == []


def test_budget_skips_but_goes_on(spark):
    rows = [(0, i, i + 1, float(d), float(s)) for i, (d, s) in enumerate([(5, 9), (8, 8), (4, 7), (1, 6), (1, 5)])]
    c = spark.createDataFrame(rows, "seat_id int, i0 int, i1 int, duration_s double, salience double")
    got = segment.budget_shortlist(c, 500.0)  # a budget of 10
    assert sorted(r["i0"] for r in got.collect()) == [0, 2, 3]
    got = segment.budget_shortlist(c, 50.0)  # the first alone overflows
    assert [r["i0"] for r in got.collect()] == [0]
    assert segment.budget_shortlist(c.limit(0), 50.0).count() == 0
    assert segment.top_fraction(c, 0.01).count() == 1


def test_lagged_correlation(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=50)
    b = np.concatenate([[0, 0], a[:-2]])
    rows = [(s, i, float(v)) for s, x in ((0, a), (1, b), (2, np.ones(50))) for i, v in enumerate(x)]
    z = spark.createDataFrame(rows, "seat_id int, bin int, z double")
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "seat_a int, seat_b int")
    got = {r["seat_b"]: r for r in correlate.lagged_correlation(z, pairs).collect()}
    assert got[1]["lag_s"] == 2 and got[1]["corr"] == pytest.approx(1)
    assert got[2]["corr"] == 0 and got[2]["lag_s"] == 0


def test_periodic_cells(spark):
    t = np.arange(64)
    rows = [(int(b), 0, c, float(v)) for c, x in enumerate((1 + np.cos(2 * np.pi * t / 8), np.zeros(64), *np.random.default_rng(0).normal(size=(8, 64)))) for b, v in zip(t, x)]
    cube = spark.createDataFrame(rows, "bin int, cy int, cx int, activity double")
    got = nuisance.periodic_cells(cube).orderBy("cx").toPandas()
    assert list(got["periodic"]) == [True] + [False] * 9 and got["frequency"][0] == 0.125
    short = nuisance.periodic_cells(cube.where("bin < 15")).toPandas()
    assert not short["periodic"].any()
    two = nuisance.periodic_cells(cube.where("cx < 2")).toPandas()  # half of the cells: distrusted
    assert not two["periodic"].any()


# --- seats


GRID_06 = [(1, 458, 93, 553, 230), (2, 675, 97, 781, 241), (3, 774, 185, 913, 410)]
GRID_07 = [(1, 344, 259, 536, 498), (2, 503, 190, 645, 389), (3, 634, 77, 800, 289), (4, 735, 58, 814, 233)]


def grid(spark, rows):
    return spark.createDataFrame(rows, "seat_id int, x0 int, y0 int, x1 int, y1 int")


def test_seat_goldens(spark):
    assert {r["seat_id"]: r["n"] for r in seats.seat_cells(grid(spark, GRID_06), 45, 80).groupBy("seat_id").agg(F.count("*").alias("n")).collect()} == {1: 70, 2: 70, 3: 150}
    edges = {(r["a"], r["b"]): r["distance"] for r in seats.seat_edges(grid(spark, GRID_06)).collect()}
    assert set(edges) == {(1, 2), (2, 3)} and edges[1, 2] == pytest.approx(1.247, abs=2e-3)
    assert seats.seat_edges(grid(spark, GRID_07)).count() == 6
    assert {r["row"] for r in seats.number_rows(grid(spark, GRID_07)).collect()} == {0}
    six = {r["seat_id"]: (r["row"], r["col"]) for r in seats.number_rows(grid(spark, GRID_06)).collect()}
    assert six == {1: (0, 0), 2: (0, 1), 3: (1, 0)}


def test_agglomerate_order_and_ties():
    boxes = np.array([[0, 0, 10, 10], [0, 0, 10, 10], [100, 0, 110, 10], [1, 0, 11, 10]], float)
    own, mean = seats.agglomerate(boxes, 0.35)
    assert list(own) == [0, 0, 1, 0] and mean[0][0] == pytest.approx(1 / 3)
    assert len(seats.agglomerate(np.zeros((0, 4)), 0.35)[0]) == 0


# --- detections


def det(spark, rows, extra=""):
    return spark.createDataFrame(rows, "frame int, det_idx long, cls_id int, conf double, x0 double, y0 double, x1 double, y1 double" + extra)


def test_suppress_equals_greedy_numpy(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(200):
        x, y = rng.integers(0, 60, 2)
        rows.append((int(i % 4), i, int(rng.choice([0, 67])), float(rng.integers(1, 6)) / 10, float(x), float(y), float(x + 40), float(y + 40)))
    want = set()
    for f in range(4):
        for c in (0, 67):
            kept = []
            for r in sorted((r for r in rows if r[0] == f and r[2] == c), key=lambda r: (-r[3], r[1])):
                if not kept or (seats.iou_many(np.array(r[4:]), np.array([k[4:] for k in kept])) <= 0.6).all():
                    kept.append(r)
            want |= {r[1] for r in kept}
    assert {r["det_idx"] for r in detections.suppress(det(spark, rows)).collect()} == want
    assert detections.suppress(det(spark, [])).count() == 0


def test_link_centroids(spark):
    rows = [(1, t, i, 73, x, 0.0, x + 2, 2.0) for t, i, x in [(0.0, 1, 0.0), (0.0, 2, 50.0), (1.0, 3, 49.0), (1.0, 4, 48.0), (9.0, 5, 1.0), (9.0, 6, 47.5)]]
    d = spark.createDataFrame(rows, "window_id int, t double, det_idx int, cls_id int, x0 double, y0 double, x1 double, y1 double")
    got = {r["det_idx"]: r["track_id"] for r in detections.link_centroids(d, 16.0, 20000).collect()}
    assert got == {1: 20000, 2: 20001, 3: 20001, 4: 20002, 5: 20003, 6: 20002}


def test_assignment_tiers(spark):
    s = spark.createDataFrame([(1, 5, 0, 0.0, 0.0, 100.0, 100.0), (1, 6, 1, 0.0, 0.0, 100.0, 100.0), (1, 7, 2, 300.0, 0.0, 900.0, 900.0)], "window_id int, seat_id int, ord int, x0 double, y0 double, x1 double, y1 double")
    d = det(spark, [(0, 1, 0, 1.0, 0.0, 0.0, 90.0, 90.0), (0, 2, 0, 1.0, 500.0, 500.0, 510.0, 510.0), (0, 3, 0, 1.0, 2000.0, 0.0, 2001.0, 1.0)]).withColumn("window_id", F.lit(1))
    got = {r["det_idx"]: (r["seat_id"], r["how"]) for r in detections.assign_seats(d, s, ["window_id"]).collect()}
    assert got == {1: (5, "iou"), 2: (7, "centre"), 3: (None, None)}
    d2 = d.withColumn("window_id", F.lit(9))  # a window without seats
    assert [r["seat_id"] for r in detections.assign_seats(d2, s, ["window_id"]).collect()] == [None] * 3


def test_fixture_map(spark):
    still = [(t * 40.0, 1, 67, 10.0 + t % 2, 10.0, 30.0 + t % 2, 30.0) for t in range(10)]
    moving = [(t * 40.0, 2, 67, 200.0 + 30 * t, 10.0, 240.0 + 30 * t, 50.0) for t in range(10)]
    d = spark.createDataFrame([*still, *moving], "t double, det_idx int, cls_id int, x0 double, y0 double, x1 double, y1 double")
    frames = spark.createDataFrame([(t * 40.0,) for t in range(12)], "t double")
    got = detections.fixture_map(d, frames).collect()
    assert len(got) == 1 and got[0]["n"] == 10 and got[0]["presence"] == pytest.approx(10 / 12)
    assert detections.fixture_map(d, frames.limit(7)).count() == 0
    left = detections.drop_fixtures(d, detections.fixture_map(d, frames))
    assert {r["det_idx"] for r in left.collect()} == {2}


def test_interpolation_holds_then_ends(spark):
    s = spark.createDataFrame([(1, 1.0, 0.0), (1, 2.0, 10.0)], "k int, t double, v double")
    q = spark.createDataFrame([(1, t) for t in (0.5, 0.8, 1.0, 1.25, 2.2, 2.9)], "k int, t double")
    got = {r["t"]: r["v"] for r in detections.interpolate(s, q, ["v"], ["k"]).collect()}
    assert got == {0.8: 0.0, 1.0: 0.0, 1.25: 2.5, 2.2: 10.0}


# --- rules and evaluation


def test_crowd_needs_duration(spark):
    c = spark.createDataFrame([(float(t), n) for t, n in enumerate([4, 4, 0, 5, 4, 4, 4, 4, 6, 1])], "t double, n long")
    got = rules.crowds(c).collect()
    assert len(got) == 1 and got[0]["start_sec"] == 3 and got[0]["end_sec"] == 8 and got[0]["peak"] == 6


def greedy_runs(hits):
    out, i = [], 0
    while i < len(hits):
        if not hits[i]:
            i += 1
            continue
        end, last = i, i
        while end + 1 < len(hits) and end + 1 - last <= 2:
            end += 1
            last = end if hits[end] else last
        run = hits[i : last + 1]
        if len(run) >= 3 and sum(run) / len(run) >= 0.6:
            out.append((i, last))
        i = end + 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_persistent_runs_equal_greedy(spark, seed):
    hits = list(np.random.default_rng(seed).random(60) < 0.6)
    samples = spark.createDataFrame([(float(i),) for i in range(60)], "t double")
    seen = spark.createDataFrame([(float(i), 1, 0.5) for i, h in enumerate(hits) if h], "t double, seat_id int, conf double")
    got = sorted((int(r["start_sec"]), int(r["end_sec"])) for r in rules.persistent_objects(samples, seen).collect())
    assert got == greedy_runs(hits)


def test_runs_across_blocks_equal_those_of_one_block(spark):
    """Of two recordings and kinds; no task takes all samples, only a row a block."""
    import re

    rng = np.random.default_rng(3)
    samples = spark.createDataFrame([(v, 5.0 * i + v) for v in range(2) for i in range(300)], "video int, t double")
    rows = [(v, k, s, 5.0 * i + v, float(rng.random())) for v in range(2) for k in "ab" for s in range(3) for i in range(300) if rng.random() < 0.4 + 0.2 * s]
    seen = spark.createDataFrame([*rows, (0, "a", 9, None, 0.5)], "video int, kind string, seat_id int, t double, conf double")
    want = []
    for v, k, s in sorted({r[:3] for r in rows}):
        at = {round((r[3] - v) / 5): r[4] for r in rows if r[:3] == (v, k, s)}
        for a, b in greedy_runs([i in at for i in range(300)]):
            conf = [c for i, c in at.items() if a <= i <= b]
            want.append((v, k, s, 5.0 * a + v, 5.0 * b + v, b - a + 1, len(conf), round(sum(conf) / len(conf), 9)))
    for block_s in (5.0, 12.0, 60.0, 1e6):
        got = rules.persistent_objects(samples, seen, keys=["video"], by=["kind"], block_s=block_s, parts=3).collect()
        assert sorted((*r[:7], round(r["mean_conf"], 9)) for r in got) == sorted(want), block_s
    plan = rules.persistent_objects(samples.where("video = 0").drop("video"), seen.where("video = 0").drop("video"), by=["kind"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange SinglePartition, ENSURE(?!.*\n.*Aggregate)", plan)


def test_every_window_gets_one_label(spark):
    w = spark.createDataFrame([(i, 0.1 * i) for i in range(4)], "window_id int, mean_z double")
    f = lambda rows: spark.createDataFrame(rows, "window_id int, confidence double, note string")
    found = {"mobile_phone_usage": f([(0, 0.5, "a"), (1, 0.6, "a")]), "paper_pass": f([(0, 0.7, "b")]), "staff_or_transit": f([(1, 0.2, "c")])}
    got = {r["window_id"]: r for r in rules.classify(w, found).collect()}
    assert [got[i]["label"] for i in range(4)] == ["paper_pass", "staff_or_transit", "unclassified_anomaly", "unclassified_anomaly"]
    assert got[0]["also_matched"] == ["mobile_phone_usage"] and got[1]["also_matched"] == []
    assert got[3]["confidence"] == 0.05


def test_unavailable_is_not_zero(spark):
    truth = spark.createDataFrame([(1, "a", None, None, "x"), (2, "b", 0.0, 10.0, "x")], "gt_id int, video string, start_sec double, end_sec double, label string")
    events = spark.createDataFrame([("a", 0.0, 5.0)], "video string, start_sec double, end_sec double")
    videos = spark.createDataFrame([("a", 3600.0), ("b", 0.0)], "video string, duration_s double")
    r = {x["video"]: x for x in evaluate.recall_at_budget(truth, events).collect()}
    assert r["a"]["status"] == "unavailable" and r["a"]["recall"] is None and r["b"]["recall"] == 0
    f = {x["video"]: x for x in evaluate.false_events(truth, events, videos).collect()}
    assert f["a"]["events_per_hour"] == 1 and f["b"]["false_events_per_hour"] is None and f["b"]["n_false"] == 0


# --- sources and sinks


def test_ground_truth_and_manifest(spark, tmp_path):
    (tmp_path / "gt.csv").write_text("video,start_sec,end_sec,seat_hint,label,type,confidence_of_label\na.mkv, 2 ,52,,phone,x,high\nb.mkv,,,,crowd,,\n")
    got = {r["video"]: r for r in readers.ground_truth(spark, str(tmp_path / "gt.csv")).collect()}
    assert got["a.mkv"]["start_sec"] == 2 and got["b.mkv"]["start_sec"] is None and got["b.mkv"]["type"] is None
    e = spark.createDataFrame([("b", 2.0, 0.5), ("a", 1.004, 0.1234)], "video string, start_sec double, confidence double")
    sinks.write_manifest(e, e.limit(0), str(tmp_path / "m"))
    back = spark.read.json(str(tmp_path / "m/events")).collect()
    assert {(r["video"], r["start_sec"], r["confidence"]) for r in back} == {("b", 2.0, 0.5), ("a", 1.0, 0.123)}
    assert "disclaimer" in (spark.read.text(str(tmp_path / "m/header")).first()["value"])


def test_stored_is_made_once(spark, tmp_path):
    a = sinks.stored(spark.range(3), str(tmp_path), "x")
    b = sinks.stored(spark.range(5), str(tmp_path), "x")
    assert a.count() == b.count() == 3


def test_stream_equals_batch(spark, folder, tmp_path):
    from seatwatch.streaming.activity import seat_activity_stream

    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = seat_activity_stream(stream, (F.col("user_id") % 8).cast("int"), F.col("value"))
    q = out.writeStream.outputMode("append").format("memory").queryName("activity").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["seat_id"], r["start"]): r["activity"] for r in spark.sql("select * from activity").collect()}
    batch = events.groupBy((F.col("user_id") % 8).cast("int").alias("s"), F.window("ts", "1 hour").start.alias("w")).agg(F.avg("value").alias("a")).collect()
    want = {(r["s"], r["w"]): r["a"] for r in batch}
    assert got and all(want[k] == pytest.approx(x) for k, x in got.items()) and len(want) - len(got) < 20


def test_pandas_is_not_needed_for_empty_inputs(spark):
    empty = series(spark, [])
    assert score.robust_z(empty, 7).count() == 0
    assert segment.segments(spark.createDataFrame([], "seat_id int, bin int, z double")).count() == 0
    assert isinstance(pd.DataFrame(), pd.DataFrame) and P.key()


def test_calibration_starts_of_one_window(spark):
    single = replace(P, seat_windows=1)
    got = spark.createDataFrame([(60.0,), (9000.0,)], "d double").select(seats.calibration_starts(F.col("d"), single).alias("s")).collect()
    assert [r.s for r in got] == [[0.0], [0.0]]
