"""Several recordings at once give what each gives by itself."""

import pytest
from pyspark.sql import functions as F

from seatwatch.operators import correlate, detections, motion, nuisance, score, segment
from seatwatch.plans import triage
from seatwatch.sources import sinks

KEYS = ["video"]


@pytest.fixture(scope="module")
def vectors(spark):
    """Two recordings of unlike length and motion, frames and cells numbered alike."""
    rows = []
    for v, (name, bins) in enumerate([("a", 40), ("b", 24)]):
        for bin_ in range(bins):
            for k in range(12):
                cell = (bin_ * 5 + k * (v + 2)) % 16
                burst = 40.0 if v and 10 <= bin_ < 14 and cell < 4 else 0.0
                rows.append((name, bin_ * 2 + k % 2, bin_, cell // 4, cell % 4, float((bin_ * 7 + k * 3) % 11 + burst), float(k % 5)))
    return spark.createDataFrame(rows, "video string, frame int, bin int, cy int, cx int, motion_x double, motion_y double").persist()


@pytest.fixture(scope="module")
def recordings(spark):
    return spark.createDataFrame([("a", 40), ("b", 24)], "video string, bins int")


def rows(df):
    names = sorted(df.columns)
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect())


def each(spark, f):
    """f(name, bins) of each recording by itself, with its name."""
    one, two = (f(n, b).withColumn("video", F.lit(n)) for n, b in (("a", 40), ("b", 24)))
    return rows(one.unionByName(two))


def of(df, name):
    return df.where(F.col("video") == name).drop("video")


def test_cube_filters_and_heatmap(spark, vectors, recordings):
    cube = motion.dense_cube(motion.cell_cube(vectors, ["video", "frame"]), "bins", 4, 4, recordings, KEYS).persist()
    own = {n: motion.dense_cube(motion.cell_cube(of(vectors, n)), b, 4, 4).persist() for n, b in (("a", 40), ("b", 24))}
    assert rows(cube) == each(spark, lambda n, b: own[n]) and cube.count() == (40 + 24) * 16
    assert rows(motion.bin_coverage(vectors, KEYS)) == each(spark, lambda n, b: motion.bin_coverage(of(vectors, n)))
    assert rows(motion.heatmap(cube, keys=KEYS)) == each(spark, lambda n, b: motion.heatmap(own[n]))
    clean = nuisance.apply_filters(cube, nuisance.periodic_cells(cube, keys=KEYS), nuisance.illumination_bins(cube, keys=KEYS), KEYS)
    assert rows(clean) == each(spark, lambda n, b: nuisance.apply_filters(own[n], nuisance.periodic_cells(own[n]), nuisance.illumination_bins(own[n])))


def test_triage_to_shortlist(spark, vectors, recordings):
    cells = spark.range(16).select((F.floor(F.col("id") / 8) * 2 + F.col("id") % 4 % 2).cast("int").alias("seat_id"), F.floor(F.col("id") / 4).cast("int").alias("cy"), (F.col("id") % 4).cast("int").alias("cx"))
    both = cells.withColumn("video", F.explode(F.array(F.lit("a"), F.lit("b"))))
    z = triage.triage_scores(vectors, both, 24, 4, 4, recordings=recordings.withColumn("bins", F.lit(24)), keys=KEYS).persist()
    alone = {n: triage.triage_scores(of(vectors, n).where("bin < 24"), cells, 24, 4, 4).persist() for n in "ab"}
    short = vectors.where("bin < 24")
    z = triage.triage_scores(short, both, 24, 4, 4, recordings=recordings, keys=KEYS).persist()
    assert rows(z) == each(spark, lambda n, b: alone[n])
    assert rows(triage.shortlist(z, 4, 24, keys=KEYS)) == each(spark, lambda n, b: triage.shortlist(alone[n], 4, 24))
    pairs = spark.createDataFrame([(0, 1), (1, 2), (0, 3)], "seat_a int, seat_b int")
    keyed = pairs.withColumn("video", F.explode(F.array(F.lit("a"), F.lit("b"))))
    assert rows(correlate.survey(z, keyed, top=2, keys=KEYS)) == each(spark, lambda n, b: correlate.survey(alone[n], pairs, top=2))
    assert rows(sinks.timeline_matrix(z, [0, 1, 2, 3], keys=KEYS)) == each(spark, lambda n, b: sinks.timeline_matrix(alone[n], [0, 1, 2, 3]))
    assert rows(segment.runs_over(z, keys=["video", "seat_id"])) == each(spark, lambda n, b: segment.runs_over(alone[n]))


def test_dense_series(spark, recordings):
    sparse = spark.createDataFrame([("a", 0, 3, 5.0), ("b", 1, 3, 7.0)], "video string, seat_id int, bin int, activity double")
    got = motion.dense_series(sparse, 2, "bins", recordings, KEYS)
    assert got.count() == 2 * (40 + 24)
    assert rows(got) == each(spark, lambda n, b: motion.dense_series(of(sparse, n), 2, b))
    assert rows(score.robust_z(got, 5, keys=["video", "seat_id"])) == each(spark, lambda n, b: score.robust_z(motion.dense_series(of(sparse, n), 2, b), 5))


def test_seats_of_other_recordings_do_not_count(spark):
    seats = spark.createDataFrame([("a", 1, 0.0, 0.0, 10.0, 10.0), ("b", 1, 50.0, 50.0, 60.0, 60.0), ("b", 2, 50.0, 50.0, 62.0, 62.0)], "video string, seat_id int, x0 double, y0 double, x1 double, y1 double")
    d = spark.createDataFrame([(v, f, 1, 0, 0.9, x, x, x + 10, x + 10) for v, f, x in [("a", 0, 1.0), ("a", 1, 50.0), ("b", 0, 1.0), ("b", 1, 50.0), ("c", 0, 1.0)]], "video string, frame int, det_idx int, cls_id int, conf double, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["video"], r["frame"], r["seat_id"]) for r in detections.assign_sweep(d, seats, KEYS).collect())
    assert got == [("a", 0, 1), ("b", 1, 1)]
    loose = sorted((r["video"], r["frame"]) for r in detections.unseated_persons(d, seats, keys=KEYS).collect())
    assert loose == [("a", 1), ("b", 0), ("c", 0)]


@pytest.mark.parametrize("seed", range(3))
def test_links_equal_a_plain_walk(spark, seed):
    import math
    import random

    rng = random.Random(seed)
    boxes = [("v", w, 73, float(t), i, float(rng.randrange(40)), float(rng.randrange(40))) for w in range(2) for t in range(8) for i in range(rng.randint(0, 7))]
    want = {}
    for w in range(2):
        last, fresh = [], 100
        for t in sorted({b[3] for b in boxes if b[1] == w}):
            now, used = [], set()
            for b in sorted(b for b in boxes if b[1] == w and b[3] == t):
                near = sorted((math.hypot(b[5] - x, b[6] - y), k) for k, (x, y, i) in enumerate(last) if i not in used)
                if near and near[0][0] < 12:
                    own = last[near[0][1]][2]
                else:
                    own, fresh = fresh, fresh + 1
                used.add(own)
                now.append((b[5], b[6], own))
                want[w, t, b[4]] = own
            last = now
    df = spark.createDataFrame(boxes, "video string, window_id int, cls_id int, t double, det_idx int, x0 double, y0 double").withColumns({"x1": F.col("x0"), "y1": F.col("y0"), "track_id": F.lit(None).cast("long")})
    got = {(r["window_id"], r["t"], r["det_idx"]): r["track_id"] for r in detections.link_centroids(df, 12.0, 100, ["video", "window_id"]).collect()}
    assert got == want


def test_rules_over_recordings_equal_each_alone(spark, folder):
    """Windows, seats, edges and scores of three recordings at once, and each by itself: same names everywhere."""
    from seatwatch.operators import detections, rules
    from seatwatch.plans.queries import WINDOW, _tracks
    from seatwatch.plans.views import Views

    v = Views(spark, folder)
    parts = {"w": v.windows(), "n": v.neighbours(), "z": v.recorded_scores(), "s": v.recorded_seats(), "e": v.edges(), "d": v.window_detections(), "ws": v.window_seats(), "t": _tracks(v)}
    parts = {k: df.persist() for k, df in parts.items()}

    def named(p, keys, recording):
        a = detections.assign_seats(p["d"], p["ws"], keys).persist()
        found = {"mobile_phone_usage": rules.phone(p["w"], a, keys=keys), "paper_pass": rules.paper(p["w"], a, p["e"], keys=keys, recording=recording), "talking_to_neighbour": rules.talking(p["w"], p["n"], p["z"], p["s"], keys=keys, recording=recording), "staff_or_transit": rules.transit(p["w"], p["t"], keys=keys)}
        cut = lambda x: round(x, 9) if isinstance(x, float) else x
        named = [*found.items(), ("all", rules.classify(p["w"], found, keys=keys).drop("evidence"))]
        return {k: sorted(repr({n: cut(x) for n, x in sorted(r.asDict().items()) if n != "video"}) for r in f.collect()) for k, f in named}

    both = named(parts, WINDOW, ["video"])
    alone = [named({k: df.where(f"video = {i}").drop("video") for k, df in parts.items()}, ["window_id"], None) for i in range(3)]
    for k, rows_of in both.items():
        assert rows_of == sorted(sum((a[k] for a in alone), []))
