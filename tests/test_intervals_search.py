"""Interval pairs, places in a whole order, indexed search and small pieces, against plain versions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from seatwatch.config import DEFAULTS as P
from seatwatch.operators import detections, intervals, nuisance, rules, search, segment
from seatwatch.operators.review import event_search
from seatwatch.sources import readers, sinks

SPAN = "video string, id int, {0}_start double, {0}_end double"


def spans(seed, n, ids):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start, long = rng.choice([rng.uniform(-500, 5000), rng.randrange(0, 400) * 8.0]), rng.choice([0.0, 0.5, 8.0, 31.9, 32.0, 200.0, 3000.0, 40000.0, -3.0])
        out.append((rng.choice("ab"), ids + i, start, start + long))
    return [*out, ("a", ids + n, None, 5.0), ("a", ids + n + 1, 1.0, None), (None, ids + n + 2, 0.0, 100.0), *out[:3]]


def tiou(a, b):
    shared = max(0.0, min(a[3], b[3]) - max(a[2], b[2]))
    union = (a[3] - a[2]) + (b[3] - b[2]) - shared
    return shared / union if union > 0 else 0.0


@pytest.mark.parametrize("least", [0.0, 0.05, 0.3, 1.0])
def test_pairs_equal_all_comparisons(spark, least):
    left, right = spans(1, 150, 0), spans(2, 150, 1000)
    got = intervals.interval_pairs(spark.createDataFrame(left, SPAN.format("l")), spark.createDataFrame(right, SPAN.format("r")).withColumnRenamed("id", "other"), ["video"], least)
    got = sorted((r["id"], r["other"], round(r["tiou"], 9)) for r in got.collect())
    whole = lambda x: x[0] and x[2] is not None and x[3] is not None and x[3] > x[2]
    want = sorted((a[1], b[1], round(t, 9)) for a in left if whole(a) for b in right if whole(b) and a[0] == b[0] and (t := tiou(a, b)) > 0 and t >= least)
    assert got == want and (len(want) > 5 or least == 1.0)


def test_pairs_are_in_proportion_to_overlaps(spark):
    """Many short events one after another and one that spans them all: no two short ones meet."""
    rows = [("a", i, i * 10.0, i * 10.0 + 9) for i in range(4000)]
    left, right = spark.createDataFrame([*rows, ("a", -1, 0.0, 40000.0)], SPAN.format("l")), spark.createDataFrame(rows, SPAN.format("r")).withColumnRenamed("id", "other")
    a, b = intervals._bucketed(left, "l_start", "l_end", 2), intervals._bucketed(right, "r_start", "r_end", 2)
    assert sum(x.join(y, ["video", "_level", "_bucket"]).count() for x, y in ((a.where("_level = _own"), b), (a.where("_level > _own"), b.where("_level = _own")))) < 12 * 4000
    assert intervals.interval_pairs(left, right, ["video"]).count() == 8000


def test_known_events_are_dropped(spark):
    make = lambda x: spark.createDataFrame([(v, i % 3, "phone", s, e, i) for v, i, s, e in x], "video string, seat_id int, action_label string, start_sec double, end_sec double, n int")
    left, right = spans(3, 80, 0), spans(4, 80, 0)
    got = sorted(r["n"] for r in rules.drop_known(make(left), make(right)).collect())
    hit = lambda a: any(a[0] and a[0] == b[0] and a[1] % 3 == b[1] % 3 and None not in (a[2], a[3], b[2], b[3]) and tiou(a, b) >= 0.3 for b in right)
    assert got == sorted(a[1] for a in left if not hit(a))


def test_places_in_a_whole_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([None, 0.5, rng.random()]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "confidence double, ord int").repartition(7)
    ranked = segment.numbered(df, [F.col("confidence").desc(), F.col("ord")], "place", str(tmp_path / "x"))
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r["confidence"], r["ord"]) for r in sorted(ranked.collect(), key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in ranked.collect()) == list(range(1, 501))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange SinglePartition, ENSURE(?!.*\n.*Aggregate)", plan.split("BroadcastExchange")[0])
    assert segment.numbered(df.limit(0), [F.col("ord")], "place", str(tmp_path / "y")).count() == 0


EVENTS = "video string, ord int, seat_id int, start_sec double, action_label string, detector_class string, rule string"


def test_indexed_search_equals_the_scan(spark, tmp_path):
    rng = random.Random(6)
    labels = ["mobile_phone_usage", "paper_pass", "talking_to_neighbour", "other_thing", None]
    rows = [(rng.choice("ab"), i, rng.choice([None, rng.randrange(40)]), rng.uniform(0, 9000), rng.choice(labels), rng.choice([None, "cell phone (COCO 67)", "Book"]), rng.choice([None, "Rule Aa", "xyz", ""])) for i in range(300)]
    events = spark.createDataFrame(rows, EVENTS)
    search.write_search_index(events, str(tmp_path), ["video", "ord"])
    for needle in ["phone", " Phone", "PAPER", "seat 1", "00:1", "aaa", "xyz", "z", "", "  ", "rule aa", "ook", "None", "01:02:03", "no such"]:
        got = sorted(r["ord"] for r in search.indexed_search(spark, str(tmp_path), events, needle, ["video", "ord"]).collect())
        assert got == sorted(r["ord"] for r in event_search(events, needle).collect()), needle
    plan = search.indexed_search(spark, str(tmp_path), events, "phone", ["video", "ord"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [slot" in plan


def test_postings_grow_with_texts_not_with_events(spark, tmp_path):
    """An event is a row for each of its texts; equal texts share their postings."""
    from pathlib import Path

    size = {}
    for n in (20, 400):
        rows = [("a", i, i % 4, 60.0 * (i % 5), "paper_pass", None, "Rule Aa") for i in range(n)]
        search.write_search_index(spark.createDataFrame(rows, EVENTS), str(tmp_path / str(n)), ["video", "ord"])
        folders = {f.parent.parent for f in Path(tmp_path / str(n)).rglob("slot=*/*.parquet")}
        size[n] = {f.name: spark.read.parquet(str(f)).count() for f in folders}
    assert size[20]["grams"] == size[400]["grams"] and size[400]["events"] == 5 * 400
    hit = search.indexed_search(spark, str(tmp_path / "400"), spark.createDataFrame(rows, EVENTS), "seat 3", ["video", "ord"])
    assert sorted(r["ord"] for r in hit.collect()) == list(range(3, 400, 4))


def test_small_pieces(spark, tmp_path):
    d = spark.createDataFrame([(1, 67, 0.2), (2, 67, 0.1), (3, 73, 0.15), (4, 0, 0.9), (5, None, 0.9), (6, 67, None)], "det_idx int, cls_id int, conf double")
    assert sorted(r["det_idx"] for r in detections.scan_detections(d, {67: 0.2, 73: 0.12}).collect()) == [1, 3]
    sizes = spark.createDataFrame([(100, 50), (1280, 3), (700, 720), (9000, 1), (656, 10)], "w int, h int").select(detections.detection_sizes(F.col("w"), F.col("h")).alias("s"))
    assert [r["s"] for r in sizes.collect()] == [[640, 1280, 160], [640, 1280], [640, 1280, 704], [640, 1280, 1600], [640, 1280]]  # halves go to the even step
    raw = spark.createDataFrame([("a", None, None, 0.0, None, 0), ("b", 0.0, 30.0, None, 7.5, 3), ("c", 12.0, 30.0, 9.0, 8.0, None)], "video string, average_rate double, base_rate double, container_s double, stream_s double, frames long")
    assert [(r["fps"], r["duration_s"], r["frames"]) for r in readers.probed(raw).collect()] == [(25.0, 0.0, None), (30.0, 7.5, 3), (12.0, 9.0, None)]
    cover = spark.createDataFrame([("a", 0, 0.4, -0.5), ("a", 1, 0.1, 0.0), ("b", 0, -0.9, 0.2), ("c", 0, None, None)], "video string, bin int, gmv_x double, gmv_y double")
    got = {r["video"]: (r["residual"], r["moving"], r["note"]) for r in nuisance.camera_motion(cover, keys=["video"]).collect()}
    assert got["a"] == (0.5, False, None) and got["c"] == (0.0, False, None) and got["b"][:2] == (0.9, True) and "0.90 px" in got["b"][2]
    events = spark.createDataFrame([("a", 1.23456, 2.345, 0.98765)], "video string, start_sec double, end_sec double, confidence double")
    sinks.write_timeline(events, str(tmp_path / "t"))
    lines = [json.loads(x) for f in (tmp_path / "t").glob("*.json") for x in f.read_text().splitlines()]
    assert lines == [{"video": "a", "start_sec": 1.23, "end_sec": 2.34, "confidence": 0.988}]
    assert P.fps == 5.0 and detections.thin_frames(spark.range(11).select(F.lit(1).alias("k"), (F.col("id") / 8).alias("t")), None, ["k"]).count() == 6


def test_several_recordings_need_keys(spark):
    seats = spark.createDataFrame([("a", 1, 0.0, 0.0, 1.0, 1.0)], "video string, seat_id int, x0 double, y0 double, x1 double, y1 double")
    with pytest.raises(ValueError):
        detections.assign_sweep(seats.drop("seat_id"), seats)
