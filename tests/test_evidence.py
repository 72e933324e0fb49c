"""The evidence store: exact keys, updates, parameters, pruning."""

from dataclasses import replace

from pyspark.sql import functions as F

from seatwatch.config import DEFAULTS as P
from seatwatch.sources import evidence

WINDOWS = "window_id int, video string, seat_id int, start_sec double, end_sec double"
BOXES = "window_id int, t double, det_idx int, cls_id int, conf double, x0 double, y0 double, x1 double, y1 double"


def rows(spark, conf=0.51236, n=40):
    w = spark.createDataFrame([(i, "it's a.mp4" if i % 2 else "b.mp4", i % 5, 10.0 * i, 10.0 * i + 7.25) for i in range(n)], WINDOWS)
    frames = spark.createDataFrame([(i, 10.0 * i + k / 5) for i in range(n) for k in range(4)], "window_id int, t double")
    d = spark.createDataFrame([(i, 10.0 * i, k, 67, conf, 1.26, 2.0, 3.0, 4.0 + k) for i in range(n) for k in range(i % 3)], BOXES)
    return w, evidence.packed(w, frames, d, ["window_id"])


def test_what_is_written_is_found_by_its_exact_key_only(spark, tmp_path):
    w, packed = rows(spark)
    evidence.write_evidence(packed, str(tmp_path))
    found = evidence.find_evidence(spark, str(tmp_path), w)
    assert found.count() == 40 and found.where(F.size("frames") == 4).count() == 40
    one = evidence.unpacked(found.where("window_id = 5")).collect()
    assert [(r["det_idx"], r["conf"], r["x0"], r["y1"], r["t"]) for r in one] == [(0, 0.5124, 1.3, 4.0, 50.0), (1, 0.5124, 1.3, 5.0, 50.0)]
    near = w.withColumn("end_sec", F.col("end_sec") + 0.2)
    assert evidence.find_evidence(spark, str(tmp_path), near).where("frames IS NOT NULL").count() == 0
    assert evidence.find_evidence(spark, str(tmp_path), w, replace(P, book_conf=0.5)).where("frames IS NOT NULL").count() == 0  # other parameters
    assert evidence.find_evidence(spark, str(tmp_path / "nothing"), w).where("frames IS NOT NULL").count() == 0


def test_an_update_replaces_its_windows_and_no_others(spark, tmp_path):
    w, packed = rows(spark)
    evidence.write_evidence(packed, str(tmp_path))
    files = lambda: {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    before = files()
    _, again = rows(spark, conf=0.9)
    evidence.write_evidence(again.where("seat_id = 2 AND start_ds = 200"), str(tmp_path))
    kept = [f for f, t in before.items() if files().get(f) == t]
    assert len(before) - len(kept) == 1  # one slot was replaced
    found = {r["window_id"]: r for r in evidence.find_evidence(spark, str(tmp_path), w).collect()}
    assert len(found) == 40
    conf = {i: {d["conf"] for f in r["frames"] for d in f["detections"]} for i, r in found.items()}
    assert conf[2] == {0.9} and conf[20] == {0.5124}


def test_a_lookup_reads_one_slot(spark, tmp_path):
    _, packed = rows(spark)
    evidence.write_evidence(packed, str(tmp_path))
    got = evidence.one_window(spark, str(tmp_path), "it's a.mp4", 2, 70.0, 77.25)
    assert got.count() == 1 and evidence.one_window(spark, str(tmp_path), "b.mp4", 2, 70.0, 77.25).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(video" in plan and "slot" in plan.split("PartitionFilters")[1][:200]
    assert got.select(F.input_file_name()).distinct().count() == 1


def test_repeated_and_empty_rows(spark, tmp_path):
    w, packed = rows(spark, n=4)
    evidence.write_evidence(packed.unionByName(packed.withColumn("frames", F.slice("frames", 1, 1))), str(tmp_path))
    found = evidence.find_evidence(spark, str(tmp_path), w)
    assert found.count() == 4 and found.where(F.size("frames") == 4).count() == 4
    evidence.write_evidence(packed.limit(0), str(tmp_path))
    assert evidence.find_evidence(spark, str(tmp_path), w).where("frames IS NOT NULL").count() == 4
