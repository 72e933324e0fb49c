"""The evidence store by rows: the same as with one row a window, and no row that grows with a window."""

from pyspark.sql import functions as F

from seatwatch.sources import evidence

WINDOWS = "window_id int, video int, seat_id int, start_sec double, end_sec double"
BOXES = "window_id int, t double, det_idx int, cls_id int, conf double, x0 double, y0 double, x1 double, y1 double"


def data(spark, conf=0.51236):
    """Windows 0 to 5; 4 has no frames, 5 the key of 3 and more frames; detections of other times belong to none."""
    w = spark.createDataFrame([(i, i % 2, 3 if i == 5 else i, 10.0 * min(i, 3), 10.0 * min(i, 3) + 7) for i in range(6)], WINDOWS)
    frames = spark.createDataFrame([(i, 10.0 * i + k) for i in (0, 1, 2, 3, 5) for k in range(3 if i == 5 else 2)], "window_id int, t double")
    d = spark.createDataFrame([(i, t, k, 67, conf, 1.26, 2.0, 3.0, 4.0 + k) for i in range(6) for t in (10.0 * i, 10.0 * i + 9) for k in range(i)], BOXES)
    return w, frames, d


def seen(spark, folder, w):
    return {r["window_id"]: r["frames"] for r in evidence.find_evidence(spark, folder, w).collect()}


def test_rows_equal_packed_windows(spark, tmp_path):
    w, frames, d = data(spark)
    evidence.store_evidence(w, frames, d, str(tmp_path / "rows"), ["window_id"])
    evidence.write_evidence(evidence.packed(w, frames, d, ["window_id"]), str(tmp_path / "packed"))
    got = seen(spark, str(tmp_path / "rows"), w)
    assert got == seen(spark, str(tmp_path / "packed"), w)
    assert got[4] == [] and got[3] == got[5] and len(got[5]) == 3 and [len(f["detections"]) for f in got[2]] == [2, 0]
    assert evidence.stored_evidence(spark, str(tmp_path / "rows"), w).where("detection IS NOT NULL AND window_id <> 3").count() == 0 + 1 + 2 + 5


def test_rows_replace_their_windows_and_no_others(spark, tmp_path):
    w, frames, d = data(spark)
    evidence.store_evidence(w, frames, d, str(tmp_path), ["window_id"])
    _, _, again = data(spark, conf=0.9)
    evidence.store_evidence(w.where("window_id = 2"), frames, again.limit(0), str(tmp_path), ["window_id"])
    evidence.store_evidence(w.where("window_id = 1"), frames, again, str(tmp_path), ["window_id"])
    conf = {i: {x["conf"] for f in fs for x in f["detections"]} for i, fs in seen(spark, str(tmp_path), w).items()}
    assert conf == {0: set(), 1: {0.9}, 2: set(), 3: {0.5124}, 4: set(), 5: {0.5124}}


def test_a_large_window_takes_no_large_row(spark, tmp_path):
    w, frames, _ = data(spark)
    d = spark.range(50_000).select(F.lit(0).alias("window_id"), F.lit(0.0).alias("t"), F.col("id").cast("int").alias("det_idx"), F.lit(0).alias("cls_id"), F.lit(0.5).alias("conf"), *(F.lit(1.0).alias(c) for c in ("x0", "y0", "x1", "y1")))
    evidence.store_evidence(w, frames, d, str(tmp_path), ["window_id"])
    stored = evidence.stored_evidence(spark, str(tmp_path), w.where("window_id = 0"))
    assert stored.where("detection IS NOT NULL").count() == 50_000 and not any(t.startswith("array") for _, t in stored.dtypes)
