"""Evaluation takes each span of a recording's events once through the buckets of all levels."""

from seatwatch.operators import evaluate


def test_equal_spans_meet_truth_once(spark, monkeypatch):
    truth = spark.createDataFrame([(1, "a", 0.0, 10.0), (2, "b", 5.0, 9.0), (3, "b", None, None)], "gt_id int, video string, start_sec double, end_sec double")
    events = spark.range(20_000).selectExpr("IF(id % 2 = 0, 'a', 'b') AS video", "CAST(id % 10 AS double) AS start_sec", "CAST(id % 10 + 4 AS double) AS end_sec")
    met, pairs = [], evaluate.interval_pairs
    monkeypatch.setattr(evaluate, "interval_pairs", lambda left, right, keys: met.append(right.count()) or pairs(left, right, keys))
    got = {r["gt_id"]: round(r["best_tiou"], 9) for r in evaluate.truth_overlaps(truth, events).collect()}
    assert met == [10] and got == {1: 0.4, 2: 1.0}
