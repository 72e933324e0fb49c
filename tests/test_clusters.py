"""Clusters of boxes in parts against a plain walk; seats of windows that come in several parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatwatch.operators import seats


def plain(boxes, join, first_match, last_tie, weights):
    own, mean, size = [], [], []
    for b, n in zip(boxes, weights):
        v = seats.iou_many(b, np.array(mean).reshape(-1, 4))
        good = np.flatnonzero(v >= join) if join > 0 else np.flatnonzero(v > 0)
        if len(good):
            k = good[0] if first_match else np.flatnonzero(v == v.max())[-1 if last_tie else 0]
            mean[k], size[k] = (mean[k] * size[k] + b * n) / (size[k] + n), size[k] + n
        else:
            k = len(mean)
            mean.append(b)
            size.append(n)
        own.append(k)
    return own, np.array(mean)


@pytest.mark.parametrize("how", [(False, False), (True, False), (False, True)])
@pytest.mark.parametrize("join", [0.0, 0.35, 0.6])
def test_parts_equal_a_walk(how, join):
    for seed in range(5):
        rng = np.random.default_rng(seed)
        at = rng.integers(0, [2, 5, 12, 12, 40][seed], (1500, 2)) * 25.0 + rng.integers(0, 8, (1500, 2))
        boxes = np.concatenate([at, at + rng.integers(30, 60, (1500, 2))], 1)
        weights = rng.integers(1, 5, 1500)
        found = seats.Clusters(join, *how)
        own = np.concatenate([found.add(boxes[a : a + 470], weights[a : a + 470]) for a in range(0, 1500, 470)])
        want, mean = plain(boxes, join, *how, weights)
        assert own.tolist() == want and np.array_equal(found.mean[: found.k], mean)


def test_windows_in_parts(spark):
    """No part holds a whole window, and a part holds the end of one and the beginning of another."""
    d = spark.range(3000).select((F.col("id") % 3).cast("int").alias("window_id"), F.floor(F.col("id") / 30).cast("double").alias("t"), F.col("id").cast("int").alias("det_idx"), F.lit(0).alias("cls_id"), F.lit(0.5).alias("conf"), *((F.col("id") % 2 * 500 + x).cast("double").alias(c) for c, x in zip(("x0", "y0", "x1", "y1"), (0, 0, 100, 100))))
    frames = d.select("window_id", "t").distinct()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        got = seats.seat_clusters(d, frames).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["window_id"], r["n"], r["occupancy"]) for r in got) == [(w, 500, 1.0) for w in range(3) for _ in range(2)]


def test_a_long_window_is_walked_in_few_steps(monkeypatch):
    rng = np.random.default_rng(1)
    at = np.stack([rng.integers(0, 5, 20_000) * 240.0 + rng.integers(0, 20, 20_000), rng.integers(0, 4, 20_000) * 180.0 + rng.integers(0, 10, 20_000)], 1)
    calls, one = [], seats.Clusters._one
    monkeypatch.setattr(seats.Clusters, "_one", lambda *a: calls.append(1) or one(*a))
    own, mean = seats.agglomerate(np.concatenate([at, at + [200.0, 120.0]], 1), 0.35)
    assert len(mean) == 20 and len(calls) < 200
