"""Fixtures from boxes that come in parts, no group of them as a whole."""

import numpy as np
import pytest

from seatwatch.operators import detections

BOXES = "video int, t double, det_idx int, cls_id int, x0 double, y0 double, x1 double, y1 double"


def test_hull_holds_the_farthest_point():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 10, 300):
        points = rng.integers(0, 30, (n, 2)).astype(float)
        corners = np.array(detections.hull(points.tolist()))
        for at in rng.uniform(-40, 70, (20, 2)):
            assert np.hypot(*(corners - at).T).max() == np.hypot(*(points - at).T).max()
    assert len(corners) < 40


@pytest.mark.parametrize("block_s", [None, 20.0])
def test_parts_change_nothing(spark, block_s):
    rng = np.random.default_rng(2)
    rows = [(v, i / 5, k, 67, float(x := rng.integers(0, 4) * 60 + rng.integers(0, 9)), 0.0, float(x) + 40, 40.0) for v in range(2) for i in range(300) for k in range(2)]
    d = spark.createDataFrame(rows, BOXES).persist()
    frames = d.select("video", "t").distinct()
    make = lambda: detections.fixture_map(d, frames, keys=["video"], block_s=block_s)
    rounded = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.collect())
    whole, plan = rounded(make()), make()._jdf.queryExecution().optimizedPlan().toString()
    assert len(whole) >= 8 and (block_s or "FlatMapGroupsInPandas" not in plan)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    spark.catalog.clearCache()
    try:
        assert rounded(make()) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
