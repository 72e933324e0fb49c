"""Suppression by a grid against all comparisons, and on many boxes of one frame."""

import time

import numpy as np
import pytest

from seatwatch.operators import detections


def plain(boxes, most):
    kept = []
    for i, b in enumerate(boxes):
        w = np.maximum(np.minimum(b[2], boxes[kept, 2]) - np.maximum(b[0], boxes[kept, 0]), 0)
        h = np.maximum(np.minimum(b[3], boxes[kept, 3]) - np.maximum(b[1], boxes[kept, 1]), 0)
        union = (b[2] - b[0]) * (b[3] - b[1]) + (boxes[kept, 2] - boxes[kept, 0]) * (boxes[kept, 3] - boxes[kept, 1]) - w * h
        if not ((w * h > 0) & (w * h / np.where(union > 0, union, 1) > most)).any():
            kept.append(i)
    return kept


def boxes(seed, n, spread):
    """Boxes of all sizes on a lattice, with copies, empty and backward ones."""
    rng = np.random.default_rng(seed)
    at = rng.integers(0, spread, (n, 2)) * 14.0 - 100
    side = rng.choice([1.0, 42.0, 60.0, 138.0, 900.0, 0.0, -5.0], (n, 2), p=[0.1, 0.3, 0.2, 0.2, 0.1, 0.05, 0.05])
    return np.concatenate([at, at + side + rng.integers(0, 3, (n, 2))], 1)


@pytest.mark.parametrize("most", [0.0, 0.3, 0.6, 0.99, 1.0])
@pytest.mark.parametrize("spread", [3, 12, 4000])
def test_kept_boxes_equal_all_comparisons(most, spread):
    for seed in range(6):
        some = boxes(seed, 400, spread)
        assert detections.kept_boxes(some, most).tolist() == plain(some, most)
    assert detections.kept_boxes(np.zeros((0, 4)), most).tolist() == []


def test_a_crowded_frame(spark):
    """A fold over 200,000 boxes that carries what is kept would take hours."""
    rng = np.random.default_rng(1)
    x, y, side = rng.integers(0, 80, 200_000) * 14.0, rng.integers(0, 40, 200_000) * 14.0, 40 + 2.0 * rng.integers(1, 51, 200_000)
    some = np.stack([x, y, x + side, y + side], 1)
    began = time.time()
    kept = detections.kept_boxes(some, 0.6)
    assert time.time() - began < 30 and 1000 < len(kept) < 10_000


def test_other_columns_and_missing_values(spark):
    rows = [(1, 2, 0, 0.5, 0.0, 0.0, 10.0, 10.0, "b"), (1, 1, 0, None, 0.0, 0.0, 10.0, 10.0, "a"), (1, 3, 0, 0.9, None, 0.0, 10.0, 10.0, "c"), (2, None, None, 0.9, 0.0, 0.0, 10.0, 10.0, None)]
    df = spark.createDataFrame(rows, "frame int, det_idx int, cls_id int, conf double, x0 double, y0 double, x1 double, y1 double, name string")
    got = detections.suppress(df)
    assert got.dtypes == df.dtypes and {(r["det_idx"], r["name"]) for r in got.collect()} == {(1, "a"), (3, "c"), (None, None)}
