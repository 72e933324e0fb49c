"""Greedy nearest links by a grid against all comparisons, and between crowded frames."""

import time

import numpy as np
import pytest

from seatwatch.operators import detections


def plain(at, last, reach):
    free, out = list(range(len(last))), []
    for p in at:
        far = [np.sqrt((p[0] - last[k][0]) ** 2 + (p[1] - last[k][1]) ** 2) for k in free]
        best = min(far, default=np.inf)
        out.append(free.pop(far.index(best)) if best < reach else -1)
    return out


@pytest.mark.parametrize("reach", [2.0, 15.0, 1e9])
@pytest.mark.parametrize("kind", ["lattice", "far", "one place", "line"])
def test_links_equal_all_comparisons(reach, kind):
    for seed in range(8):
        rng = np.random.default_rng(seed)
        n, m = rng.integers(0, 120, 2)
        spread = {"lattice": (12, 9), "far": (4000, 10), "one place": (1, 1), "line": (60, 1)}[kind]
        at, last = (rng.integers(0, spread, (c, 2)).astype(float) for c in (n, m))
        at = at + (500 if kind == "far" and seed % 2 else 0)
        want = plain(at, last, reach)
        assert detections.nearest_free(at, last, reach, dense=0).tolist() == want
        assert detections.nearest_free(at, last, reach).tolist() == want


def test_crowded_frames():
    """All distances of two frames of 60,000 boxes would take 29 GB."""
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, [1180, 620], (60_000, 2)).astype(float) for _ in range(2))
    began = time.time()
    found = detections.nearest_free(a, b, 160.0)
    assert time.time() - began < 60 and len(set(found[found >= 0])) == (found >= 0).sum() > 59_000
