"""Sampling and thinning of frames in blocks of time, against plain walks, and on many frames."""

import random

import pytest
from pyspark.sql import functions as F

from seatwatch.operators import detections


def times(seed, n):
    """Dense, sparse and repeated times with wide gaps, some before 0."""
    rng, t, out = random.Random(seed), -700.0, []
    for _ in range(n):
        t += rng.choice([0.0, 0.1, 0.1, 0.25, 0.5, 3.0, 300.0 if rng.random() < 0.05 else 0.05])
        out.append(t)
    return out


@pytest.mark.parametrize("block_s", [0.2, 7.0, 600.0])
def test_first_frames_equal_all_comparisons(spark, block_s):
    own = {k: times(i, 300) for i, k in enumerate("ab")}
    rng = random.Random(9)
    targets = [(k, i, rng.choice([rng.uniform(-900, 3000), rng.choice(own["a"])])) for i in range(200) for k in "abc"]
    frames = spark.createDataFrame([(k, t) for k, ts in own.items() for t in ts], "k string, t double")
    got = detections.first_frames_after(spark.createDataFrame(targets, "k string, sample int, target double"), frames, ["k"], block_s=block_s)
    want = {(k, i): t for k, i, x in targets if (t := min((t for t in own.get(k, []) if t >= x - 1e-6), default=None)) is not None}
    assert {(r["k"], r["sample"]): r["t"] for r in got.collect()} == want and len(want) > 100


@pytest.mark.parametrize("block_s", [0.2, 7.0, 600.0])
def test_thinned_frames_equal_a_walk(spark, block_s):
    own = {k: times(20 + i, 400) for i, k in enumerate("ab")}
    want = set()
    for k, ts in own.items():
        due = float("-inf")
        for t in sorted(ts):
            if t >= due:
                want.add((k, t))
                due = t + 0.5
    frames = spark.createDataFrame([(k, t) for k, ts in own.items() for t in ts] + [("a", None)], "k string, t double")
    got = [(r["k"], r["t"]) for r in detections.thin_frames(frames, 2.0, ["k"], block_s=block_s).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_work_is_in_proportion_to_frames(spark):
    """A window to the end of all frames, or an array that grows a frame at a time, would take hours for these."""
    frames = spark.range(2_000_000).select(F.lit("a").alias("k"), (F.col("id") / 10).alias("t"))
    assert detections.thin_frames(frames, 2.0, ["k"]).count() == 400_000
    targets = spark.range(720).select(F.lit("a").alias("k"), F.col("id").cast("int").alias("sample"), (F.col("id") * 277.77).alias("target"))
    assert detections.first_frames_after(targets, frames, ["k"]).where("t - target BETWEEN -1e-6 AND 0.1").count() == 720
