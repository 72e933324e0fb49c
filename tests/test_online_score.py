"""Scores of a stream against the batch, over several batches, restarts and ends."""

import json

import numpy as np
import pytest

from seatwatch.operators import score
from seatwatch.streaming.online_score import complete_bins, online_z

SCHEMA = "video string, seat_id int, bin long, activity double"
KEYS = ["video", "seat_id"]


def told(rows):
    return sorted((r["video"], r["seat_id"], r["bin"], *(round(r[c], 9) for c in ("activity", "x", "baseline", "scale", "z"))) for r in rows)


def batches(folder, spark, files, floors, width, out, checkpoint):
    """Writes each list of rows as a file of the stream, and runs it until it has read them."""
    for i, rows in files:
        (folder / f"{i:03d}.json").write_text("\n".join(json.dumps(r) for r in rows))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    q = online_z(stream, floors, width, KEYS).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()


@pytest.mark.parametrize("width", [61, 5])
def test_stream_equals_batch_also_after_a_restart(spark, tmp_path, width):
    rng = np.random.default_rng(width)
    long = {("a", 0): 200, ("a", 1): 200, ("b", 0): 130, ("b", 7): 130}
    series = [(v, s, b, float(rng.gamma(2) * (8 if rng.random() < 0.05 else 1)) if rng.random() < 0.8 else 0.0) for (v, s), n in long.items() for b in range(n)]
    df = spark.createDataFrame(series, SCHEMA)
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint"
    folder.mkdir()
    rows = [dict(zip(("video", "seat_id", "bin", "activity"), r)) for r in series if r[3] > 0]  # still bins have no rows
    rows += [{"video": v, "seat_id": s, "bin": n, "activity": None} for (v, s), n in long.items()]
    parts = [[r for r in rows if r["bin"] // 37 == i] for i in range(6)]
    for p in parts:
        rng.shuffle(p)
    floors = score.scale_floors(df, keys=KEYS)
    batches(folder, spark, list(enumerate(parts))[:3], floors, width, out, checkpoint)
    early = told(spark.read.parquet(str(out)).collect())
    batches(folder, spark, [*list(enumerate(parts))[3:], (6, rows[:5])], floors, width, out, checkpoint)
    got, want = told(spark.read.parquet(str(out)).collect()), told(score.robust_z(df, width, keys=KEYS).collect())
    assert got == want
    assert 0 < len(early) < len(got) and set(early) <= set(want)


def test_short_and_empty_series():
    assert len(complete_bins(np.zeros(0), 0, 0, True, 30, 1e-6, 1.4826)) == 0
    one = complete_bins(np.array([4.0]), 0, 0, True, 30, 1e-6, 1.4826)
    assert one["bin"].tolist() == [0] and one["z"].tolist() == [0.0] and one["baseline"].tolist() == [2.0]
    assert len(complete_bins(np.ones(60), 0, 0, False, 30, 1e-6, 1.4826)) == 0
    assert complete_bins(np.ones(61), 0, 0, False, 30, 1e-6, 1.4826)["bin"].tolist() == [0]
