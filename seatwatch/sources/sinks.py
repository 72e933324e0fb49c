"""Writers: stored intermediates, manifest, timeline, matrices for figures."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, DISCLAIMER, Params


def scratch(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share; a temporary folder where that is unset
    and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.gettempdir()
    return f"{base}/seatwatch-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str, p: Params = DEFAULTS, by: str | None = None) -> DataFrame:
    """df kept as Parquet under a name and the parameters' hash; what is there is read, not made again."""
    spark, path = df.sparkSession, f"{folder}/{name}-{p.key()}"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        (df.write.partitionBy(by) if by else df.write).mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def rounded(events: DataFrame) -> DataFrame:
    """Events as published: times on two decimals, confidence on three."""
    places = {"start_sec": 2, "end_sec": 2, "confidence": 3}
    return events.withColumns({c: F.bround(F.col(c), n) for c, n in places.items() if c in events.columns})


def write_manifest(events: DataFrame, stats: DataFrame, path: str, p: Params = DEFAULTS) -> None:
    """A folder with the events (sorted by video and start), the per-video stats, and a header with the
    parameters and the disclaimer, which travels with every manifest."""
    rounded(events).orderBy("video", "start_sec").write.mode("overwrite").json(f"{path}/events")
    stats.write.mode("overwrite").json(f"{path}/stats")
    header = {"generated_by": "seatwatch", "parameters": asdict(p), "disclaimer": DISCLAIMER}
    events.sparkSession.range(1).select(F.lit(json.dumps(header)).alias("value")).write.mode("overwrite").text(f"{path}/header")


def write_timeline(events: DataFrame, path: str) -> None:
    rounded(events).write.mode("overwrite").json(path)


def timeline_matrix(scores: DataFrame, seats: list[int], p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """(keys,) bin and one z column for each seat, cut at twice the threshold or 1; a report, in order."""
    keys = keys or []
    top = max(2 * p.z_threshold, 1.0)
    return scores.groupBy(*keys, "bin").pivot("seat_id", seats).agg(F.first(F.least(F.greatest("z", F.lit(0.0)), F.lit(top)))).orderBy(*keys, "bin")
