"""Readers of the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VECTORS = "video string, frame_no long, ts double, pict_type string, dst_x int, dst_y int, motion_x int, motion_y int, motion_scale int"
VIDEOS = "video string, codec string, width int, height int, average_rate double, base_rate double, container_s double, stream_s double, frames long"
DETECTIONS = "video string, window_id long, t double, det_idx int, cls_id int, name string, conf double, x0 double, y0 double, x1 double, y1 double, track_id int"
TRUTH = "video string, start_sec string, end_sec string, seat_hint string, label string, type string, confidence_of_label string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def motion_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTORS).parquet(path)


def detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DETECTIONS).parquet(path)


def videos(spark: SparkSession, path: str) -> DataFrame:
    """Recordings as their containers tell of them."""
    return probed(spark.read.schema(VIDEOS).parquet(path))


def probed(containers: DataFrame) -> DataFrame:
    """Container facts with fps (the average rate, else the base rate, else 25) and duration_s (the container's, else the
    stream's, else 0) in place of what they are taken from; a rate or length of 0 is none, and so are 0 frames."""
    told = lambda *names: [F.nullif(F.col(n), F.lit(0.0)) for n in names]
    out = containers.withColumns({"fps": F.coalesce(*told("average_rate", "base_rate"), F.lit(25.0)), "duration_s": F.coalesce(*told("container_s", "stream_s"), F.lit(0.0)), "frames": F.nullif(F.col("frames"), F.lit(0))})
    return out.drop("average_rate", "base_rate", "container_s", "stream_s")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth rows from CSV: values trimmed, empty ones null, numbered in order of their text."""
    raw = spark.read.schema(TRUTH).option("header", True).csv(path)
    out = raw.select(*(F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in raw.columns))
    out = out.withColumns({c: F.col(c).try_cast("double") for c in ("start_sec", "end_sec")})
    return out.withColumn("gt_id", F.xxhash64(*out.columns))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The events of a manifest document."""
    doc = spark.read.option("multiLine", True).json(path)
    return doc.select(F.explode("events").alias("e")).select("e.*")
