"""Evaluation against ground truth.  A metric with no truth behind it is unavailable and null, never 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..functions.review import stem
from .intervals import interval_pairs, without_overlaps


def timed(truth: DataFrame) -> DataFrame:
    return truth.where(F.col("start_sec").isNotNull() & F.col("end_sec").isNotNull())


def truth_overlaps(truth: DataFrame, events: DataFrame) -> DataFrame:
    """Timed truth rows (gt_id, video, ...) with the best interval IoU over their recording's events, 0 where none."""
    # equal spans overlap alike; only they go through the buckets of all levels
    e = events.select("video", F.col("start_sec").alias("r_start"), F.col("end_sec").alias("r_end")).distinct()
    t = timed(truth)
    own = t.select("video", "gt_id", F.col("start_sec").alias("l_start"), F.col("end_sec").alias("l_end"))
    best = interval_pairs(own, e, ["video"]).groupBy("gt_id").agg(F.max("tiou").alias("best_tiou"))
    return t.join(best, "gt_id", "left").withColumn("best_tiou", F.coalesce("best_tiou", F.lit(0.0)))


def _status(measured) -> list:
    return [F.when(measured, "measured").otherwise("unavailable").alias("status")]


def recall_at_budget(truth: DataFrame, events: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Per recording of the truth: share of its timed rows that an event matches."""
    got = truth_overlaps(truth, events).groupBy("video").agg(F.avg((F.col("best_tiou") >= p.match_tiou).cast("int")).alias("recall"), F.count("*").alias("n_gt"))
    return truth.select("video").distinct().join(got, "video", "left").select("video", *_status(F.col("n_gt").isNotNull()), "recall", F.coalesce("n_gt", F.lit(0)).alias("n_gt"))


def mean_overlap(truth: DataFrame, events: DataFrame) -> DataFrame:
    got = truth_overlaps(truth, events).groupBy("video").agg(F.avg("best_tiou").alias("mean_tiou"), F.count("*").alias("n_gt"))
    return truth.select("video").distinct().join(got, "video", "left").select("video", *_status(F.col("n_gt").isNotNull()), "mean_tiou", F.coalesce("n_gt", F.lit(0)).alias("n_gt"))


def false_events(truth: DataFrame, events: DataFrame, videos: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Per recording: events that match no timed truth, by the hour; where none is timed the raw event rate.

    videos (video, duration_s).  A duration of 0 gives null rates.
    """
    t = timed(truth)
    had = t.select("video").distinct().withColumn("_timed", F.lit(True))
    unmatched = without_overlaps(events, t, ["video"], p.match_tiou).groupBy("video").agg(F.count("*").alias("n_false"))
    total = events.groupBy("video").agg(F.count("*").alias("n_events"))
    out = truth.select("video").distinct().join(videos.select("video", "duration_s"), "video", "left").join(had, "video", "left").join(unmatched, "video", "left").join(total, "video", "left")
    hours = F.col("duration_s") / 3600.0
    measured = F.col("_timed").isNotNull()
    n_false, n = F.coalesce("n_false", F.lit(0)), F.coalesce("n_events", F.lit(0))
    return out.select("video", *_status(measured), F.when(measured, n_false).alias("n_false"), F.when(measured, F.try_divide(n_false, hours)).alias("false_events_per_hour"), F.when(~measured, F.try_divide(n, hours)).alias("events_per_hour"))


def label_accuracy(truth: DataFrame, events: DataFrame, run: DataFrame) -> DataFrame:
    """Per truth row: top label (highest confidence, the first on ties by ord), labels seen, and whether they match.

    events (video, action_label, confidence, ord); run (video): recordings that were processed, with or without
    events.  Names meet exactly or else without their extension; what was not run is not_run.
    """
    key = stem(F.col("video"))
    exact = run.select(F.col("video").alias("_exact")).distinct()
    by_stem = run.groupBy(key.alias("_stem")).agg(F.max("video").alias("_by_stem"))
    t = truth.join(exact, F.col("video") == F.col("_exact"), "left").join(by_stem, key == F.col("_stem"), "left").withColumn("_name", F.coalesce("_exact", "_by_stem"))
    first = Window.partitionBy("video").orderBy(F.col("confidence").desc(), "ord")
    top = events.withColumn("_n", F.row_number().over(first)).groupBy("video").agg(F.max(F.when(F.col("_n") == 1, F.col("action_label"))).alias("top_label"), F.count("*").alias("n_events"), F.array_sort(F.collect_set("action_label")).alias("labels_seen"))
    out = t.join(top.withColumnRenamed("video", "_v"), F.col("_name") == F.col("_v"), "left")
    ran = F.col("_name").isNotNull()
    return out.select(
        "gt_id", "video", F.col("label").alias("expected"), F.when(ran, "scored").otherwise("not_run").alias("status"), "top_label",
        F.when(ran, F.coalesce("n_events", F.lit(0))).alias("n_events"), "labels_seen",
        F.when(ran, F.coalesce(F.col("top_label") == F.col("label"), F.lit(False))).alias("top_label_correct"),
        F.when(ran, F.coalesce(F.array_contains("labels_seen", F.col("label")), F.lit(False))).alias("label_present"),
    )


def accuracy_summary(per_row: DataFrame) -> DataFrame:
    scored = F.when(F.col("status") == "scored", 1)
    share = lambda c: F.avg(F.when(F.col("status") == "scored", F.col(c).cast("int"))).alias(c)
    out = per_row.agg(F.count(scored).alias("n_files_scored"), share("top_label_correct"), share("label_present"))
    return out.select(*_status(F.col("n_files_scored") > 0), "n_files_scored", "top_label_correct", "label_present")


def evaluate_all(truth: DataFrame, events: DataFrame, videos: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Recall, mean overlap and false events of each recording in one row; names as the truth has them."""
    r = recall_at_budget(truth, events, p).select("video", "status", "recall", "n_gt")
    m = mean_overlap(truth, events).select("video", "mean_tiou")
    f = false_events(truth, events, videos, p).select("video", "n_false", "false_events_per_hour", "events_per_hour")
    return r.join(m, "video").join(f, "video")
