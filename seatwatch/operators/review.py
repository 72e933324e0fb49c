"""Queries of the review surface: events, summaries, facets, search, clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..functions.review import SET_ASIDE, camera_label, detector_text, display_activity, hms, hours_label, is_finding, label_text, place_text, priority, stem
from .segment import numbered


def api_events(events: DataFrame, video: str | None = None, label: str | None = None, min_confidence: float = 0.0, limit: int | None = None) -> DataFrame:
    """Events by falling confidence (then ord), filtered; min_confidence within 0 to 1, limit 1 or more."""
    if not 0 <= min_confidence <= 1 or (limit is not None and limit < 1):
        raise ValueError("min_confidence must lie in 0 to 1 and limit be at least 1")
    out = events.where(F.col("confidence") >= min_confidence)
    out = out if video is None else out.where(F.col("video") == video)
    out = out if label is None else out.where(F.col("action_label") == label)
    out = out.orderBy(F.col("confidence").desc(), "ord")
    return out if limit is None else out.limit(limit)


def api_summary(events: DataFrame, videos: DataFrame) -> DataFrame:
    """(kind, name, n): counts by label and by video, all events, and seconds of footage."""
    one = lambda kind, name, n: [F.lit(kind).alias("kind"), name.alias("name"), n.cast("double").alias("n")]
    labels = events.groupBy("action_label").agg(F.count("*").alias("c")).select(*one("label", F.col("action_label"), F.col("c")))
    names = events.groupBy("video").agg(F.count("*").alias("c")).select(*one("video", F.col("video"), F.col("c")))
    total = events.agg(F.count("*").alias("c")).select(*one("total", F.lit("events"), F.col("c")))
    footage = videos.agg(F.sum(F.coalesce("duration_s", F.lit(0.0))).alias("c")).select(*one("total", F.lit("footage_s"), F.coalesce("c", F.lit(0.0))))
    return labels.unionByName(names).unionByName(total).unionByName(footage)


def library_rollup(events: DataFrame, videos: DataFrame) -> DataFrame:
    """One row for each recording, the longest first: events, findings and findings by priority, with camera and length."""
    finding = is_finding(F.col("action_label"))
    of = lambda level: F.count(F.when(finding & (priority(F.col("confidence")) == level), 1)).alias(level)
    e = events.groupBy("video").agg(F.count("*").alias("events"), F.count(F.when(finding, 1)).alias("findings"), of("high"), of("medium"), of("low"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("events", "findings", "high", "medium", "low")]
    out = videos.join(e, "video", "left").select("video", camera_label(F.col("video")).alias("camera"), "duration_s", hours_label(F.col("duration_s")).alias("length"), *zero)
    return out.orderBy(F.col("duration_s").desc(), "video")


def recording_stats(stats: DataFrame, events: DataFrame) -> DataFrame:
    """stats (video, n_seats, duration_s, stage1_candidates, promoted, promoted_share, fixtures, scan_s, error) as the
    library shows them: recordings that failed are left out, absent seats and lengths are 0, with the counts of
    library_rollup, the longest first."""
    shown = stats.where(F.col("error").isNull()).withColumns({"duration_s": F.coalesce("duration_s", F.lit(0.0)), "n_seats": F.coalesce("n_seats", F.lit(0))}).drop("error")
    counts = library_rollup(events, shown.select("video", "duration_s")).drop("camera", "duration_s", "length")
    return shown.join(counts, "video").withColumn("stem", stem(F.col("video"))).orderBy(F.col("duration_s").desc(), "video")


def library_total(rollup: DataFrame) -> DataFrame:
    """One row: recordings, seconds of footage, events and findings of a rollup, and the length as shown."""
    total = rollup.agg(F.count("*").alias("recordings"), F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("duration_s"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("events", "findings", "high", "medium", "low")))
    return total.withColumn("length", hours_label(F.col("duration_s")))


def label_facets(events: DataFrame) -> DataFrame:
    return events.groupBy("action_label").agg(F.count("*").alias("n"), F.first(label_text(F.col("action_label"))).alias("text")).orderBy(F.col("n").desc(), "action_label")


def review_counts(events: DataFrame) -> DataFrame:
    """One row: events, findings, set_aside, findings by priority, recordings."""
    finding = is_finding(F.col("action_label"))
    level = priority(F.col("confidence"))
    return events.agg(
        F.count("*").alias("events"), F.count(F.when(finding, 1)).alias("findings"), F.count(F.when(F.col("action_label").isin(SET_ASIDE), 1)).alias("set_aside"),
        *(F.count(F.when(finding & (level == x), 1)).alias(x) for x in ("high", "medium", "low")), F.countDistinct("video").alias("recordings"),
    )


def activity_histogram(events: DataFrame, buckets: int = 60) -> DataFrame:
    """(video, bucket, n): events over equal parts of 0 to the recording's last start; empty ones are 0."""
    span = events.groupBy("video").agg(F.max("start_sec").alias("_m")).select("video", F.when(F.col("_m") > 0, F.col("_m")).otherwise(1.0).alias("_span"))
    n = events.join(span, "video").groupBy("video", F.least(F.lit(buckets - 1), F.floor(F.col("start_sec") / F.col("_span") * buckets)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    grid = span.select("video", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return grid.join(n, ["video", "bucket"], "left").select("video", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def finding_markers(events: DataFrame) -> DataFrame:
    """Where on its recording's bar each finding stands: start over the last start, at least 1."""
    f = events.where(is_finding(F.col("action_label")))
    last = f.groupBy("video").agg(F.greatest(F.lit(1.0), F.max("start_sec")).alias("_last"))
    return f.join(last, "video").select("video", "ord", "action_label", (F.col("start_sec") / F.col("_last")).alias("position"))


def ui_projection(events: DataFrame, folder: str) -> DataFrame:
    """Display rows: id by falling confidence (then ord) in the whole answer, times, priority, texts, activity; folder: where
    the ordered rows may be written."""
    return numbered(events, [F.col("confidence").desc(), F.col("ord")], "_id", folder).select(
        F.format_string("EVT-%05d", "_id").alias("id"), "video", "ord", camera_label(F.col("video")).alias("camera"), hms(F.col("start_sec")).alias("start"), hms(F.col("end_sec")).alias("end"),
        label_text(F.col("action_label")).alias("type"), place_text(F.col("seat_id"), F.lit(None).cast("string")).alias("place"), priority(F.col("confidence")).alias("priority"), display_activity(F.col("peak_z")).alias("activity"),
    )


def event_search(events: DataFrame, needle: str) -> DataFrame:
    """Events whose time has the text, or whose place, type, object or rule has it in lower case."""
    text = needle.strip()
    low = text.lower()
    place, kind = place_text(F.col("seat_id"), F.lit(None).cast("string")), label_text(F.col("action_label"))
    hit = F.contains(hms(F.col("start_sec")), F.lit(text))
    for c in (place, kind, detector_text(F.col("detector_class")), F.coalesce("rule", F.lit(""))):
        hit = hit | F.contains(F.lower(c), F.lit(low))
    return events.where(hit) if text else events


def flatten_evidence(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, value) of the plain entries of a JSON evidence column; rule, note, caveat, nulls and nested
    values are left out."""
    pairs = F.from_json("evidence", "map<string,string>")
    out = events.select(*keys, F.explode(pairs).alias("name", "value"))
    return out.where(~F.col("name").isin("rule", "note", "caveat") & F.col("value").isNotNull() & ~F.col("value").rlike(r"^[\[{]"))


def clip_specs(events: DataFrame, videos: DataFrame | None = None, p: Params = DEFAULTS) -> DataFrame:
    """How to cut each event's clip: padded start and length, and a file name by its place in the recording."""
    start = F.greatest(F.lit(0.0), F.col("start_sec") - p.clip_pad_s)
    length = F.greatest(F.lit(0.5), F.col("end_sec") - F.col("start_sec") + 2 * p.clip_pad_s)
    n = F.row_number().over(Window.partitionBy("video").orderBy("ord")) - 1
    return events.select("video", "ord", start.alias("ss"), length.alias("dur"), F.format_string("%s_%03d_%s.mp4", stem(F.col("video")), n, F.col("action_label")).alias("clip"))


def crop_box(x0, y0, x1, y1):
    """Crop offsets and sizes of at least 16 pixels."""
    return [x0.alias("x"), y0.alias("y"), F.greatest(x1 - x0, F.lit(16)).alias("w"), F.greatest(y1 - y0, F.lit(16)).alias("h")]


def overlay_batch(events: DataFrame, evidence: DataFrame, label: str | None = None, first_per_label: bool = True, limit: int | None = None) -> DataFrame:
    """Events with a clip, the first of each label, with their evidence window (or null) by the rounded key."""
    out = events.where(F.col("clip_path").isNotNull())
    out = out if label is None else out.where(F.col("action_label") == label)
    if first_per_label:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("action_label").orderBy("ord"))).where(F.col("_n") == 1).drop("_n")
    if limit is not None:
        out = out.orderBy("ord").limit(limit)
    return out.join(evidence_index(evidence), [stem(F.col("video")) == F.col("k_stem"), F.col("seat_id") == F.col("k_seat"), F.round("start_sec", 1) == F.col("k_start"), F.round("end_sec", 1) == F.col("k_end")], "left").drop("k_stem", "k_seat", "k_start", "k_end")


def evidence_index(evidence: DataFrame) -> DataFrame:
    """One window for each key (stem, seat, start, end rounded to 0.1 s): the latest saved."""
    keyed = evidence.select(stem(F.col("video")).alias("k_stem"), F.col("seat_id").alias("k_seat"), F.round("start_sec", 1).alias("k_start"), F.round("end_sec", 1).alias("k_end"), "window_id", "saved")
    return keyed.groupBy("k_stem", "k_seat", "k_start", "k_end").agg(F.max_by("window_id", F.struct("saved", "window_id")).alias("evidence_window"))


def featured_event(events: DataFrame) -> DataFrame:
    """The first event with a clip, else the first."""
    return events.orderBy(F.col("clip_path").isNull(), "ord").limit(1)


def with_clip_urls(events: DataFrame, files: DataFrame, base: str = "/clips/") -> DataFrame:
    """events with clip_url: null unless the file exists; files (name)."""
    name = F.substring_index("clip_path", "/", -1)
    f = files.select(F.col("name").alias("_file")).distinct()
    return events.join(f, name == F.col("_file"), "left").withColumn("clip_url", F.concat(F.lit(base), F.col("_file"))).drop("_file")


def window_roi(boxes: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """The region of each window: its seats' common box, widened about its centre, cut to the frame, in whole pixels."""
    keys = keys or ["window_id"]
    g = boxes.groupBy(*keys, "width", "height").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    w, h = (F.col("x1") - F.col("x0")) * p.crop_pad / 2, (F.col("y1") - F.col("y0")) * p.crop_pad / 2
    return g.select(*keys, F.greatest(F.lit(0.0), cx - w).cast("int").alias("x0"), F.greatest(F.lit(0.0), cy - h).cast("int").alias("y0"), F.least(F.col("width").cast("double"), cx + w).cast("int").alias("x1"), F.least(F.col("height").cast("double"), cy + h).cast("int").alias("y1"))
