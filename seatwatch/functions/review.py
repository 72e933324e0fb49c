"""Display projections of events as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Display texts of the labels (fixed values).
LABEL_TEXT = {
    "mobile_phone_usage": "Mobile Phone Usage",
    "talking_to_neighbour": "Talking to Neighbour",
    "seat_exchange": "Seat Exchange",
    "paper_pass": "Paper Pass",
    "paper_pass_object_present": "Held Object Present",
    "crowd_gathering": "Crowd Gathering",
    "staff_or_transit": "Staff / Transit",
    "unclassified_anomaly": "Unclassified Anomaly",
}

#: Labels that are set aside from findings (fixed values).
SET_ASIDE = ["staff_or_transit", "unclassified_anomaly"]


def hms(seconds: Column) -> Column:
    """HH:MM:SS of the whole seconds; hours do not wrap."""
    s = F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")
    return F.concat_ws(":", *(F.lpad(x.cast("string"), F.greatest(F.length(x.cast("string")), F.lit(2)), F.lit("0")) for x in (F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)))


def camera_label(video: Column) -> Column:
    return F.upper(F.regexp_replace(video, r"(?i)\.(mp4|mkv|avi)$", ""))


def stem(video: Column) -> Column:
    return F.regexp_replace(video, r"\.[^.]+$", "")


def priority(confidence: Column) -> Column:
    return F.when(confidence >= 0.6, "high").when(confidence >= 0.4, "medium").otherwise("low")


def label_text(label: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in LABEL_TEXT.items() for x in kv))
    return F.coalesce(F.try_element_at(known, label), F.replace(label, F.lit("_"), F.lit(" ")))


def detector_text(detector_class: Column) -> Column:
    """Without " (COCO n)..."; "None" where there is none."""
    return F.coalesce(F.regexp_replace(detector_class, r"\s*\(COCO \d+\).*", ""), F.lit("None"))


def display_activity(peak_z: Column) -> Column:
    """0 to 100 (100 at a peak of 20), 0 where stage 1 has no entry; halves round up."""
    return F.when(peak_z.isNotNull(), F.least(F.lit(100), F.floor(peak_z / 20 * 100 + 0.5))).otherwise(0).cast("int")


def place_text(seat_id: Column, zone_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("Seat "), seat_id.cast("string")), zone_id, F.lit("Zone"))


def hours_label(seconds: Column) -> Column:
    """Hours and rounded minutes, like 2h 08m."""
    minutes = F.floor((seconds - F.floor(seconds / 3600) * 3600) / 60 + 0.5).cast("int").cast("string")
    return F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h "), F.lpad(minutes, 2, "0"), F.lit("m"))


def is_finding(label: Column) -> Column:
    return ~label.isin(SET_ASIDE)
