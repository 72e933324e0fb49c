"""The second and third stage end to end: detections of shortlisted windows to one label for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, PERSON, Params
from ..functions.geometry import box, centre, diagonal
from ..operators import detections as D
from ..operators import rules, tracking


def window_evidence(detections: DataFrame, frames: DataFrame, rois: DataFrame, window_seats: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """What each window saw: tracked persons, phones and papers with linked ids, each with its seat (seat_id, how).

    detections (keys, t, det_idx, cls_id, conf, x0 .. y1) of any confidence: the faint persons only keep tracks
    going.  frames (keys, t), rois (keys, x0, x1), window_seats (keys, seat_id, ord, x0 .. y1).
    """
    tracked = tracking.track_persons(detections.where(F.col("cls_id") == PERSON), frames, keys, p)
    persons = tracked.where(F.col("track_id").isNotNull() | (F.col("conf") >= p.detection_conf))
    objects = D.link_objects(detections.drop("track_id").where(F.col("conf") >= min(p.phone_conf, p.book_conf)), rois, p, keys)
    return D.assign_seats(D.perceive(persons, objects, keys), window_seats, keys, p)


def person_paths(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, track_id, t, cx, cy, diag, seat_id) of the tracked persons."""
    cx, cy = centre(box())
    return evidence.where((F.col("cls_id") == PERSON) & F.col("track_id").isNotNull()).select(*keys, "track_id", "t", cx.alias("cx"), cy.alias("cy"), diagonal(box()).alias("diag"), "seat_id")


def name_windows(windows: DataFrame, evidence: DataFrame, neighbours: DataFrame, edges: DataFrame, scores: DataFrame, seats: DataFrame, keys: list[str], recording: list[str], p: Params = DEFAULTS) -> DataFrame:
    """windows with one label each, by all rules over their evidence (kept while the rules read it)."""
    evidence = evidence.persist()
    by = {"keys": keys, "recording": recording}
    found = {
        "mobile_phone_usage": rules.phone(windows, evidence, p, keys),
        "paper_pass": rules.paper(windows, evidence, edges, p, **by),
        "seat_exchange": rules.exchange(windows, evidence, p, keys),
        "talking_to_neighbour": rules.talking(windows, neighbours, scores, seats, p, **by),
        "staff_or_transit": rules.transit(windows, person_paths(evidence, keys), p, keys),
    }
    return rules.classify(windows, found, p, keys)
