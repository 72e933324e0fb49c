"""Parameters of the engine; the defaults are semantics, recorded with every manifest."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

#: Classes of detected objects (fixed values).
PERSON, PHONE, BOOK = 0, 67, 73

DISCLAIMER = "Labels name observed behaviour. They state no intent and no verdict; every event is for a human to review."


@dataclass(frozen=True)
class Params:
    cell_px: int = 16
    bin_s: float = 1.0
    calibration_s: float = 120.0
    baseline_s: float = 60.0
    z_threshold: float = 3.5
    corr_lag_s: float = 2.0
    min_event_s: float = 1.5
    pelt_penalty: float = 10.0
    budget: float = 0.02
    # nuisance filters
    prominence: float = 0.35
    min_hz: float = 0.05
    illumination_share: float = 0.60
    distrust_share: float = 0.20
    camera_px: float = 0.5
    # scale floors of the robust score
    seat_scale_floor: float = 0.25
    global_floor: float = 0.05
    mad_scale: float = 1.4826
    # perception
    fps: float = 5.0
    crop_pad: float = 1.6
    detection_conf: float = 0.25
    phone_conf: float = 0.20
    book_conf: float = 0.12
    link_share: float = 0.25
    link_least: float = 16.0
    paper_ids: int = 20_000
    phone_ids: int = 30_000
    nms_iou: float = 0.6
    scales: tuple[int, ...] = (640, 1280)
    scale_step: int = 32
    least_scale: int = 160
    most_scale: int = 1600
    # person tracks
    track_high: float = 0.25
    track_low: float = 0.10
    track_new: float = 0.25
    track_match: float = 0.8
    track_faint_match: float = 0.5
    track_confirm_match: float = 0.7
    track_buffer: int = 30
    # seats
    seat_samples: int = 48
    motion_percentile: float = 70.0
    motion_cells: int = 2
    occupancy: float = 0.45
    seat_join_iou: float = 0.35
    seat_windows: int = 6
    seat_merge_iou: float = 0.4
    adjacency_gap: float = 1.8
    row_gap: float = 0.6
    # assignment
    assign_iou: float = 0.10
    unseated_iou: float = 0.25
    # fixtures
    fixture_drift: float = 0.75
    fixture_samples: int = 8
    fixture_span_s: float = 300.0
    fixture_span_share: float = 0.25
    fixture_presence: float = 0.0
    fixture_iou: float = 0.30
    # rules
    phone_hits: int = 3
    talk_s: float = 4.0
    talk_corr: float = 0.35
    talk_reject_corr: float = 0.95
    talk_reject_iou: float = 0.10
    transit_displacement: float = 0.5
    transit_frames: int = 3
    transit_cap: float = 0.22
    unclassified_cap: float = 0.20
    exchange: bool = False
    exchange_hold_s: float = 3.0
    crowd_persons: int = 4
    crowd_s: float = 5.0
    # sparse sweep
    sweep_samples: int = 720
    sweep_step_s: float = 5.0
    sweep_run: int = 3
    sweep_share: float = 0.6
    sweep_phone_share: float = 0.6  # of phone_conf
    # evaluation and clips
    dedupe_tiou: float = 0.3
    match_tiou: float = 0.1
    clip_pad_s: float = 5.0
    hold_s: float = 0.30

    def key(self) -> str:
        """Short hash for the paths of stored intermediates, so that none outlives its parameters."""
        return hashlib.sha1(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:10]


DEFAULTS = Params()
