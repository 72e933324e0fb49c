"""Naming rules.  Labels name observed behaviour; every window gets exactly one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BOOK, DEFAULTS, PHONE, Params
from ..functions.geometry import blend, box, box_iou, clip
from .correlate import lagged_correlation, strongest
from .detections import assign_sweep, displacement
from .intervals import without_overlaps

WINDOW = ["window_id"]  #: what names a window where no recording does
LABELS = ["mobile_phone_usage", "paper_pass", "seat_exchange", "talking_to_neighbour", "staff_or_transit", "unclassified_anomaly"]


def _first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def most_common(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, value) of the commonest value; of equally common ones the first seen by ``order``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"), F.min(F.struct(*order)).alias("_seen"))
    return _first(counts, keys, F.col("_c").desc(), F.col("_seen")).select(*keys, value)


def phone(windows: DataFrame, assigned: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """windows (keys, seat_id, n_frames), assigned detections (keys, t, det_idx, cls_id, conf, seat_id)."""
    keys = keys or WINDOW
    hits = assigned.where((F.col("cls_id") == PHONE) & (F.col("conf") >= p.phone_conf))
    own = hits.groupBy(*keys).agg(F.count("*").alias("hits"), F.countDistinct(F.round("t", 3)).alias("frames"), F.avg("conf").alias("strength")).where(F.col("hits") >= p.phone_hits)
    seat = most_common(hits, keys, "seat_id", ["t", "det_idx"]).withColumnRenamed("seat_id", "_seat")
    out = windows.join(own, keys).join(seat, keys, "left")
    persistence = F.col("frames") / F.greatest(F.col("n_frames"), F.lit(1))
    return out.select(*keys, blend(persistence / 0.5, F.col("strength")).alias("confidence"), F.coalesce("_seat", "seat_id").alias("evidence_seat"), "frames", "strength")


def paper(windows: DataFrame, assigned: DataFrame, edges: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None, recording: list[str] | None = None) -> DataFrame:
    """A tracked book-class object whose first and last seats differ and adjoin; the best of each window.

    edges (recording, a, b) both ways; recording: those of the keys that edges have too.  Of equal confidences the
    track seen first wins.
    """
    keys, recording = keys or WINDOW, recording or []
    lead = [*keys, "track_id"]
    obs = assigned.where((F.col("cls_id") == BOOK) & (F.col("conf") >= p.book_conf) & F.col("track_id").isNotNull())
    seen = obs.groupBy(*lead).agg(F.min(F.struct("t", "det_idx")).alias("_seen"))
    seq = obs.where(F.col("seat_id").isNotNull())
    at = F.struct("t", "det_idx")
    ends = seq.groupBy(*lead).agg(F.count("*").alias("n"), F.min_by("seat_id", at).alias("from_seat"), F.max_by("seat_id", at).alias("to_seat"), F.avg("conf").alias("strength"))
    ends = ends.where((F.col("n") >= 2) & (F.col("from_seat") != F.col("to_seat"))).join(edges.select(*recording, F.col("a").alias("from_seat"), F.col("b").alias("to_seat")).distinct(), [*recording, "from_seat", "to_seat"], "left_semi")
    held = seq.join(ends.select(*lead, "from_seat", "to_seat"), lead).groupBy(*lead).agg(F.sum((F.col("seat_id") == F.col("from_seat")).cast("int")).alias("n_a"), F.sum((F.col("seat_id") == F.col("to_seat")).cast("int")).alias("n_b"))
    out = ends.join(held, lead).join(seen, lead).join(windows.select(*keys, "n_frames"), keys)
    persistence = (F.col("n_a") + F.col("n_b")) / F.greatest(F.col("n_frames"), F.lit(1))
    out = out.withColumn("confidence", blend(persistence / 0.4, F.col("strength")) * 0.85)
    return _first(out, keys, F.round("confidence", 9).desc(), F.col("_seen")).select(*keys, "confidence", "track_id", "from_seat", "to_seat", "n_a", "n_b")


def exchange(windows: DataFrame, assigned: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """Two tracked persons who end in each other's seats and stay; nothing unless the rule is enabled."""
    keys, t_order = keys or WINDOW, ["t", "det_idx"]
    lead = [*keys, "track_id"]
    obs = assigned.where((F.col("cls_id") == 0) & F.col("track_id").isNotNull())
    seen = obs.groupBy(*lead).agg(F.min(F.struct(*t_order)).alias("seen"))
    obs = obs.where(F.col("seat_id").isNotNull())
    span = obs.groupBy(*lead).agg(F.count("*").alias("n"), F.min("t").alias("_t0"), F.max("t").alias("_t1")).where(F.col("n") >= 2)
    near = obs.join(span, lead)
    head = most_common(near.where(F.col("t") <= F.col("_t0") + p.exchange_hold_s), lead, "seat_id", t_order).withColumnRenamed("seat_id", "start")
    tail = near.where(F.col("t") >= F.col("_t1") - p.exchange_hold_s)
    end = most_common(tail, lead, "seat_id", t_order).withColumnRenamed("seat_id", "end")
    hold = tail.join(end, lead).groupBy(*lead).agg(F.avg((F.col("seat_id") == F.col("end")).cast("int")).alias("hold"))
    ends = span.select(*lead, "n").join(head, lead).join(end, lead).join(hold, lead).join(seen, lead).where(F.col("start") != F.col("end"))
    a = ends.select(*keys, *(F.col(c).alias(f"a_{c}") for c in ("track_id", "n", "start", "end", "hold", "seen")))
    b = ends.select(*keys, *(F.col(c).alias(f"b_{c}") for c in ("track_id", "n", "start", "end", "hold", "seen")))
    pairs = a.join(b, keys).where((F.col("a_start") == F.col("b_end")) & (F.col("a_end") == F.col("b_start")) & (F.col("a_seen") < F.col("b_seen")))
    out = pairs.join(windows.select(*keys, "n_frames"), keys).where(F.lit(p.exchange))
    persistence = (F.col("a_n") + F.col("b_n")) / F.greatest(2 * F.col("n_frames"), F.lit(1))
    out = out.withColumn("confidence", blend(persistence / 0.5, (F.col("a_hold") + F.col("b_hold")) / 2))
    return _first(out, keys, F.round("confidence", 9).desc(), F.col("a_seen"), F.col("b_seen")).select(*keys, "confidence", F.col("a_track_id").alias("track_a"), F.col("b_track_id").alias("track_b"), F.col("a_start").alias("seat_a"), F.col("b_start").alias("seat_b"))


def talking(windows: DataFrame, neighbours: DataFrame, scores: DataFrame, seats: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None, recording: list[str] | None = None) -> DataFrame:
    """Sustained correlated activity with a neighbour.

    windows (keys, seat_id, i0, i1, duration_s), neighbours (keys, neighbour, ord), scores (recording, seat_id, bin, z),
    seats (recording, seat_id, x0 .. y1); recording: those of the keys that name it.  A window's bins end with its own
    recording's, and its seats meet only that recording's.
    Near-perfect correlation at lag 0 of overlapping boxes is one motion counted twice and is rejected.
    """
    keys, recording = keys or WINDOW, recording or []
    last = scores.groupBy(*recording).agg((F.max("bin") + 1).alias("_bins"))
    able = windows.where(F.col("duration_s") >= p.talk_s).join(neighbours, keys)
    spans = able.join(last, recording) if recording else able.join(F.broadcast(last), F.lit(True))  # one row
    spans = spans.select(*keys, F.col("seat_id").alias("seat_a"), F.col("neighbour").alias("seat_b"), F.greatest(F.col("i0") - 2, F.lit(0)).alias("lo"), F.least(F.col("i1") + 2, F.col("_bins")).alias("hi"))
    got = lagged_correlation(scores, spans, p, [k for k in keys if k not in recording], recording)
    best = strongest(got.join(neighbours.select(*keys, F.col("neighbour").alias("seat_b"), "ord"), [*keys, "seat_b"]), keys).where(F.col("corr") >= p.talk_corr)
    one = lambda c, n: seats.select(*recording, F.col("seat_id").alias(c), *(F.col(x).alias(f"{n}{x}") for x in ("x0", "y0", "x1", "y1")))
    out = best.join(windows.select(*keys, "duration_s"), keys).join(one("seat_a", "a_"), [*recording, "seat_a"], "left").join(one("seat_b", "b_"), [*recording, "seat_b"], "left")
    out = out.withColumn("seat_iou", F.coalesce(box_iou(box("a_"), box("b_")), F.lit(0.0)))
    out = out.where(~((F.col("corr") >= p.talk_reject_corr) & (F.col("lag_s") == 0) & (F.col("seat_iou") > p.talk_reject_iou)))
    persistence = F.least(F.lit(1.0), F.col("duration_s") / (2 * p.talk_s))
    return out.select(*keys, (blend(persistence, F.col("corr")) * 0.8).alias("confidence"), F.col("seat_b").alias("neighbour"), "corr", "lag_s", "seat_iou")


def transit(windows: DataFrame, tracks: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """A person who crosses the scene, by distance in own box diagonals; the best track of each window.

    tracks (keys, track_id, t, cx, cy, diag, seat_id).  Of equal confidences the smaller track id wins.
    """
    keys = keys or WINDOW
    moved = displacement(tracks, p, keys).where(F.col("displacement") >= p.transit_displacement)
    loose = tracks.groupBy(*keys, "track_id").agg(F.avg(F.col("seat_id").isNull().cast("int")).alias("unseated"))
    out = moved.join(loose, [*keys, "track_id"]).join(windows.select(*keys, "n_frames"), keys)
    steady = F.least(F.lit(1.0), F.col("n") / F.greatest(F.col("n_frames"), F.lit(1)))
    far = F.least(F.lit(1.0), F.col("displacement") / (2 * p.transit_displacement))
    out = out.withColumn("confidence", F.least(F.lit(p.transit_cap), blend(steady, far) * 0.85))
    return _first(out, keys, F.round("confidence", 9).desc(), F.col("track_id")).select(*keys, "confidence", "track_id", "displacement", "unseated", "n")


def classify(windows: DataFrame, found: dict[str, DataFrame], p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """One label for each window: transit before all, else the most confident rule (the first in LABELS on
    ties) with the others in also_matched, else unclassified_anomaly: no flag is dropped for want of a name.

    windows (keys, mean_z); found: label -> (keys, confidence, evidence columns), each with one row a window at most.
    """
    keys = keys or WINDOW
    every = None
    for i, label in enumerate(LABELS[:-1]):
        if label in found:
            cols = [c for c in found[label].columns if c not in (*keys, "confidence")]
            one = found[label].select(*keys, F.lit(label).alias("label"), F.lit(-1 if label == "staff_or_transit" else i).alias("_order"), "confidence", F.to_json(F.struct(*cols)).alias("evidence"))
            every = one if every is None else every.unionByName(one)
    w = Window.partitionBy(*keys).orderBy((F.col("_order") >= 0).cast("int"), F.round("confidence", 9).desc(), "_order")
    ranked = every.withColumn("_n", F.row_number().over(w))
    rest = F.array_sort(F.collect_list(F.when((F.col("_n") > 1) & (F.col("_order") >= 0), F.col("label"))))
    top = ranked.groupBy(*keys).agg(F.max_by(F.struct("label", "confidence", "evidence", "_order"), -F.col("_n")).alias("_t"), rest.alias("_rest"))
    plain = clip(F.col("mean_z") / 40.0, 0.05, p.unclassified_cap)
    out = windows.select(*keys, "mean_z").join(top, keys, "left")
    also = F.when((F.col("_t._order") >= 0) & (F.size("_rest") > 0), F.col("_rest")).otherwise(F.array().cast("array<string>"))
    return out.select(*keys, F.coalesce("_t.label", F.lit(LABELS[-1])).alias("label"), F.coalesce("_t.confidence", plain).alias("confidence"), also.alias("also_matched"), "_t.evidence")


def crowds(counts: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """Maximal runs of frames (keys, t, n) with n of at least crowd_persons that last crowd_s."""
    keys = keys or []
    by = Window.partitionBy(*keys).orderBy("t")
    c = counts.withColumn("_i", F.row_number().over(by)).where(F.col("n") >= p.crowd_persons)
    c = c.withColumn("_run", F.col("_i") - F.row_number().over(by))
    runs = c.groupBy(*keys, "_run").agg(F.min("t").alias("start_sec"), F.max("t").alias("end_sec"), F.max("n").alias("peak"), F.avg("n").alias("mean"))
    length = F.col("end_sec") - F.col("start_sec")
    conf = clip(0.5 * F.least(F.lit(1.0), length / (3 * p.crowd_s)) + 0.5 * F.least(F.lit(1.0), (F.col("mean") - p.crowd_persons + 1) / p.crowd_persons), 0.05, 0.97)
    return runs.where(length >= p.crowd_s).select(*keys, "start_sec", "end_sec", "peak", "mean", conf.alias("confidence"))


#: Seconds of a sweep whose samples are numbered and whose runs are found together, and samples that a task holds at most.
RUN_BLOCK_S, TASK_SAMPLES = 3600.0, 20_000


def persistent_objects(samples: DataFrame, assigned: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None, by: list[str] | None = None, block_s: float = RUN_BLOCK_S, parts: int | None = None) -> DataFrame:
    """Runs of sweep samples with an object at one seat; single missing samples do not end a run.

    samples (keys, t): all of them; assigned (keys, by, t, seat_id, conf); by: what tells kinds of objects apart.  A run
    needs sweep_run samples and a share of sweep_share with the object.  Runs are found in blocks of block_s seconds, dealt
    to ``parts`` tasks; only the first and last of a block can go on beyond it, so these alone are chained along the recording.
    """
    keys, lead = keys or [], [*(keys or []), *(by or []), "seat_id"]
    at, own = [*keys, "_block"], [*lead, "_block"]

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_block", F.floor(F.col("t") / block_s)).repartition(*([parts] if parts else []), *at)

    def chained(rows: DataFrame, own: list[str], first: str, last: str) -> DataFrame:
        w = Window.partitionBy(*own).orderBy(first)
        rows = rows.withColumn("_new", (F.coalesce(F.col(first) - F.lag(last).over(w), F.lit(99)) > 2).cast("int"))
        return rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def good(samples: Column, hits: Column) -> Column:
        return (samples >= p.sweep_run) & (hits / samples >= p.sweep_share)

    # samples and hits lie in one set of rows, dealt once: a hit's place in its block is the number of samples up to it
    marks = samples.select(*keys, "t").where(F.col("t").isNotNull()).distinct().withColumn("_sample", F.lit(1))
    rows = dealt(assigned.select(*lead, "t", "conf").withColumn("_sample", F.lit(0)).unionByName(marks, allowMissingColumns=True)).groupBy(*own, "t", "_sample").agg(F.max("conf").alias("conf"))
    rows = rows.withColumn("_n", F.sum("_sample").over(Window.partitionBy(*at).orderBy("t"))).withColumn("_known", F.max("_sample").over(Window.partitionBy(*at, "t")))
    sizes = marks.groupBy(*keys, F.floor(F.col("t") / block_s).alias("_block")).agg(F.count("*").alias("_size"))  # a row a block
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_block")) - F.col("_size")
    hits = rows.where((F.col("_sample") == 0) & (F.col("_known") == 1)).join(sizes.select(*at, before.alias("_before")), at).withColumn("_i", F.col("_before") + F.col("_n"))
    found = chained(hits, own, "_i", "_i").groupBy(*own, "_run").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("_i").alias("i0"), F.max("_i").alias("i1"), F.count("*").alias("n"), F.sum("conf").alias("_sum"), F.count("conf").alias("_some"))
    inner = (F.col("_run") > 1) & (F.col("_run") < F.max("_run").over(Window.partitionBy(*own)))
    found = found.withColumn("_alone", F.when(inner, F.struct("_block", "_run"))).drop("_run").where(F.col("_alone").isNull() | good(F.col("i1") - F.col("i0") + 1, F.col("n")))
    own = [*lead, "_alone"]
    runs = chained(found, own, "i0", "i1").groupBy(*own, "_run").agg(F.min("t0").alias("start_sec"), F.max("t1").alias("end_sec"), (F.max("i1") - F.min("i0") + 1).alias("samples"), F.sum("n").alias("hits"), (F.sum("_sum") / F.nullif(F.sum("_some"), F.lit(0))).alias("mean_conf"))
    share = F.col("hits") / F.col("samples")
    return runs.where(good(F.col("samples"), F.col("hits"))).select(*lead, "start_sec", "end_sec", "samples", "hits", "mean_conf", clip(blend(share, F.col("mean_conf")) * 0.9, 0.05, 0.9).alias("confidence"))


def sweep_events(samples: DataFrame, sweep: DataFrame, seats: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """(keys, action_label, seat_id, start_sec, end_sec, ...): phones and papers that a sparse sweep (keys, t, cls_id, conf,
    x0 .. y1) keeps seeing at a seat; a paper that is there is not yet one that is passed."""
    label = F.when((F.col("cls_id") == PHONE) & (F.col("conf") >= p.phone_conf * p.sweep_phone_share), "mobile_phone_usage").when((F.col("cls_id") == BOOK) & (F.col("conf") >= p.book_conf), "paper_pass_object_present")
    objects = sweep.withColumn("action_label", label).where(F.col("action_label").isNotNull())
    return persistent_objects(samples, assign_sweep(objects, seats, keys), p, keys, ["action_label"], parts=parts)


def drop_known(sweep: DataFrame, events: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """sweep events without those that an event of the same seat and label overlaps by dedupe_tiou."""
    return without_overlaps(sweep, events, [*(keys or ["video"]), "seat_id", "action_label"], p.dedupe_tiou)


def all_events(*parts: DataFrame) -> DataFrame:
    """Events of all paths as one set; columns that a path lacks are null."""
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def trigger_spec(label: Column) -> Column:
    """Which detections an overlay marks for a label: struct<cls_id, tracked>; null where none."""
    spec = lambda cls, tracked: F.struct(F.lit(cls).alias("cls_id"), F.lit(tracked).alias("tracked"))
    return F.when(label == "mobile_phone_usage", spec(PHONE, False)).when(label.startswith("paper_pass"), spec(BOOK, True)).when(label.isin("staff_or_transit", "seat_exchange"), spec(0, True))


def collect_tracks(events: DataFrame, detections: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, action_label, track, samples): for each event the detections that its overlay marks, by identity.

    events (keys, action_label, track_ids array), detections (keys, t, det_idx, cls_id, name, conf, x0 .. y1, track_id).
    A label of a class marks all of that class; transit and exchange mark the tracks that the event names; other
    labels mark nothing.  track is the track id, or the class name where there is none; samples are in order of t.
    """
    keys = keys or WINDOW
    by_class = F.when(F.col("action_label") == "mobile_phone_usage", PHONE).when(F.startswith("action_label", F.lit("paper_pass")), BOOK)
    by_track = F.col("action_label").isin("staff_or_transit", "seat_exchange")
    wanted = events.select(*keys, "action_label", by_class.alias("_cls"), F.when(by_track, F.col("track_ids")).alias("_tracks")).where(F.col("_cls").isNotNull() | F.col("_tracks").isNotNull())
    hits = detections.join(wanted, keys).where(F.coalesce(F.col("cls_id") == F.col("_cls"), F.array_contains("_tracks", F.col("track_id")), F.lit(False)))
    sample = F.struct("t", "det_idx", "x0", "y0", "x1", "y1", "conf", "name")
    return hits.groupBy(*keys, "action_label", F.coalesce(F.col("track_id").cast("string"), F.col("name")).alias("track")).agg(F.array_sort(F.collect_list(sample)).alias("samples"))
