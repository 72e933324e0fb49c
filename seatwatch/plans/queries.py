"""The registered queries, and for those that SQL expresses their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BOOK, DEFAULTS, PERSON, PHONE
from ..functions.review import LABEL_TEXT
from ..operators import correlate, detections, evaluate, motion, motion_seats, nuisance, review, rules, score, search, seats, segment, tracking
from ..sources import evidence, readers, sinks
from ..streaming import online_score
from . import calibration, perception, triage
from .views import FRAMES, LABELS, SEATS, Views, blend_sql, iou_sql, tiou_sql, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
P = DEFAULTS


def query(name: str, sql: str | None = None, *views: str):
    """Registers a function of the views."""

    def add(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Views(spark, folder))
        if sql:
            ORACLE[name] = with_views(sql, *views)
        return f

    return add


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


#: What names a window of one of several recordings, and how SQL's number of a window gives it.
WINDOW, VIDEO = ["video", "window_id"], ["video"]


def of(table: str = "") -> str:
    return f"CAST({table}window_id // 18 AS INT) AS video, CAST({table}window_id % 18 AS INT) AS window_id"


def s6(*names: str, table: str = "") -> str:
    return ", ".join(f"round({table}{n}, 6) AS {n}" for n in names)


# --- activity and scores ---------------------------------------------------------


@query("seat_activity_dense", f"SELECT seat_id, bin, {s6('activity')} FROM v_seat_activity", "v_seat_activity")
def _(v):
    return v.seat_activity().select("seat_id", "bin", *r6("activity"))


@query("activity_stabilised", "SELECT seat_id, bin, round(sqrt(greatest(activity, 0)), 6) AS root, round(ln(1 + greatest(activity, 0)), 6) AS log FROM v_seat_activity", "v_seat_activity")
def _(v):
    from ..functions.geometry import stabilise

    return v.seat_activity().select("seat_id", "bin", F.round(stabilise(F.col("activity")), 6).alias("root"), F.round(stabilise(F.col("activity"), "log1p"), 6).alias("log"))


@query("rolling_median_edge", f"SELECT seat_id, bin, {s6('baseline')} FROM v_base", "v_base")
def _(v):
    x = v.seat_activity().select("seat_id", "bin", F.sqrt("activity").alias("activity"))
    return score.rolling_median(x, score.window_bins(720)).select("seat_id", "bin", *r6("baseline"))


@query("robust_z", f"SELECT seat_id, bin, {s6('x', 'baseline', 'scale', 'z')} FROM v_z", "v_z")
def _(v):
    return v.scores().select("seat_id", "bin", *r6("x", "baseline", "scale", "z"))


@query("online_z", f"SELECT seat_id, bin, {s6('activity', 'x', 'baseline', 'scale', 'z')} FROM v_z", "v_z")
def _(v):
    """The seats' bins written in four parts, read back as a stream a part at a time; floors as of the whole series."""
    bins, folder = v.seat_activity(), sinks.scratch(v.spark)
    for i in range(4):
        part = bins.where((F.col("bin") >= i * 180) & (F.col("bin") < (i + 1) * 180) & (F.col("activity") != 0))
        if i == 3:
            part = part.unionByName(bins.select("seat_id").distinct().select("seat_id", F.lit(720).alias("bin"), F.lit(None).cast("double").alias("activity")))
        part.repartition("seat_id").write.mode("append").parquet(f"{folder}/bins")
    stream = v.spark.readStream.schema("seat_id int, bin int, activity double").parquet(f"{folder}/bins")
    z = online_score.online_z(stream, score.scale_floors(bins), 61)
    z.writeStream.format("parquet").option("path", f"{folder}/z").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.parquet(f"{folder}/z").select("seat_id", "bin", *r6("activity", "x", "baseline", "scale", "z"))


@query("z_exceedance_rate", "SELECT round(avg(CASE WHEN z > 3.5 THEN 1.0::DOUBLE ELSE 0 END), 9) AS rate, round(max(z), 6) AS max_z, count(*) AS n FROM v_z", "v_z")
def _(v):
    return score.exceedance_rate(v.scores()).select(F.round("rate", 9).alias("rate"), *r6("max_z"), "n")


@query("seat_timeline", f"SELECT bin, {', '.join(f'round(max(least(z, 7)) FILTER (WHERE seat_id = {i}), 6) AS seat_{i}' for i in range(8))} FROM v_z GROUP BY bin", "v_z")
def _(v):
    m = sinks.timeline_matrix(v.scores(), list(range(SEATS)))
    return m.select("bin", *(F.round(F.col(str(i)), 6).alias(f"seat_{i}") for i in range(SEATS)))


#: The optimal partition of each seat's z without pruning: at each end the start of least cost, the lowest of equal ones.
_PELT = """RECURSIVE prefix AS (SELECT seat_id, [0.0::DOUBLE] || list(s1 ORDER BY bin) AS s1, [0.0::DOUBLE] || list(s2 ORDER BY bin) AS s2 FROM
  (SELECT seat_id, bin, sum(z) OVER w AS s1, sum(z * z) OVER w AS s2 FROM v_z WINDOW w AS (PARTITION BY seat_id ORDER BY bin ROWS UNBOUNDED PRECEDING)) GROUP BY seat_id),
walk AS (
  SELECT seat_id, CAST(1 AS BIGINT) AS e, [-10.0::DOUBLE, 'inf'::DOUBLE] AS best, [CAST(0 AS BIGINT), 0] AS back FROM prefix
  UNION ALL
  SELECT seat_id, e + 1, list_append(best, costs[k] + 10), list_append(back, CAST(k - 1 AS BIGINT))
  FROM (SELECT *, list_position(list_transform(costs, lambda c: round(c, 6)), list_min(list_transform(costs, lambda c: round(c, 6)))) AS k FROM (SELECT w.*, list_transform(range(0, e), lambda s: w.best[s + 1] + (p.s2[e + 2] - p.s2[s + 1]) - power(p.s1[e + 2] - p.s1[s + 1], 2) / (e + 1 - s)) AS costs FROM walk w JOIN prefix p ON p.seat_id = w.seat_id WHERE e < 720))),
cuts AS (
  SELECT seat_id, back, CAST(720 AS BIGINT) AS i1 FROM walk WHERE e = 720
  UNION ALL
  SELECT seat_id, back, back[i1 + 1] FROM cuts WHERE back[i1 + 1] > 0),
pelt AS (SELECT seat_id, CAST(row_number() OVER (PARTITION BY seat_id ORDER BY i1) - 1 AS INT) AS segment, CAST(back[i1 + 1] AS INT) AS i0, CAST(i1 AS INT) AS i1 FROM cuts)"""


@query("pelt_segments", f"{_PELT} SELECT * FROM pelt", "v_z")
def _(v):
    return segment.segments(v.scores())


_CANDIDATES = """, measured AS (SELECT p.seat_id, p.i0, p.i1, max(z.z) AS peak_z, avg(z.z) AS mean_z, CAST(p.i1 - p.i0 AS DOUBLE) AS duration_s FROM pelt p JOIN v_z z ON z.seat_id = p.seat_id AND z.bin >= p.i0 AND z.bin < p.i1 GROUP BY ALL),
found AS (SELECT *, CAST(i0 AS DOUBLE) AS start_sec, CAST(i1 AS DOUBLE) AS end_sec, mean_z * sqrt(duration_s) AS salience FROM measured WHERE duration_s >= 1.5 AND mean_z >= 3.5)"""


@query("candidates", f"{_PELT}{_CANDIDATES} SELECT seat_id, i0, i1, start_sec, end_sec, {s6('peak_z', 'mean_z', 'duration_s', 'salience')} FROM found", "v_z")
def _(v):
    return segment.candidates(v.kept("scores")).select("seat_id", "i0", "i1", "start_sec", "end_sec", *r6("peak_z", "mean_z", "duration_s", "salience"))


@query("candidate_windows", f"""{_PELT}{_CANDIDATES} SELECT f.seat_id, i0, i1, greatest(0, start_sec - 1) AS t0, end_sec + 1 AS t1, s.x0, s.y0, coalesce(string_agg(CAST(n.seat_id AS VARCHAR), ',' ORDER BY n.seat_id), '') AS neighbours
FROM found f JOIN v_seats s ON s.seat_id = f.seat_id LEFT JOIN v_consecutive e ON e.a = f.seat_id LEFT JOIN v_seats n ON n.seat_id = e.b GROUP BY ALL""", "v_z", "v_seats", "v_consecutive")
def _(v):
    c = triage.candidate_windows(segment.candidates(v.kept("scores")), v.seats(), v.consecutive())
    return c.select("seat_id", "i0", "i1", "t0", "t1", "x0", "y0", F.array_join(F.transform("neighbours", lambda n: n["seat_id"].cast("string")), ",").alias("neighbours"))


@query("threshold_runs", f"SELECT seat_id, i0, i1, {s6('peak_z', 'mean_z', 'duration_s', 'salience')} FROM v_runs", "v_runs")
def _(v):
    return segment.runs_over(v.scores()).select("seat_id", "i0", "i1", *r6("peak_z", "mean_z", "duration_s", "salience"))


def _budget_sql(ranked: str, budget: float) -> str:
    """What is taken in order of rank, a candidate a step."""
    return f"""spend AS (
  SELECT CAST(0 AS BIGINT) AS rank, 0.0::DOUBLE AS spent, false AS taken
  UNION ALL
  SELECT r.rank, CASE WHEN w.spent < {budget} AND (w.spent = 0 OR w.spent + r.duration_s <= {budget}) THEN w.spent + r.duration_s ELSE w.spent END,
    w.spent < {budget} AND (w.spent = 0 OR w.spent + r.duration_s <= {budget})
  FROM spend w JOIN {ranked} r ON r.rank = w.rank + 1)"""


@query("shortlist_budget", f"RECURSIVE {_budget_sql('v_ranked', 115.2)} SELECT r.rank, seat_id, i0, i1, round(duration_s, 6) AS duration_s FROM spend w JOIN v_ranked r ON r.rank = w.rank WHERE taken", "v_ranked")
def _(v):
    return segment.budget_shortlist(segment.runs_over(v.kept("scores")).persist(), float(SEATS * 720)).select("rank", "seat_id", "i0", "i1", *r6("duration_s"))


@query("top_fraction", "SELECT rank, seat_id, i0, i1 FROM v_ranked WHERE rank <= greatest(1, round_even((SELECT count(*) FROM v_runs) * 0.1::DOUBLE, 0))", "v_ranked")
def _(v):
    return segment.top_fraction(segment.runs_over(v.scores()), 0.1).select("rank", "seat_id", "i0", "i1")


_CORR = """lags AS (SELECT i AS lag FROM range(-2, 3) l(i)),
sums AS (SELECT p.seat_a, p.seat_b, lag, count(*) AS n, sum(a.z) AS sx, sum(b.z) AS sy, sum(a.z * a.z) AS sxx, sum(b.z * b.z) AS syy, sum(a.z * b.z) AS sxy
  FROM pairs p CROSS JOIN lags JOIN v_z a ON a.seat_id = p.seat_a JOIN v_z b ON b.seat_id = p.seat_b AND b.bin = a.bin + lag GROUP BY ALL),
corrs AS (SELECT seat_a, seat_b, lag, round(greatest(CASE WHEN n >= 3 AND sxx - sx * sx / n > 1e-12 AND syy - sy * sy / n > 1e-12
  THEN (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) ELSE 0 END, 0), 9) AS corr FROM sums),
best AS (SELECT seat_a, seat_b, corr, CASE WHEN corr > 0 THEN CAST(lag AS DOUBLE) ELSE 0 END AS lag_s FROM corrs QUALIFY row_number() OVER (PARTITION BY seat_a, seat_b ORDER BY corr DESC, lag) = 1)"""


@query("triage_shortlist", f"""{(_PELT + _CANDIDATES).replace('v_z', 't_z').replace('720', '120')},
graded AS (SELECT *, row_number() OVER (ORDER BY round(salience, 9) DESC, seat_id, i0) AS rank FROM found),
{_budget_sql('graded', 60.0)}
SELECT r.rank, seat_id, i0, i1, {s6('peak_z', 'mean_z', 'duration_s')} FROM spend w JOIN graded r ON r.rank = w.rank WHERE taken""", "t_z")
def _(v):
    """From vectors to shortlist: seats are blocks of 2 x 2 cells of the 10 x 10 grid."""
    i = F.col("id")
    cells = v.spark.range(100).select((F.floor(i / 20) * 5 + F.floor(i % 10 / 2)).cast("int").alias("seat_id"), F.floor(i / 10).cast("int").alias("cy"), (i % 10).cast("int").alias("cx"))
    z = triage.triage_scores(v.motion(), cells, 120, 10, 10)
    return triage.shortlist(z, 25, 120).select("rank", "seat_id", "i0", "i1", *r6("peak_z", "mean_z", "duration_s"))


@query("person_counts", "SELECT t.frame, count(d.det_idx) AS n FROM v_times t LEFT JOIN v_sweep d ON d.frame = t.frame AND d.cls_id = 0 AND d.conf >= 0.25 GROUP BY t.frame", "v_sweep", "v_times")
def _(v):
    return detections.person_counts(v.sweep_times(), v.sweep()).select("frame", "n")


@query("lagged_corr_pairs", f", pairs AS (SELECT a.i AS seat_a, b.i AS seat_b FROM range(8) a(i) JOIN range(8) b(i) ON a.i < b.i), {_CORR} SELECT seat_a, seat_b, round(corr, 6) AS corr, lag_s FROM best", "v_z")
def _(v):
    ids = v.spark.range(SEATS).select(F.col("id").cast("int").alias("s"))
    pairs = ids.select(F.col("s").alias("seat_a"), F.explode(F.sequence(F.lit(0), F.lit(SEATS - 1))).alias("seat_b")).where("seat_a < seat_b")
    return correlate.lagged_correlation(v.kept("scores"), pairs).select("seat_a", "seat_b", *r6("corr"), "lag_s")


@query("pair_survey_top", f", pairs AS (SELECT i AS seat_a, i + 1 AS seat_b FROM range(7) r(i)), {_CORR} SELECT seat_a, seat_b, round(corr, 6) AS corr, lag_s FROM best ORDER BY best.corr DESC, seat_a LIMIT 12", "v_z")
def _(v):
    pairs = v.spark.range(SEATS - 1).select(F.col("id").cast("int").alias("seat_a"), (F.col("id") + 1).cast("int").alias("seat_b"))
    return correlate.survey(v.kept("scores"), pairs).select("seat_a", "seat_b", *r6("corr"), "lag_s")


# --- motion and nuisance filters ---------------------------------------------------


@query("vector_scaling", """, raw AS (SELECT 'a.mp4' AS video, event_id AS frame_no, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6::DOUBLE AS ts, event_id * 37 % 1300 AS dst_x, event_id * 53 % 740 AS dst_y, value AS motion_x, -value AS motion_y, CASE WHEN event_id % 7 > 0 THEN event_id % 5 END AS scale FROM events)
SELECT frame_no AS frame, CAST(floor(ts - 100) AS INT) AS bin, CAST(least(dst_y // 16, 44) AS INT) AS cy, CAST(least(dst_x // 16, 79) AS INT) AS cx, round(motion_x / greatest(coalesce(scale, 1), 1), 6) AS motion_x, round(motion_y / greatest(coalesce(scale, 1), 1), 6) AS motion_y FROM raw WHERE ts >= 100""")
def _(v):
    i = F.col("event_id")
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 1e6
    vectors = v.t("events").select(F.lit("a.mp4").alias("video"), i.alias("frame_no"), seconds.alias("ts"), (i * 37 % 1300).alias("dst_x"), (i * 53 % 740).alias("dst_y"), F.col("value").alias("motion_x"), (-F.col("value")).alias("motion_y"), F.when(i % 7 > 0, i % 5).alias("motion_scale"))
    videos = v.spark.range(1).select(F.lit("a.mp4").alias("video"), F.lit(1280).alias("width"), F.lit(720).alias("height"))
    return motion.scaled_vectors(vectors, videos, P, 100.0).select("frame", "bin", "cy", "cx", *r6("motion_x", "motion_y"))


@query("motion_scan", """SELECT event_id AS frame_no, round(epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00'), 6) AS ts, CASE WHEN event_id % 3 = 1 THEN 'P' ELSE 'B' END AS pict_type FROM events
  WHERE event_id % 3 > 0 AND epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00') >= 86400 AND epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00') < 864000""")
def _(v):
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 1e6
    kinds = F.get(F.array(F.lit("I"), F.lit("P"), F.lit("B")), (F.col("event_id") % 3).cast("int"))
    vectors = v.t("events").select(F.col("event_id").alias("frame_no"), seconds.alias("ts"), kinds.alias("pict_type"))
    return motion.scan_vectors(vectors, 86400.0, 864000.0).select("frame_no", *r6("ts"), "pict_type")


@query("stride_sample", "SELECT frame, count(*) AS vectors FROM v_motion WHERE frame IN (SELECT frame FROM (SELECT frame, row_number() OVER (ORDER BY frame) AS n FROM (SELECT DISTINCT frame FROM v_motion)) WHERE n % 7 = 0) GROUP BY frame", "v_motion")
def _(v):
    m = v.motion().withColumnRenamed("frame", "frame_no").withColumn("video", F.lit("events"))
    return motion.sample_stride(m, 7).groupBy(F.col("frame_no").alias("frame")).agg(F.count("*").alias("vectors"))


@query("frame_global_motion", f"SELECT frame, vectors, {s6('gmv_x', 'gmv_y')} FROM v_frame_motion", "v_frame_motion")
def _(v):
    return motion.global_motion(v.motion()).select("frame", "vectors", *r6("gmv_x", "gmv_y"))


@query("cell_bin_cube", f"SELECT bin, cy, cx, {s6('activity')}, hits FROM v_dense", "v_dense")
def _(v):
    return motion.dense_cube(v.sparse_cube(), 120, 10, 10).select("bin", "cy", "cx", *r6("activity"), "hits")


@query("bin_coverage", """SELECT bin, count(*) AS coverage, round(avg(x), 6) AS gmv_x, round(avg(y), 6) AS gmv_y
  FROM (SELECT bin, frame, quantile_cont(motion_x, 0.5) AS x, quantile_cont(motion_y, 0.5) AS y FROM v_motion GROUP BY bin, frame) GROUP BY bin""", "v_motion")
def _(v):
    return motion.bin_coverage(v.motion()).select("bin", "coverage", *r6("gmv_x", "gmv_y"))


@query("camera_motion", """, bins AS (SELECT frame % 3 AS video, bin, avg(x) AS x, avg(y) AS y FROM (SELECT bin, frame, quantile_cont(motion_x, 0.5) AS x, quantile_cont(motion_y, 0.5) AS y FROM v_motion GROUP BY bin, frame) GROUP BY ALL),
worst AS (SELECT video, max(greatest(abs(x), abs(y))) AS residual FROM bins GROUP BY video)
SELECT CAST(video AS INT) AS video, round(residual, 6) AS residual, residual > 0.5 AS moving, CASE WHEN residual > 0.5 THEN 'residual global motion up to ' || format('{:.2f}', residual) || ' px/frame after median subtraction: the camera may be moving' END AS note FROM worst""", "v_motion")
def _(v):
    m = v.motion().withColumn("video", (F.col("frame") % 3).cast("int"))
    return nuisance.camera_motion(motion.bin_coverage(m, VIDEO), keys=VIDEO).select("video", *r6("residual"), "moving", "note")


@query("container_probe", """SELECT o_orderkey AS video, CASE WHEN o_orderkey % 4 > 0 AND o_orderkey % 7 > 0 THEN o_orderkey % 7 * 10.0::DOUBLE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 * 12.5::DOUBLE ELSE 25.0::DOUBLE END AS fps,
  CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice WHEN o_orderkey % 2 > 0 THEN o_totalprice / 2 ELSE 0 END AS duration_s, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 11 END AS frames FROM orders""")
def _(v):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    raw = v.t("orders").select(k.alias("video"), F.when(k % 4 > 0, k % 7 * 10.0).alias("average_rate"), F.when(k % 3 > 0, k % 3 * 12.5).alias("base_rate"), F.when(k % 5 > 0, price).alias("container_s"), F.when(k % 2 > 0, price / 2).alias("stream_s"), (k % 11).alias("frames"))
    return readers.probed(raw)


@query("activity_heatmap", """, cells AS (SELECT cy, cx, avg(activity) AS activity FROM v_cube GROUP BY cy, cx)
SELECT cy, cx, round(activity, 6) AS activity, round((SELECT CASE WHEN quantile_cont(activity, 0.995) > 0 THEN quantile_cont(activity, 0.995) WHEN max(activity) > 0 THEN max(activity) ELSE 1 END FROM cells), 6) AS vmax FROM cells""", "v_cube")
def _(v):
    return motion.heatmap(v.kept("cube")).select("cy", "cx", *r6("activity", "vmax"))


@query("illumination_bins", "SELECT bin, round(hot_share, 6) AS hot_share, hot_share >= 0.60 AS gated FROM v_light", "v_light")
def _(v):
    return nuisance.illumination_bins(v.kept("cube")).select("bin", *r6("hot_share"), "gated")


@query("periodic_cells", f"SELECT cy, cx, {s6('prominence', 'frequency')}, periodic FROM v_periodic", "v_periodic")
def _(v):
    return nuisance.periodic_cells(v.kept("cube")).select("cy", "cx", *r6("prominence", "frequency"), "periodic")


@query("filtered_cube", """, zeroed AS (SELECT c.bin, c.cy, c.cx, CASE WHEN p.periodic THEN 0 ELSE c.activity END AS activity, l.hot_share >= 0.60 AS gated
  FROM v_cube c JOIN v_periodic p ON p.cy = c.cy AND p.cx = c.cx JOIN v_light l ON l.bin = c.bin),
fill AS (SELECT cy, cx, quantile_cont(activity, 0.5) AS f FROM zeroed WHERE NOT gated GROUP BY cy, cx)
SELECT bin, z.cy, z.cx, round(CASE WHEN gated THEN coalesce(f, 0) ELSE activity END, 6) AS activity FROM zeroed z LEFT JOIN fill f ON f.cy = z.cy AND f.cx = z.cx""", "v_periodic", "v_light")
def _(v):
    cube = v.kept("cube")
    return nuisance.apply_filters(cube, nuisance.periodic_cells(cube), nuisance.illumination_bins(cube)).select("bin", "cy", "cx", *r6("activity"))


@query("seat_cell_activity", """SELECT n_nationkey + 1 AS seat_id, bin, round(avg(activity), 6) AS activity FROM nation JOIN v_dense ON cy BETWEEN n_nationkey // 5 AND n_nationkey // 5 + 1 AND cx BETWEEN n_nationkey % 5 AND n_nationkey % 5 + 1 GROUP BY ALL""", "v_dense")
def _(v):
    n = F.col("n_nationkey")
    y, x = F.floor(n / 5).cast("int"), (n % 5).cast("int")
    cells = v.t("nation").select((n + 1).cast("int").alias("seat_id"), x.alias("x"), F.explode(F.sequence(y, y + 1)).alias("cy")).select("seat_id", "cy", F.explode(F.sequence(F.col("x"), F.col("x") + 1)).alias("cx"))
    return motion.seat_series(motion.dense_cube(v.sparse_cube(), 120, 10, 10), cells).select("seat_id", "bin", *r6("activity"))


# --- seats -------------------------------------------------------------------------


@query("seat_box_cells", "SELECT seat_id, y.i AS cy, x.i AS cx FROM v_seats JOIN range(45) y(i) ON y.i BETWEEN least(y0 // 16, 44) AND least(y1 // 16, 44) JOIN range(80) x(i) ON x.i BETWEEN least(x0 // 16, 79) AND least(x1 // 16, 79)", "v_seats")
def _(v):
    return seats.seat_cells(v.seats(), 45, 80)


@query("seat_adjacency", """, unit AS (SELECT sqrt(quantile_cont(x1 - x0, 0.5) ** 2 + quantile_cont(y1 - y0, 0.5) ** 2) AS u FROM v_seats),
pairs AS (SELECT a.seat_id AS a, b.seat_id AS b, sqrt(((a.x0 + a.x1) / 2.0 - (b.x0 + b.x1) / 2.0) ** 2 + ((a.y0 + a.y1) / 2.0 - (b.y0 + b.y1) / 2.0) ** 2) / u AS distance FROM v_seats a JOIN v_seats b ON a.seat_id < b.seat_id CROSS JOIN unit)
SELECT a, b, round(distance, 6) AS distance FROM pairs WHERE distance <= 1.8""", "v_seats")
def _(v):
    return seats.seat_edges(v.seats()).select("a", "b", *r6("distance"))


@query("neighbour_pairs", """, unit AS (SELECT sqrt(quantile_cont(x1 - x0, 0.5) ** 2 + quantile_cont(y1 - y0, 0.5) ** 2) AS u FROM v_seats)
SELECT DISTINCT least(a.seat_id, b.seat_id) AS seat_a, greatest(a.seat_id, b.seat_id) AS seat_b FROM v_seats a JOIN v_seats b ON a.seat_id != b.seat_id CROSS JOIN unit
WHERE sqrt(((a.x0 + a.x1) / 2.0 - (b.x0 + b.x1) / 2.0) ** 2 + ((a.y0 + a.y1) / 2.0 - (b.y0 + b.y1) / 2.0) ** 2) / u <= 1.8""", "v_seats")
def _(v):
    return seats.neighbour_pairs(seats.both_ways(seats.seat_edges(v.seats())))


@query("calibration_starts", f"""SELECT video, CAST(i AS INT) AS k, round(CASE WHEN n = 1 THEN 0 ELSE (duration_s - {P.calibration_s}) * i / (n - 1) END, 6) AS start_s
FROM (SELECT *, CASE WHEN duration_s <= 1.5 * {P.calibration_s} THEN 1 ELSE {P.seat_windows} END AS n FROM v_recordings) CROSS JOIN range({P.seat_windows}) r(i) WHERE i < n""", "v_recordings")
def _(v):
    return v.recordings().select("video", F.posexplode(seats.calibration_starts(F.col("duration_s"))).alias("k", "start_s")).select("video", "k", *r6("start_s"))


@query("seat_rows", """, placed AS (SELECT seat_id, (y0 + y1) / 2.0 + seat_id % 3 * 5 AS cy, (x0 + x1) / 2.0 AS cx FROM v_seats),
gaps AS (SELECT *, CASE WHEN abs(cy - lag(cy) OVER (ORDER BY cy, cx)) > 72 THEN 1 ELSE 0 END AS new FROM placed),
rows AS (SELECT *, CAST(sum(new) OVER (ORDER BY cy, cx ROWS UNBOUNDED PRECEDING) AS INT) AS row FROM gaps),
cols AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY cx, cy) - 1 AS col FROM rows)
SELECT seat_id, row, col, row_number() OVER (ORDER BY row, col) AS seat_number FROM cols""", "v_seats")
def _(v):
    shift = F.col("seat_id") % 3 * 5
    s = v.seats().withColumns({"y0": F.col("y0") + shift, "y1": F.col("y1") + shift})
    return seats.number_rows(s).select("seat_id", "row", "col", "seat_number")


def _clusters(v: Views) -> DataFrame:
    """Calibration windows of 48 frames, together all frames, over persons whose place is one of 20."""
    d = v.detections()
    k = F.col("track_id") * 2 + F.col("det_idx") % 2
    x0, y0 = k % 5 * 240 + F.col("det_idx") % 7 * 3, F.floor(k / 5) * 180 + F.col("frame") % 5 * 2
    d = d.select(F.floor(F.col("frame") / 48).cast("int").alias("window_id"), (F.col("frame") / 5.0).alias("t"), F.col("det_idx").cast("int").alias("det_idx"), "cls_id", F.lit(0.5).alias("conf"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 200.0).alias("x1"), (y0 + 120.0).alias("y1"))
    frames = v.spark.range(FRAMES).select(F.floor(F.col("id") / 48).cast("int").alias("window_id"), (F.col("id") / 5.0).alias("t"))
    return seats.number_rows(seats.seat_clusters(d, frames), keys=["window_id"])


def _boxes_sql(name: str, ranked: str, group: str, pick: str, more: tuple[str, ...] = ()) -> str:
    """The boxes of each group in order of k, a box a step: c holds the clusters' running means, own is the box's cluster.

    pick: the position of its cluster by v, its IoU with each; null founds one."""
    mean = ", ".join(f"{c} := (m.{c} * m.n + {c}) / (m.n + 1)" for c in ("x0", "y0", "x1", "y1", *more))
    first = f"struct_pack({', '.join(f'{c} := {c}' for c in ('x0', 'y0', 'x1', 'y1', *more))}, n := 1)"
    return f"""{name} AS (
  SELECT {group}, k, [{first}] AS c, 1 AS own FROM {ranked} WHERE k = 1
  UNION ALL
  SELECT {group}, k, CASE WHEN top IS NULL THEN list_append(c, {first}) ELSE list_transform(c, lambda m, i: CASE WHEN i = top THEN struct_pack({mean}, n := m.n + 1) ELSE m END) END, CAST(coalesce(top, len(c) + 1) AS INT)
  FROM (SELECT *, {pick} AS top FROM (SELECT r.*, w.c, list_transform(w.c, lambda m: {iou_sql('m', 'r')}) AS v FROM {name} w JOIN {ranked} r ON r.{group} = w.{group} AND r.k = w.k + 1)))"""


def _rows_sql(source: str, group: str) -> str:
    """source with row, col and seat_number within each group."""
    return f"""(SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY row, col) AS seat_number FROM
  (SELECT *, row_number() OVER (PARTITION BY {group}, row ORDER BY cx, cy) - 1 AS col FROM
  (SELECT *, CAST(sum(new) OVER (PARTITION BY {group} ORDER BY cy, cx ROWS UNBOUNDED PRECEDING) AS INT) AS row FROM
  (SELECT *, CASE WHEN abs(cy - lag(cy) OVER (PARTITION BY {group} ORDER BY cy, cx)) > high * 0.6::DOUBLE THEN 1 ELSE 0 END AS new FROM
  (SELECT *, (y0 + y1) / 2 AS cy, (x0 + x1) / 2 AS cx, quantile_cont(y1 - y0, 0.5) OVER (PARTITION BY {group}) AS high FROM {source})))))"""


_SEATS = f"""RECURSIVE persons AS (SELECT window_id, t, x0, y0, x0 + 200 AS x1, y0 + 120 AS y1, row_number() OVER (PARTITION BY window_id ORDER BY frame, det_idx) AS k FROM
  (SELECT frame, det_idx, CAST(frame // 48 AS INT) AS window_id, frame / 5.0::DOUBLE AS t, CAST((track_id * 2 + det_idx % 2) % 5 * 240 + det_idx % 7 * 3 AS DOUBLE) AS x0,
    CAST((track_id * 2 + det_idx % 2) // 5 * 180 + frame % 5 * 2 AS DOUBLE) AS y0 FROM v_detections WHERE cls_id = 0)),
{_boxes_sql('walk', 'persons', 'window_id', "CASE WHEN list_max(v) >= 0.35::DOUBLE THEN list_position(v, list_max(v)) END")},
ends AS (SELECT window_id, arg_max(c, k) AS c FROM walk GROUP BY window_id),
places AS (SELECT window_id, i AS own, c[i].x0 AS x0, c[i].y0 AS y0, c[i].x1 AS x1, c[i].y1 AS y1 FROM ends, LATERAL (SELECT unnest(range(1, len(c) + 1)) AS i)),
seen AS (SELECT w.window_id, w.own, count(DISTINCT p.t) / 48.0::DOUBLE AS occupancy FROM walk w JOIN persons p ON p.window_id = w.window_id AND p.k = w.k GROUP BY ALL),
busy AS (SELECT p.*, s.occupancy FROM places p JOIN seen s ON s.window_id = p.window_id AND s.own = p.own WHERE s.occupancy >= 0.45::DOUBLE),
found AS {_rows_sql('busy', 'window_id')}"""


@query("seat_discovery", f"{_SEATS} SELECT window_id, seat_number, row, col, {s6('x0', 'y0', 'x1', 'y1', 'occupancy')} FROM found", "v_detections")
def _(v):
    return _clusters(v).select("window_id", "seat_number", "row", "col", *r6("x0", "y0", "x1", "y1", "occupancy"))


@query("seat_merge", f"""{_SEATS},
whole AS (SELECT 0 AS lot, window_id, trunc(x0) AS x0, trunc(y0) AS y0, trunc(x1) AS x1, trunc(y1) AS y1, row_number() OVER (ORDER BY window_id, row, col) AS k FROM found),
{_boxes_sql('meet', 'whole', 'lot', "list_position(list_transform(v, lambda x: x >= 0.4::DOUBLE), true)")},
last AS (SELECT c FROM meet ORDER BY k DESC LIMIT 1),
merged AS (SELECT 0 AS lot, i AS own, c[i].x0 AS x0, c[i].y0 AS y0, c[i].x1 AS x1, c[i].y1 AS y1 FROM last, LATERAL (SELECT unnest(range(1, len(c) + 1)) AS i)),
spread AS (SELECT m.own, count(DISTINCT w.window_id) AS windows FROM meet m JOIN whole w ON w.k = m.k GROUP BY m.own)
SELECT seat_number, row, col, {s6('x0', 'y0', 'x1', 'y1')}, windows FROM {_rows_sql('merged', 'lot')} r JOIN spread s ON s.own = r.own""", "v_detections")
def _(v):
    return seats.number_rows(seats.merge_windows(_clusters(v))).select("seat_number", "row", "col", *r6("x0", "y0", "x1", "y1"), "windows")


_CALIBRATION = f"""RECURSIVE persons AS (SELECT s.window_id, s.sample, s.t, p.x0, p.y0, p.x0 + 200 AS x1, p.y0 + 120 AS y1, row_number() OVER (PARTITION BY s.window_id ORDER BY s.sample, p.det_idx) AS k FROM v_c_samples s JOIN
  (SELECT window_id // 18 AS video, det_idx, frame * 2.5::DOUBLE + frame % 3 * 0.1::DOUBLE AS t, CAST((track_id * 2 + det_idx % 2) % 5 * 240 + det_idx % 7 * 3 + 4 * (window_id // 18) AS DOUBLE) AS x0,
    CAST((track_id * 2 + det_idx % 2) // 5 * 180 + frame % 5 * 2 AS DOUBLE) AS y0 FROM v_window_detections WHERE cls_id = 0) p ON p.video = s.video AND p.t = s.t),
{_boxes_sql('walk', 'persons', 'window_id', "CASE WHEN list_max(v) >= 0.35::DOUBLE THEN list_position(v, list_max(v)) END")},
ends AS (SELECT window_id, arg_max(c, k) AS c FROM walk GROUP BY window_id),
places AS (SELECT window_id, i AS own, c[i].x0 AS x0, c[i].y0 AS y0, c[i].x1 AS x1, c[i].y1 AS y1 FROM ends, LATERAL (SELECT unnest(range(1, len(c) + 1)) AS i)),
seen AS (SELECT w.window_id, w.own, count(DISTINCT p.t) / any_value(n)::DOUBLE AS occupancy FROM walk w JOIN persons p ON p.window_id = w.window_id AND p.k = w.k JOIN (SELECT window_id, count(*) AS n FROM v_c_samples GROUP BY window_id) c ON c.window_id = w.window_id GROUP BY w.window_id, w.own),
busy AS (SELECT p.* FROM places p JOIN seen s ON s.window_id = p.window_id AND s.own = p.own WHERE s.occupancy >= 0.45::DOUBLE),
found AS {_rows_sql('busy', 'window_id')},
warm AS (SELECT f.window_id, f.own, avg(coalesce(e.energy, 0)) AS energy FROM found f JOIN range(12) y(i) ON y.i BETWEEN least(greatest(floor(y0 / 64), 0), 11) AND least(greatest(floor(y1 / 64), 0), 11)
  JOIN range(20) x(i) ON x.i BETWEEN least(greatest(floor(x0 / 64), 0), 19) AND least(greatest(floor(x1 / 64), 0), 19) LEFT JOIN v_c_energy e ON e.video = f.window_id // 6 AND e.cy = y.i AND e.cx = x.i GROUP BY f.window_id, f.own),
whole AS (SELECT f.window_id // 6 AS lot, f.window_id, trunc(x0) AS x0, trunc(y0) AS y0, trunc(x1) AS x1, trunc(y1) AS y1, energy, row_number() OVER (PARTITION BY f.window_id // 6 ORDER BY f.window_id, row, col) AS k FROM found f JOIN warm w ON w.window_id = f.window_id AND w.own = f.own),
{_boxes_sql('meet', 'whole', 'lot', "list_position(list_transform(v, lambda x: x >= 0.4::DOUBLE), true)", ("energy",))},
last AS (SELECT lot, arg_max(c, k) AS c FROM meet GROUP BY lot),
merged AS (SELECT lot, i AS own, c[i].x0 AS x0, c[i].y0 AS y0, c[i].x1 AS x1, c[i].y1 AS y1, c[i].energy AS energy FROM last, LATERAL (SELECT unnest(range(1, len(c) + 1)) AS i)),
spread AS (SELECT m.lot, m.own, count(DISTINCT w.window_id) AS windows FROM meet m JOIN whole w ON w.lot = m.lot AND w.k = m.k GROUP BY ALL)"""


@query("seat_calibration", f"""{_CALIBRATION} SELECT CAST(r.lot AS INT) AS video, seat_number, row, col, CAST(trunc(x0) AS INT) AS x0, CAST(trunc(y0) AS INT) AS y0, CAST(trunc(x1) AS INT) AS x1, CAST(trunc(y1) AS INT) AS y1, {s6('energy')}, windows
FROM {_rows_sql('merged', 'lot')} r JOIN spread s ON s.lot = r.lot AND s.own = r.own""", "v_window_detections", "v_c_samples", "v_c_energy")
def _(v):
    """Six windows of 48 sampled frames in each of three recordings, their seats merged with boxes and energies."""
    from dataclasses import replace

    found = calibration.calibrate_seats(*v.calibration(), 12, 20, VIDEO, replace(P, cell_px=64))
    return found.select("video", "seat_number", "row", "col", "x0", "y0", "x1", "y1", *r6("energy"), "windows")


@query("motion_seats")
def _(v):
    """Seats of three recordings from motion alone."""
    found = motion_seats.seats_from_motion(v.seat_motion(), 24, 20, keys=VIDEO)
    return found.select("video", "seat_number", "row", "col", "x0", "y0", "x1", "y1", *r6("cy", "cx", "energy"), "pitch_h", "pitch_w", F.size("cells").alias("n_cells"))


# --- detections --------------------------------------------------------------------


@query("asof_frame_sample", """, targets AS (SELECT i AS sample, i * 2592000.0::DOUBLE / 720 AS target FROM range(720) r(i)),
times AS (SELECT DISTINCT (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6::DOUBLE AS t FROM events)
SELECT sample, round(target, 6) AS target, round(min(t), 6) AS t FROM targets JOIN times ON t >= target - 1e-6 GROUP BY sample, target""")
def _(v):
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 1e6
    frames = v.t("events").select(F.lit("events").alias("video"), t.alias("t")).distinct()
    targets = v.spark.range(1).select(F.lit("events").alias("video"), F.posexplode(detections.sample_targets(F.lit(0.0), F.lit(2592000.0), F.lit(720))).alias("sample", "target"))
    return detections.first_frames_after(targets, frames, ["video"]).select("sample", *r6("target", "t"))


@query("sweep_plan", "SELECT video, CAST(least(greatest(floor(duration_s / greatest(5, duration_s / 720)), 1), 720) AS INT) AS samples FROM v_recordings", "v_recordings")
def _(v):
    return v.recordings().select("video", detections.sweep_samples(F.col("duration_s")).alias("samples"))


@query("frame_thinning", """RECURSIVE frames AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY t) AS n, t FROM (SELECT DISTINCT event_type, CAST(event_id AS DOUBLE) / 10 AS t FROM events)),
kept AS (
  SELECT event_type, n, t, t + 0.5::DOUBLE AS due, true AS keep FROM frames WHERE n = 1
  UNION ALL
  SELECT f.event_type, f.n, f.t, CASE WHEN f.t >= k.due THEN f.t + 0.5::DOUBLE ELSE k.due END, f.t >= k.due FROM kept k JOIN frames f ON f.event_type = k.event_type AND f.n = k.n + 1)
SELECT event_type, round(t, 6) AS t FROM kept WHERE keep""")
def _(v):
    frames = v.t("events").select("event_type", (F.col("event_id").cast("double") / 10).alias("t")).distinct()
    return detections.thin_frames(frames, 2.0, ["event_type"]).select("event_type", *r6("t"))


def _nms_sql(source: str) -> str:
    """The greedy walk over each frame and class, a box a step; kept is what stays."""
    one = "struct_pack(det_idx := r.det_idx, conf := r.conf, x0 := r.x0, y0 := r.y0, x1 := r.x1, y1 := r.y1)"
    return f"""RECURSIVE ranked AS (SELECT *, row_number() OVER (PARTITION BY frame, cls_id ORDER BY conf DESC, det_idx) AS k FROM {source}),
walk AS (
  SELECT r.frame, r.cls_id, r.k, [{one}] AS kept FROM ranked r WHERE k = 1
  UNION ALL
  SELECT r.frame, r.cls_id, r.k, CASE WHEN len(list_filter(w.kept, lambda b: {iou_sql('b', 'r')} > 0.6)) > 0 THEN w.kept ELSE list_append(w.kept, {one}) END
  FROM walk w JOIN ranked r ON r.frame = w.frame AND r.cls_id = w.cls_id AND r.k = w.k + 1),
ends AS (SELECT frame, cls_id, max(k) AS k FROM ranked GROUP BY frame, cls_id),
stay AS (SELECT w.frame, w.cls_id, unnest(kept) AS b FROM walk w JOIN ends e ON e.frame = w.frame AND e.cls_id = w.cls_id AND e.k = w.k)"""


@query("nms", f"{_nms_sql('v_detections')} SELECT frame, b.det_idx AS det_idx, cls_id, round(b.conf, 6) AS conf FROM stay", "v_detections")
def _(v):
    return detections.suppress(v.detections()).select("frame", "det_idx", "cls_id", *r6("conf"))


_SCALES = """(SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY scale, det_idx) AS det_idx, cls_id, conf, x0, y0, x1, y1 FROM
  (SELECT frame, det_idx, cls_id, conf, x0, y0, x1, y1, 0 AS scale FROM v_detections UNION ALL SELECT frame, det_idx, cls_id, conf * 0.9::DOUBLE, x0 + 4, y0, x1 + 4, y1, 1 FROM v_detections WHERE det_idx % 3 = 0))"""


@query("multi_scale_merge", f"{_nms_sql(_SCALES)} SELECT frame, b.det_idx AS det_idx, cls_id, round(b.conf, 6) AS conf, round(b.x0, 6) AS x0 FROM stay", "v_detections")
def _(v):
    d = v.detections()
    shifted = d.where(F.col("det_idx") % 3 == 0).withColumns({"x0": F.col("x0") + 4, "x1": F.col("x1") + 4, "conf": F.col("conf") * 0.9})
    return detections.merge_scales([d, shifted]).select("frame", "det_idx", "cls_id", *r6("conf", "x0"))


def _rois(v: Views) -> DataFrame:
    return review.window_roi(v.window_seats().withColumns({"width": F.lit(1280), "height": F.lit(720)}), keys=WINDOW)


_ROI = """rois AS (SELECT window_id, CAST(trunc(greatest(0, (min(x0) + max(x1)) / 2 - (max(x1) - min(x0)) * 0.8::DOUBLE)) AS INT) AS x0, CAST(trunc(greatest(0, (min(y0) + max(y1)) / 2 - (max(y1) - min(y0)) * 0.8::DOUBLE)) AS INT) AS y0,
  CAST(trunc(least(1280, (min(x0) + max(x1)) / 2 + (max(x1) - min(x0)) * 0.8::DOUBLE)) AS INT) AS x1, CAST(trunc(least(720, (min(y0) + max(y1)) / 2 + (max(y1) - min(y0)) * 0.8::DOUBLE)) AS INT) AS y1 FROM v_window_seats GROUP BY window_id)"""


@query("crop_detections", f""", {_ROI}, sizes AS (SELECT *, least(greatest(round_even(greatest(x1 - x0, y1 - y0) / 32.0::DOUBLE, 0) * 32, 160), 1600) AS own FROM rois)
SELECT {of('d.')}, frame, det_idx, d.x0 + r.x0 AS x0, d.y0 + r.y0 AS y0, d.x1 + r.x0 AS x1, d.y1 + r.y0 AS y1, '640,1280' || CASE WHEN own IN (640, 1280) THEN '' ELSE ',' || CAST(own AS INT) END AS sizes
FROM v_window_detections d JOIN sizes r ON r.window_id = d.window_id WHERE (cls_id = 67 AND conf >= 0.20::DOUBLE) OR (cls_id = 73 AND conf >= 0.12::DOUBLE)""", "v_window_detections", "v_window_seats")
def _(v):
    """Small objects found in a window's crop, in the frame's pixels, and the sizes its crop is searched at."""
    rois = _rois(v)
    found = detections.to_frame(detections.scan_detections(v.window_detections(), {PHONE: P.phone_conf, BOOK: P.book_conf}), rois, WINDOW)
    sizes = rois.select(*WINDOW, F.array_join(F.transform(detections.detection_sizes(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), lambda s: s.cast("string")), ",").alias("sizes"))
    return found.join(sizes, WINDOW).select(*WINDOW, "frame", "det_idx", "x0", "y0", "x1", "y1", "sizes")


@query("perceive_union", f"""SELECT {of()}, round(t, 4) AS t, count(*) FILTER (WHERE cls_id = 0) AS persons, count(*) FILTER (WHERE cls_id <> 0) AS objects FROM v_window_detections WHERE cls_id = 0 OR conf >= 0.12 GROUP BY v_window_detections.window_id, t""", "v_window_detections")
def _(v):
    d = v.window_detections()
    both = detections.perceive(d.where(F.col("cls_id") == PERSON), d.where((F.col("cls_id") != PERSON) & (F.col("conf") >= P.book_conf)).drop("track_id"), WINDOW)
    return both.groupBy(*WINDOW, "t").agg(F.count(F.when(F.col("cls_id") == PERSON, 1)).alias("persons"), F.count(F.when(F.col("cls_id") != PERSON, 1)).alias("objects"))


@query("det_to_seat", f"SELECT {of()}, frame, det_idx, seat_id, how FROM v_assigned", "v_assigned")
def _(v):
    return _assigned(v).select(*WINDOW, "frame", "det_idx", "seat_id", "how")


_STORED = f"""spans AS (SELECT DISTINCT window_id, seat_id FROM v_windows),
seen AS (SELECT window_id, count(*) AS n, max(round(conf, 4)) AS best, sum(round(x0, 1)) AS place, count(DISTINCT t) AS filled FROM v_window_detections WHERE window_id // 18 <> 1 OR cls_id = 67 GROUP BY window_id)
SELECT {of('w.')}, w.seat_id, 40 AS n_frames, coalesce(filled, 0) AS filled, coalesce(n, 0) AS detections, round(best, 4) AS best, round(place, 1) AS place FROM spans w LEFT JOIN seen s ON s.window_id = w.window_id"""


@query("evidence_store", f", {_STORED}", "v_windows", "v_window_detections")
def _(v):
    """Evidence of all windows is written, that of one recording again (phones only), and every window looked up."""
    folder = sinks.scratch(v.spark)
    w = v.kept("windows").select(*WINDOW, "seat_id", (F.col("window_id") * 8.0).alias("start_sec"), (F.col("window_id") * 8.0 + 8).alias("end_sec"))
    frames, seen = v.window_frames(), v.window_detections()
    evidence.store_evidence(w, frames, seen, folder, WINDOW)
    evidence.store_evidence(w.where("video = 1"), frames, seen.where(F.col("cls_id") == PHONE), folder, WINDOW)
    found = evidence.stored_evidence(v.spark, folder, w).withColumn("video", F.col("video").cast("int"))
    by_frame = found.groupBy(*WINDOW, "frame").agg(F.count("detection").alias("n"), F.max("detection.conf").alias("best"), F.sum("detection.x0").alias("place"))
    count = lambda c: F.count(F.when(c, 1)).cast("int")
    n = by_frame.groupBy(*WINDOW).agg(count(F.col("frame").isNotNull()).alias("n_frames"), count(F.col("n") > 0).alias("filled"), F.sum("n").cast("int").alias("detections"), F.round(F.max("best"), 4).alias("best"), F.round(F.sum("place"), 1).alias("place"))
    return w.select(*WINDOW, "seat_id").join(n, WINDOW, "left")


@query("persons_tracked", f"SELECT {of('w.')}, count(DISTINCT d.track_id) AS n_persons FROM v_windows w LEFT JOIN v_window_detections d ON d.window_id = w.window_id AND d.cls_id = 0 GROUP BY w.window_id", "v_windows", "v_window_detections")
def _(v):
    return detections.persons_tracked(v.windows().select(*WINDOW), v.window_detections(), WINDOW)


@query("fixture_input", f"SELECT frame, det_idx, cls_id, t, NULL::INT AS video, NULL::INT AS window_id FROM v_sweep UNION ALL SELECT frame, det_idx, cls_id, t, {of()} FROM v_window_detections", "v_sweep", "v_window_detections")
def _(v):
    return detections.all_frames(v.sweep(), v.window_detections()).select("frame", "det_idx", "cls_id", "t", *WINDOW)


@query("sweep_to_seat", "SELECT frame, det_idx, seat_id FROM v_sweep_assigned", "v_sweep_assigned")
def _(v):
    return detections.assign_sweep(v.sweep(), v.seats()).select("frame", "det_idx", "seat_id")


@query("unseated_counts", f""", loose AS (SELECT d.* FROM v_sweep d WHERE cls_id = 0 AND NOT EXISTS (SELECT 1 FROM v_seats s WHERE {iou_sql('d', 's')} >= 0.25)),
g AS (SELECT frame, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM loose GROUP BY frame)
SELECT t.frame, coalesce(n, 0) AS n, x0, y0, x1, y1 FROM v_times t LEFT JOIN g ON g.frame = t.frame""", "v_sweep", "v_seats", "v_times")
def _(v):
    return detections.unseated_counts(v.sweep_times(), v.sweep(), v.seats()).select("frame", "n", "x0", "y0", "x1", "y1")


_CROWD = f""", loose AS (SELECT d.frame, count(*) AS n FROM v_sweep d WHERE cls_id = 0 AND NOT EXISTS (SELECT 1 FROM v_seats s WHERE {iou_sql('d', 's')} >= 0.25) GROUP BY d.frame),
hot AS (SELECT frame, frame * 5.0::DOUBLE AS t, n, frame - row_number() OVER (ORDER BY frame) AS run FROM loose WHERE n >= 4),
runs AS (SELECT min(t) AS start_sec, max(t) AS end_sec, max(n) AS peak, avg(n) AS mean FROM hot GROUP BY run HAVING max(t) - min(t) >= 5)"""


@query("crowd_events", f"{_CROWD} SELECT start_sec, end_sec, peak, round(mean, 6) AS mean, round(least(greatest(0.5::DOUBLE * least(1, (end_sec - start_sec) / 15) + 0.5::DOUBLE * least(1, (mean - 3) / 4), 0.05), 0.97), 6) AS confidence FROM runs", "v_sweep", "v_seats")
def _(v):
    counts = detections.unseated_counts(v.sweep_times(), v.sweep(), v.seats())
    return rules.crowds(counts).select("start_sec", "end_sec", "peak", *r6("mean", "confidence"))


def _still(v: Views) -> tuple[DataFrame, DataFrame]:
    """Phones of all frames, half of them at one of four fixed places."""
    d = v.window_detections().where(F.col("cls_id") == PHONE)
    k = F.col("det_idx") % 8
    fixed = k < 4
    x0 = F.when(fixed, k * 100.0 + F.col("frame") % 3).otherwise(F.col("x0"))
    y0 = F.when(fixed, F.lit(600.0)).otherwise(F.col("y0"))
    d = d.withColumns({"x1": x0 + 40, "y1": y0 + 40, "x0": x0, "y0": y0})
    return d, v.window_frames().select("video", "t")


@query("fixture_map")
def _(v):
    return detections.fixture_map(*_still(v), keys=VIDEO).select("video", "cls_id", *r6("x0", "y0", "x1", "y1"), "n", *r6("presence", "span_s", "drift"))


@query("fixture_map_blocks")
def _(v):
    """The same from blocks of half a minute."""
    return detections.fixture_map(*_still(v), keys=VIDEO, block_s=30.0).select("video", "cls_id", *r6("x0", "y0", "x1", "y1"), "n", *r6("presence", "span_s", "drift"))


@query("drop_fixtures", f"SELECT frame, det_idx FROM v_detections d WHERE NOT EXISTS (SELECT 1 FROM v_seats s WHERE d.cls_id = CASE WHEN s.seat_id % 2 = 0 THEN 67 ELSE 73 END AND {iou_sql('d', 's')} >= 0.30)", "v_detections", "v_seats")
def _(v):
    fixtures = v.seats().withColumn("cls_id", F.when(F.col("seat_id") % 2 == 0, 67).otherwise(73))
    return detections.drop_fixtures(v.detections(), fixtures).select("frame", "det_idx")


@query("centroid_links", f"""RECURSIVE {_ROI},
boxes AS (SELECT d.window_id, d.cls_id, frame, det_idx, (d.x0 + d.x1) / 2 AS cx, (d.y0 + d.y1) / 2 AS cy, greatest(16, 0.25::DOUBLE * (r.x1 - r.x0)) AS reach, CASE d.cls_id WHEN 73 THEN 20000 ELSE 30000 END AS start,
  row_number() OVER (PARTITION BY d.window_id, d.cls_id ORDER BY frame, det_idx) AS k FROM v_window_detections d JOIN rois r ON r.window_id = d.window_id WHERE cls_id IN (67, 73)),
walk AS (
  SELECT window_id, cls_id, frame, det_idx, k, [struct_pack(x := cx, y := cy, id := start)] AS now, list_filter([struct_pack(x := cx, y := cy, id := start)], lambda b: false) AS free, start + 1 AS fresh, start AS track_id FROM boxes WHERE k = 1
  UNION ALL
  SELECT window_id, cls_id, frame, det_idx, k, list_append(CASE WHEN same THEN now ELSE list_filter(now, lambda b: false) END, struct_pack(x := cx, y := cy, id := coalesce(own, fresh))), list_filter(free, lambda b: own IS NULL OR b.id <> own),
    CASE WHEN own IS NULL THEN fresh + 1 ELSE fresh END, coalesce(own, fresh)
  FROM (SELECT *, CASE WHEN list_min(far) < reach THEN free[list_position(far, list_min(far))].id END AS own FROM
    (SELECT *, list_transform(free, lambda b: sqrt((cx - b.x) ** 2 + (cy - b.y) ** 2)) AS far FROM
    (SELECT b.*, w.now, w.fresh, w.frame = b.frame AS same, CASE WHEN w.frame = b.frame THEN w.free ELSE w.now END AS free FROM walk w JOIN boxes b ON b.window_id = w.window_id AND b.cls_id = w.cls_id AND b.k = w.k + 1))))
SELECT {of()}, cls_id, frame, det_idx, track_id FROM walk""", "v_window_detections", "v_window_seats")
def _(v):
    """Phones and papers, as far as a quarter of the window's region is wide."""
    return detections.link_objects(v.window_detections().drop("track_id"), _rois(v), keys=WINDOW).select(*WINDOW, "cls_id", "frame", "det_idx", "track_id")


@query("track_displacement", f"SELECT {of()}, track_id, n, {s6('displacement')} FROM v_moved", "v_moved")
def _(v):
    return detections.displacement(v.tracks(), keys=WINDOW).select(*WINDOW, "track_id", "n", *r6("displacement"))


@query("person_roles", f"SELECT {of('t.')}, t.track_id, CASE WHEN displacement >= 0.5 THEN 'staff' ELSE 'student' END AS role FROM (SELECT DISTINCT window_id, track_id FROM v_tracks) t LEFT JOIN v_moved m ON m.window_id = t.window_id AND m.track_id = t.track_id", "v_moved")
def _(v):
    return detections.person_roles(v.tracks(), keys=WINDOW)


@query("box_interpolation", f""", samples AS (SELECT window_id, track_id, t, min((cx, cy)) AS b FROM (SELECT window_id, track_id, frame / 5.0::DOUBLE AS t, cx, cy FROM v_tracks) GROUP BY ALL),
spans AS (SELECT window_id, track_id, min(t) AS lo, max(t) AS hi FROM samples GROUP BY ALL),
targets AS (SELECT window_id, track_id, window_id % 18 * 8 + i * 0.25::DOUBLE AS t FROM (SELECT DISTINCT window_id, track_id FROM v_tracks) CROSS JOIN range(32) r(i)),
around AS (SELECT q.window_id, q.track_id, q.t, max(s.t) FILTER (WHERE s.t <= q.t) AS t0, min(s.t) FILTER (WHERE s.t >= q.t) AS t1,
  arg_max(s.b, s.t) FILTER (WHERE s.t <= q.t) AS b0, arg_min(s.b, s.t) FILTER (WHERE s.t >= q.t) AS b1 FROM targets q JOIN samples s ON s.window_id = q.window_id AND s.track_id = q.track_id GROUP BY ALL)
SELECT {of()}, track_id, t, round(CASE WHEN t0 IS NULL THEN b1[1] WHEN t1 IS NULL THEN b0[1] ELSE b0[1] + (t - t0) / greatest(t1 - t0, 1e-6) * (b1[1] - b0[1]) END, 6) AS cx,
  round(CASE WHEN t0 IS NULL THEN b1[2] WHEN t1 IS NULL THEN b0[2] ELSE b0[2] + (t - t0) / greatest(t1 - t0, 1e-6) * (b1[2] - b0[2]) END, 6) AS cy
FROM around WHERE (t0 IS NOT NULL AND t1 IS NOT NULL) OR t1 - t <= 0.3 OR t - t0 <= 0.3""", "v_tracks")
def _(v):
    keys = [*WINDOW, "track_id"]
    samples = v.tracks().withColumn("t", F.col("frame") / 5.0)
    targets = samples.select(*keys).distinct().select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("window_id") * 8 + i * 0.25)).alias("t"))
    return detections.interpolate(samples, targets, ["cx", "cy"], keys).select(*keys, "t", *r6("cx", "cy"))


@query("person_tracks")
def _(v):
    tracks = tracking.track_persons(v.walking_detections(), v.window_frames(), WINDOW)
    return tracks.where(F.col("cls_id") == PERSON).select(*WINDOW, "frame", "det_idx", "track_id")


# --- rules -------------------------------------------------------------------------


def _assigned(v: Views) -> DataFrame:
    return detections.assign_seats(v.window_detections(), v.window_seats(), WINDOW)


_PHONE = f""", phone_hits AS (SELECT * FROM v_assigned WHERE cls_id = 67 AND conf >= 0.20),
phone_seats AS (SELECT window_id, seat_id FROM phone_hits WHERE seat_id IS NOT NULL GROUP BY window_id, seat_id QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY count(*) DESC, min((t, det_idx))) = 1),
phone AS (SELECT h.window_id, {blend_sql('count(DISTINCT round(t, 3)) / greatest(any_value(n_frames), 1)::DOUBLE / 0.5::DOUBLE', 'avg(conf)')} AS confidence, any_value(coalesce(s.seat_id, w.seat_id)) AS evidence_seat,
  count(DISTINCT round(t, 3)) AS frames, avg(conf) AS strength FROM phone_hits h JOIN v_windows w ON w.window_id = h.window_id LEFT JOIN phone_seats s ON s.window_id = h.window_id GROUP BY h.window_id HAVING count(*) >= 3)"""
_PAPER = f""", book AS (SELECT * FROM v_assigned WHERE cls_id = 73 AND conf >= 0.12),
book_ends AS (SELECT window_id, track_id, count(*) AS n, arg_min(seat_id, (t, det_idx)) AS from_seat, arg_max(seat_id, (t, det_idx)) AS to_seat, avg(conf) AS strength FROM book WHERE seat_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
book_held AS (SELECT e.*, count(*) FILTER (WHERE b.seat_id = from_seat) AS n_a, count(*) FILTER (WHERE b.seat_id = to_seat) AS n_b FROM book_ends e JOIN book b ON b.window_id = e.window_id AND b.track_id = e.track_id
  WHERE from_seat <> to_seat AND EXISTS (SELECT 1 FROM v_edges x WHERE x.video = e.window_id // 18 AND x.a = from_seat AND x.b = to_seat) GROUP BY ALL),
book_scored AS (SELECT h.*, {blend_sql('(n_a + n_b) / 40.0::DOUBLE / 0.4::DOUBLE', 'strength')} * 0.85 AS confidence, (SELECT min((t, det_idx)) FROM book b WHERE b.window_id = h.window_id AND b.track_id = h.track_id) AS seen FROM book_held h),
paper AS (SELECT * FROM book_scored QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY round(confidence, 9) DESC, seen) = 1)"""
_TALK = f""", spans AS (SELECT w.window_id, w.seat_id AS seat_a, n.neighbour AS seat_b, n.ord, greatest(i0 - 2, 0) AS lo, least(i1 + 2, 720) AS hi, duration_s FROM v_windows w JOIN v_neighbours n ON n.window_id = w.window_id WHERE duration_s >= 4),
tsums AS (SELECT window_id, seat_a, seat_b, ord, duration_s, lag.i AS lag, count(*) AS n, sum(a.z) AS sx, sum(b.z) AS sy, sum(a.z * a.z) AS sxx, sum(b.z * b.z) AS syy, sum(a.z * b.z) AS sxy FROM spans CROSS JOIN range(-2, 3) lag(i)
  JOIN v_rz a ON a.video = window_id // 18 AND a.seat_id = seat_a AND a.bin >= lo AND a.bin < hi JOIN v_rz b ON b.video = a.video AND b.seat_id = seat_b AND b.bin = a.bin + lag.i AND b.bin >= lo AND b.bin < hi GROUP BY ALL),
tcorr AS (SELECT *, round(greatest(CASE WHEN n >= 3 AND sxx - sx * sx / n > 1e-12 AND syy - sy * sy / n > 1e-12 THEN (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) ELSE 0 END, 0), 9) AS corr FROM tsums),
tbest AS (SELECT * FROM tcorr QUALIFY row_number() OVER (PARTITION BY window_id, seat_b ORDER BY corr DESC, lag) = 1),
tpick AS (SELECT * FROM tbest QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY corr DESC, ord) = 1),
talk AS (SELECT window_id, {blend_sql('least(1, duration_s / 8)', 'corr')} * 0.8 AS confidence, seat_b AS neighbour, corr, CASE WHEN corr > 0 THEN CAST(lag AS DOUBLE) ELSE 0 END AS lag_s FROM tpick WHERE corr >= 0.35)"""
_TRANSIT = f""", wt AS (SELECT * FROM v_tracks),
loose_share AS (SELECT window_id, track_id, avg(CASE WHEN EXISTS (SELECT 1 FROM v_window_seats s WHERE s.window_id = wt.window_id AND wt.cx BETWEEN s.x0 AND s.x1 AND wt.cy BETWEEN s.y0 AND s.y1) THEN 0.0::DOUBLE ELSE 1 END) AS unseated FROM wt GROUP BY ALL),
crossing AS (SELECT m.window_id, m.track_id, m.n, m.displacement, l.unseated, least(0.22::DOUBLE, {blend_sql('least(1, m.n / 40.0::DOUBLE)', 'least(1, m.displacement / 1.0::DOUBLE)')} * 0.85) AS confidence
  FROM v_moved m JOIN loose_share l ON l.window_id = m.window_id AND l.track_id = m.track_id WHERE m.displacement >= 0.5),
transit AS (SELECT * FROM crossing QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY round(confidence, 9) DESC, track_id) = 1)"""


def _tracks(v: Views) -> DataFrame:
    """Window tracks with the seat whose box holds the centre."""
    t = v.tracks()
    s = v.window_seats()
    inside = (F.col("cx") >= F.col("x0")) & (F.col("cx") <= F.col("x1")) & (F.col("cy") >= F.col("y0")) & (F.col("cy") <= F.col("y1"))
    t = t.withColumn("_id", F.monotonically_increasing_id())
    return t.join(s, WINDOW, "left").groupBy(*t.columns).agg(F.min(F.when(inside, F.col("seat_id"))).alias("seat_id"))


@query("rule_phone", f"{_PHONE} SELECT {of()}, {s6('confidence')}, evidence_seat, frames, {s6('strength')} FROM phone", "v_assigned", "v_windows")
def _(v):
    return rules.phone(v.windows(), _assigned(v), keys=WINDOW).select(*WINDOW, *r6("confidence"), "evidence_seat", "frames", *r6("strength"))


@query("rule_paper", f"{_PAPER} SELECT {of()}, {s6('confidence')}, track_id, from_seat, to_seat, n_a, n_b FROM paper", "v_assigned", "v_edges")
def _(v):
    return rules.paper(v.windows(), _assigned(v).persist(), v.edges(), keys=WINDOW, recording=VIDEO).select(*WINDOW, *r6("confidence"), "track_id", "from_seat", "to_seat", "n_a", "n_b")


@query("rule_talking", f"{_TALK} SELECT {of()}, {s6('confidence')}, neighbour, {s6('corr')}, lag_s FROM talk", "v_windows", "v_neighbours")
def _(v):
    return rules.talking(v.kept("windows"), v.neighbours(), v.recorded_scores(), v.recorded_seats(), keys=WINDOW, recording=VIDEO).select(*WINDOW, *r6("confidence"), "neighbour", *r6("corr"), "lag_s")


@query("rule_transit", f"{_TRANSIT} SELECT {of()}, {s6('confidence')}, track_id, {s6('displacement', 'unseated')}, n FROM transit", "v_moved", "v_window_seats")
def _(v):
    return rules.transit(v.windows(), _tracks(v), keys=WINDOW).select(*WINDOW, *r6("confidence"), "track_id", *r6("displacement", "unseated"), "n")


_EXCHANGE = f""", obs AS (SELECT * FROM v_assigned WHERE cls_id = 0 AND track_id IS NOT NULL),
xseen AS (SELECT window_id, track_id, min((t, det_idx)) AS seen FROM obs GROUP BY ALL),
xspan AS (SELECT window_id, track_id, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM obs WHERE seat_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
xnear AS (SELECT o.*, s.n, s.t0, s.t1 FROM obs o JOIN xspan s ON s.window_id = o.window_id AND s.track_id = o.track_id WHERE o.seat_id IS NOT NULL),
xhead AS (SELECT window_id, track_id, seat_id AS begun FROM (SELECT window_id, track_id, seat_id, count(*) AS c, min((t, det_idx)) AS f FROM xnear WHERE t <= t0 + 3 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY window_id, track_id ORDER BY c DESC, f) = 1),
xtail AS (SELECT window_id, track_id, seat_id AS ended FROM (SELECT window_id, track_id, seat_id, count(*) AS c, min((t, det_idx)) AS f FROM xnear WHERE t >= t1 - 3 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY window_id, track_id ORDER BY c DESC, f) = 1),
xhold AS (SELECT x.window_id, x.track_id, avg(CASE WHEN x.seat_id = e.ended THEN 1.0::DOUBLE ELSE 0 END) AS hold FROM xnear x JOIN xtail e ON e.window_id = x.window_id AND e.track_id = x.track_id WHERE x.t >= x.t1 - 3 GROUP BY ALL),
xends AS (SELECT s.window_id, s.track_id, s.n, h.begun, e.ended, o.hold, f.seen FROM xspan s JOIN xhead h ON h.window_id = s.window_id AND h.track_id = s.track_id JOIN xtail e ON e.window_id = s.window_id AND e.track_id = s.track_id
  JOIN xhold o ON o.window_id = s.window_id AND o.track_id = s.track_id JOIN xseen f ON f.window_id = s.window_id AND f.track_id = s.track_id WHERE h.begun <> e.ended),
xpairs AS (SELECT a.window_id, a.track_id AS track_a, b.track_id AS track_b, a.begun AS seat_a, b.begun AS seat_b, a.seen AS seen_a, b.seen AS seen_b, {blend_sql('(a.n + b.n) / greatest(2 * n_frames, 1)::DOUBLE / 0.5::DOUBLE', '(a.hold + b.hold) / 2')} AS confidence
  FROM xends a JOIN xends b ON a.window_id = b.window_id AND a.begun = b.ended AND a.ended = b.begun AND a.seen < b.seen JOIN v_windows w ON w.window_id = a.window_id)"""


@query("rule_exchange", f"{_EXCHANGE} SELECT {of()}, {s6('confidence')}, track_a, track_b, seat_a, seat_b FROM xpairs QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY round(confidence, 9) DESC, seen_a, seen_b) = 1", "v_assigned", "v_windows")
def _(v):
    from dataclasses import replace

    return rules.exchange(v.windows(), _assigned(v).persist(), replace(P, exchange=True), WINDOW).select(*WINDOW, *r6("confidence"), "track_a", "track_b", "seat_a", "seat_b")


@query("classify_windows", f"""{_PHONE}{_PAPER}{_TALK}{_TRANSIT},
fired AS (SELECT window_id, 'mobile_phone_usage' AS label, 0 AS o, confidence FROM phone UNION ALL SELECT window_id, 'paper_pass', 1, confidence FROM paper UNION ALL SELECT window_id, 'talking_to_neighbour', 3, confidence FROM talk),
top AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY round(confidence, 9) DESC, o) AS k FROM fired),
picked AS (SELECT w.window_id, coalesce(CASE WHEN t.window_id IS NOT NULL THEN 'staff_or_transit' END, f.label, 'unclassified_anomaly') AS label,
  coalesce(t.confidence, f.confidence, least(greatest(w.mean_z / 40, 0.05), 0.20)) AS confidence, t.window_id IS NULL AND f.window_id IS NOT NULL AS ruled
  FROM v_windows w LEFT JOIN transit t ON t.window_id = w.window_id LEFT JOIN top f ON f.window_id = w.window_id AND f.k = 1)
SELECT {of()}, label, round(confidence, 6) AS confidence, CASE WHEN ruled THEN coalesce((SELECT string_agg(x.label, ',' ORDER BY x.label) FROM top x WHERE x.window_id = p.window_id AND x.k > 1), '') ELSE '' END AS also_matched FROM picked p""",
    "v_assigned", "v_windows", "v_edges", "v_neighbours", "v_moved", "v_window_seats")
def _(v):
    w, a, by = v.kept("windows"), _assigned(v).persist(), {"keys": WINDOW, "recording": VIDEO}
    talking = rules.talking(w, v.neighbours(), v.recorded_scores(), v.recorded_seats(), **by)
    found = {"mobile_phone_usage": rules.phone(w, a, keys=WINDOW), "paper_pass": rules.paper(w, a, v.edges(), **by), "talking_to_neighbour": talking, "staff_or_transit": rules.transit(w, _tracks(v), keys=WINDOW)}
    return rules.classify(w, found, keys=WINDOW).select(*WINDOW, "label", *r6("confidence"), F.array_join("also_matched", ",").alias("also_matched"))


@query("named_windows")
def _(v):
    """Both stages after triage: tracks and links are made here, then every rule, then one label a window."""
    from dataclasses import replace

    evidence = perception.window_evidence(v.walking_detections(), v.window_frames(), _rois(v), v.window_seats(), WINDOW)
    named = perception.name_windows(v.kept("windows"), evidence, v.neighbours(), v.edges(), v.recorded_scores(), v.recorded_seats(), WINDOW, VIDEO, replace(P, exchange=True))
    return named.select(*WINDOW, "label", *r6("confidence"), F.array_join("also_matched", ",").alias("also_matched"))


@query("persistent_object_events", f""", hits AS (SELECT CASE cls_id WHEN 67 THEN 'mobile_phone_usage' ELSE 'paper_pass_object_present' END AS action_label, seat_id, frame, t, max(conf) AS conf FROM v_sweep_assigned WHERE cls_id IN (67, 73) AND conf >= 0.12::DOUBLE GROUP BY ALL),
marked AS (SELECT *, CASE WHEN coalesce(frame - lag(frame) OVER (PARTITION BY action_label, seat_id ORDER BY frame), 99) > 2 THEN 1 ELSE 0 END AS new FROM hits),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY action_label, seat_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM marked),
runs AS (SELECT action_label, seat_id, min(t) AS start_sec, max(t) AS end_sec, max(frame) - min(frame) + 1 AS samples, count(*) AS hits, avg(conf) AS mean_conf FROM numbered GROUP BY action_label, seat_id, run)
SELECT action_label, seat_id, start_sec, end_sec, samples, hits, round(mean_conf, 6) AS mean_conf, round(least(greatest({blend_sql('hits / samples::DOUBLE', 'mean_conf')} * 0.9, 0.05), 0.9), 6) AS confidence FROM runs WHERE samples >= 3 AND hits / samples::DOUBLE >= 0.6""", "v_sweep_assigned")
def _(v):
    """Phones and papers at one seat of the sweep."""
    parts = max(int(v.spark.conf.get("spark.sql.shuffle.partitions")), v.sweep_frames() // rules.TASK_SAMPLES)
    return rules.sweep_events(v.sweep_times(), v.sweep(), v.seats(), parts=parts).select("action_label", "seat_id", "start_sec", "end_sec", "samples", "hits", *r6("mean_conf", "confidence"))


@query("sweep_dedupe", f"SELECT s.video, s.ord FROM v_manifest s WHERE s.ord % 4 = 0 AND NOT EXISTS (SELECT 1 FROM v_manifest e WHERE e.ord % 4 > 0 AND e.video = s.video AND e.seat_id = s.seat_id AND e.action_label = s.action_label AND {tiou_sql('s', 'e')} >= 0.3)", "v_manifest")
def _(v):
    m = v.manifest()
    return rules.drop_known(m.where("ord % 4 = 0"), m.where("ord % 4 > 0")).select("video", "ord")


@query("event_union", f"{_CROWD}, parts AS (SELECT video, CAST(seat_id AS VARCHAR) AS seat_id, start_sec FROM v_manifest UNION ALL SELECT NULL, NULL, start_sec FROM runs) SELECT video, seat_id, round(start_sec, 6) AS start_sec FROM parts", "v_sweep", "v_seats", "v_manifest")
def _(v):
    crowd = rules.crowds(detections.unseated_counts(v.sweep_times(), v.sweep(), v.seats()))
    stage1 = v.manifest().withColumn("seat_id", F.col("seat_id").cast("string"))
    return rules.all_events(stage1, crowd).select("video", "seat_id", *r6("start_sec"))


@query("trigger_specs", "SELECT DISTINCT action_label, CASE WHEN action_label = 'mobile_phone_usage' THEN 67 WHEN starts_with(action_label, 'paper_pass') THEN 73 WHEN action_label IN ('staff_or_transit', 'seat_exchange') THEN 0 END AS cls_id, CASE WHEN action_label = 'mobile_phone_usage' THEN false WHEN starts_with(action_label, 'paper_pass') OR action_label IN ('staff_or_transit', 'seat_exchange') THEN true END AS tracked FROM v_manifest", "v_manifest")
def _(v):
    t = v.manifest().select("action_label").distinct().withColumn("s", rules.trigger_spec(F.col("action_label")))
    return t.select("action_label", "s.cls_id", "s.tracked")


@query("overlay_tracks", f""", marked AS (SELECT window_id, ['mobile_phone_usage', 'paper_pass', 'staff_or_transit', 'talking_to_neighbour'][window_id % 18 % 4 + 1] AS action_label FROM v_windows)
SELECT {of('m.')}, m.action_label, CAST(d.track_id AS VARCHAR) AS track, count(*) AS n, min(d.t) AS first, max(d.t) AS last FROM marked m JOIN v_window_detections d ON d.window_id = m.window_id
WHERE (m.action_label = 'mobile_phone_usage' AND d.cls_id = 67) OR (m.action_label = 'paper_pass' AND d.cls_id = 73) OR (m.action_label = 'staff_or_transit' AND d.track_id IN (1, 4)) GROUP BY ALL""", "v_windows", "v_window_detections")
def _(v):
    label = F.get(F.array(*(F.lit(x) for x in ("mobile_phone_usage", "paper_pass", "staff_or_transit", "talking_to_neighbour"))), F.col("window_id") % 4)
    events = v.windows().select(*WINDOW, label.alias("action_label"), F.array(F.lit(1), F.lit(4)).alias("track_ids"))
    got = rules.collect_tracks(events, v.window_detections().withColumn("name", F.lit("object")), WINDOW)
    return got.select(*WINDOW, "action_label", "track", F.size("samples").cast("long").alias("n"), F.get("samples", 0)["t"].alias("first"), F.element_at("samples", -1)["t"].alias("last"))


@query("window_rois", f", {_ROI} SELECT {of()}, x0, y0, x1, y1 FROM rois", "v_window_seats")
def _(v):
    return _rois(v)


# --- evaluation --------------------------------------------------------------------


def _renamed(v: Views) -> DataFrame:
    """The manifest with the truth's names, by stem."""
    from ..functions.review import stem

    names = v.truth().select(F.col("video").alias("_n"), stem(F.col("video")).alias("_s")).distinct()
    m = v.manifest()
    return m.join(names, stem(F.col("video")) == F.col("_s")).withColumn("video", F.col("_n")).drop("_n", "_s")


def _named(v: Views) -> DataFrame:
    from ..functions.review import stem

    names = v.truth().select(F.col("video").alias("_n"), stem(F.col("video")).alias("_s")).distinct()
    return v.videos().join(names, stem(F.col("video")) == F.col("_s")).select(F.col("_n").alias("video"), "duration_s")


_EVAL = f""", ev AS (SELECT t.video, m.start_sec, m.end_sec FROM v_manifest m JOIN v_truth t ON split_part(t.video, '.', 1) = split_part(m.video, '.', 1)),
over AS (SELECT g.gt_id, g.video, max({tiou_sql('g', 'e')}) AS best FROM v_truth g LEFT JOIN ev e ON e.video = g.video WHERE g.start_sec IS NOT NULL GROUP BY ALL),
got AS (SELECT video, avg(CASE WHEN coalesce(best, 0) >= 0.1 THEN 1.0::DOUBLE ELSE 0 END) AS recall, avg(coalesce(best, 0)) AS mean_tiou, count(*) AS n_gt FROM over GROUP BY video),
fe AS (SELECT e.video, count(*) AS n_events, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM v_truth g WHERE g.video = e.video AND g.start_sec IS NOT NULL AND {tiou_sql('g', 'e')} >= 0.1)) AS n_false FROM ev e GROUP BY e.video),
rates AS (SELECT t.video, g.n_gt IS NOT NULL AS timed, coalesce(n_false, 0) AS n_false, coalesce(n_events, 0) AS n_events, nullif(d.duration_s, 0) / 3600 AS hours FROM v_truth t LEFT JOIN got g ON g.video = t.video LEFT JOIN fe ON fe.video = t.video
  LEFT JOIN v_videos d ON split_part(d.video, '.', 1) = split_part(t.video, '.', 1))"""


@query("recall_at_budget", f"{_EVAL} SELECT t.video, CASE WHEN n_gt IS NULL THEN 'unavailable' ELSE 'measured' END AS status, recall, coalesce(n_gt, 0) AS n_gt FROM v_truth t LEFT JOIN got ON got.video = t.video", "v_manifest", "v_truth", "v_videos")
def _(v):
    return evaluate.recall_at_budget(v.truth(), _renamed(v))


@query("mean_tiou", f"{_EVAL} SELECT t.video, CASE WHEN n_gt IS NULL THEN 'unavailable' ELSE 'measured' END AS status, round(mean_tiou, 6) AS mean_tiou, coalesce(n_gt, 0) AS n_gt FROM v_truth t LEFT JOIN got ON got.video = t.video", "v_manifest", "v_truth", "v_videos")
def _(v):
    return evaluate.mean_overlap(v.truth(), _renamed(v)).select("video", "status", *r6("mean_tiou"), "n_gt")


@query("false_events_per_hour", f"{_EVAL} SELECT video, CASE WHEN timed THEN 'measured' ELSE 'unavailable' END AS status, CASE WHEN timed THEN n_false END AS n_false, round(CASE WHEN timed THEN n_false / hours END, 6) AS false_events_per_hour, round(CASE WHEN NOT timed THEN n_events / hours END, 6) AS events_per_hour FROM rates", "v_manifest", "v_truth", "v_videos")
def _(v):
    return evaluate.false_events(v.truth(), _renamed(v), _named(v)).select("video", "status", "n_false", *r6("false_events_per_hour", "events_per_hour"))


@query("evaluate_all", f"{_EVAL} SELECT r.video, CASE WHEN timed THEN 'measured' ELSE 'unavailable' END AS status, recall, coalesce(n_gt, 0) AS n_gt, round(mean_tiou, 6) AS mean_tiou, CASE WHEN timed THEN n_false END AS n_false FROM rates r LEFT JOIN got ON got.video = r.video", "v_manifest", "v_truth", "v_videos")
def _(v):
    return evaluate.evaluate_all(v.truth(), _renamed(v), _named(v)).select("video", "status", "recall", "n_gt", *r6("mean_tiou"), "n_false")


_ACCURACY = """, top AS (SELECT video, action_label AS top_label FROM v_manifest QUALIFY row_number() OVER (PARTITION BY video ORDER BY confidence DESC, ord) = 1),
seen AS (SELECT video, count(*) AS n_events, string_agg(DISTINCT action_label, ',' ORDER BY action_label) AS labels_seen FROM v_manifest GROUP BY video),
acc AS (SELECT t.gt_id, t.video, t.label AS expected, CASE WHEN d.video IS NULL THEN 'not_run' ELSE 'scored' END AS status, top_label, CASE WHEN d.video IS NOT NULL THEN coalesce(n_events, 0) END AS n_events, labels_seen,
  CASE WHEN d.video IS NOT NULL THEN coalesce(top_label = t.label, false) END AS top_label_correct, CASE WHEN d.video IS NOT NULL THEN coalesce(list_contains(string_split(labels_seen, ','), t.label), false) END AS label_present
  FROM v_truth t LEFT JOIN v_videos d ON split_part(d.video, '.', 1) = split_part(t.video, '.', 1) LEFT JOIN top ON top.video = d.video LEFT JOIN seen ON seen.video = d.video)"""


@query("label_accuracy", f"{_ACCURACY} SELECT * FROM acc", "v_manifest", "v_truth", "v_videos")
def _(v):
    return evaluate.label_accuracy(v.truth(), v.manifest(), v.videos()).withColumn("labels_seen", F.array_join("labels_seen", ","))


@query("label_accuracy_summary", f"{_ACCURACY} SELECT CASE WHEN count(*) FILTER (WHERE status = 'scored') > 0 THEN 'measured' ELSE 'unavailable' END AS status, count(*) FILTER (WHERE status = 'scored') AS n_files_scored, avg(CAST(top_label_correct AS INT)) AS top_label_correct, avg(CAST(label_present AS INT)) AS label_present FROM acc", "v_manifest", "v_truth", "v_videos")
def _(v):
    return evaluate.accuracy_summary(evaluate.label_accuracy(v.truth(), v.manifest(), v.videos()))


# --- review ------------------------------------------------------------------------

_FINDING = "action_label NOT IN ('staff_or_transit', 'unclassified_anomaly')"
_PRIORITY = "CASE WHEN confidence >= 0.6 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END"
_TEXT = "CASE action_label " + " ".join(f"WHEN '{x}' THEN '{y}'" for x, y in LABEL_TEXT.items()) + " ELSE replace(action_label, '_', ' ') END"
_HMS = "lpad(CAST(CAST(floor({0}) AS BIGINT) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor({0}) AS BIGINT) // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor({0}) AS BIGINT) % 60 AS VARCHAR), 2, '0')"
_CAMERA = "upper(regexp_replace(video, '(?i)\\.(mp4|mkv|avi)$', ''))"
_HOURS = "CAST(CAST(floor(duration_s / 3600) AS BIGINT) AS VARCHAR) || 'h ' || lpad(CAST(CAST(floor((duration_s - floor(duration_s / 3600) * 3600) / 60 + 0.5) AS BIGINT) AS VARCHAR), 2, '0') || 'm'"


@query("api_events", "SELECT video, ord, action_label, round(confidence, 6) AS confidence FROM v_manifest WHERE action_label = 'paper_pass' AND confidence >= 0.3 ORDER BY v_manifest.confidence DESC, ord LIMIT 100", "v_manifest")
def _(v):
    return review.api_events(v.manifest(), label="paper_pass", min_confidence=0.3, limit=100).select("video", "ord", "action_label", *r6("confidence"))


@query("api_summary", """SELECT 'label' AS kind, action_label AS name, CAST(count(*) AS DOUBLE) AS n FROM v_manifest GROUP BY action_label UNION ALL SELECT 'video', video, CAST(count(*) AS DOUBLE) FROM v_manifest GROUP BY video
UNION ALL SELECT 'total', 'events', CAST(count(*) AS DOUBLE) FROM v_manifest UNION ALL SELECT 'total', 'footage_s', coalesce(sum(duration_s), 0) FROM v_videos""", "v_manifest", "v_videos")
def _(v):
    return review.api_summary(v.manifest(), v.videos())


@query("library_rollup", f"""SELECT d.video, {_CAMERA.replace('(video', '(d.video')} AS camera, duration_s, {_HOURS} AS length, count(m.ord) AS events, count(*) FILTER (WHERE {_FINDING}) AS findings,
  {', '.join(f"count(*) FILTER (WHERE {_FINDING} AND {_PRIORITY} = '{x}') AS {x}" for x in ('high', 'medium', 'low'))} FROM v_videos d LEFT JOIN v_manifest m ON m.video = d.video GROUP BY d.video, duration_s""", "v_manifest", "v_videos")
def _(v):
    return review.library_rollup(v.manifest(), v.videos())


@query("library_total", f"""SELECT count(DISTINCT d.video) AS recordings, (SELECT sum(duration_s) FROM v_videos) AS duration_s, count(m.ord) AS events, count(*) FILTER (WHERE {_FINDING}) AS findings,
  {', '.join(f"count(*) FILTER (WHERE {_FINDING} AND {_PRIORITY} = '{x}') AS {x}" for x in ('high', 'medium', 'low'))}, (SELECT {_HOURS} FROM (SELECT sum(duration_s) AS duration_s FROM v_videos)) AS length FROM v_videos d LEFT JOIN v_manifest m ON m.video = d.video""", "v_manifest", "v_videos")
def _(v):
    return review.library_total(review.library_rollup(v.manifest(), v.videos()))


@query("recording_stats", f"""SELECT d.video, split_part(d.video, '.mp4', 1) AS stem, duration_s, CAST(length(d.video) AS INT) AS n_seats, count(m.ord) AS events, count(*) FILTER (WHERE {_FINDING}) AS findings,
  {', '.join(f"count(*) FILTER (WHERE {_FINDING} AND {_PRIORITY} = '{x}') AS {x}" for x in ('high', 'medium', 'low'))} FROM v_videos d LEFT JOIN v_manifest m ON m.video = d.video WHERE d.video <> '3-MEDIUM.mp4' GROUP BY d.video, duration_s""", "v_manifest", "v_videos")
def _(v):
    stats = v.videos().withColumns({"n_seats": F.length("video"), "error": F.when(F.col("video") == "3-MEDIUM.mp4", "no frames")})
    return review.recording_stats(stats, v.manifest())


@query("label_facets", f"SELECT action_label, count(*) AS n, {_TEXT} AS text FROM v_manifest GROUP BY action_label", "v_manifest")
def _(v):
    return review.label_facets(v.manifest())


@query("review_counts", f"""SELECT count(*) AS events, count(*) FILTER (WHERE {_FINDING}) AS findings, count(*) FILTER (WHERE NOT {_FINDING}) AS set_aside,
  {', '.join(f"count(*) FILTER (WHERE {_FINDING} AND {_PRIORITY} = '{x}') AS {x}" for x in ('high', 'medium', 'low'))}, count(DISTINCT video) AS recordings FROM v_manifest""", "v_manifest")
def _(v):
    return review.review_counts(v.manifest())


@query("activity_histogram", """, span AS (SELECT video, CASE WHEN max(start_sec) > 0 THEN max(start_sec) ELSE 1 END AS s FROM v_manifest GROUP BY video),
n AS (SELECT m.video, CAST(least(59, floor(start_sec / s * 60)) AS INT) AS bucket, count(*) AS n FROM v_manifest m JOIN span ON span.video = m.video GROUP BY ALL)
SELECT span.video, CAST(b.i AS INT) AS bucket, coalesce(n, 0) AS n FROM span CROSS JOIN range(60) b(i) LEFT JOIN n ON n.video = span.video AND n.bucket = b.i""", "v_manifest")
def _(v):
    return review.activity_histogram(v.manifest())


@query("finding_markers", f"SELECT video, ord, action_label, round(start_sec / greatest(1, max(start_sec) OVER (PARTITION BY video)), 6) AS position FROM v_manifest WHERE {_FINDING}", "v_manifest")
def _(v):
    return review.finding_markers(v.manifest()).select("video", "ord", "action_label", *r6("position"))


@query("ui_projection", f"""SELECT format('EVT-{{:05d}}', row_number() OVER (ORDER BY confidence DESC, ord)) AS id, video, ord, {_CAMERA} AS camera, {_HMS.format('start_sec')} AS start, {_HMS.format('end_sec')} AS "end", {_TEXT} AS type,
  'Seat ' || seat_id AS place, {_PRIORITY} AS priority, CAST(CASE WHEN peak_z IS NULL THEN 0 ELSE least(100, floor(peak_z / 20 * 100 + 0.5)) END AS INT) AS activity FROM v_manifest""", "v_manifest")
def _(v):
    return review.ui_projection(v.manifest(), sinks.scratch(v.spark))


@query("event_search", f"SELECT video, ord FROM v_manifest WHERE contains({_HMS.format('start_sec')}, 'Phone') OR contains(lower('Seat ' || seat_id), 'phone') OR contains(lower({_TEXT}), 'phone') OR contains(coalesce(lower(regexp_replace(detector_class, '\\s*\\(COCO [0-9]+\\).*', '')), 'none'), 'phone') OR contains(lower(rule), 'phone')", "v_manifest")
def _(v):
    return review.event_search(v.manifest(), " Phone ").select("video", "ord")


_NEEDLES = [" Phone ", "seat 3", "RULE 4", "01:2", "to N", "ph", "\u00e9v\u00e9", "zzz"]
_HIT = f"(contains({_HMS.format('start_sec')}, trim(n)) OR contains(lower('Seat ' || seat_id), lower(trim(n))) OR contains(lower({_TEXT}), lower(trim(n))) OR contains(coalesce(lower(regexp_replace(detector_class, '\\s*\\(COCO [0-9]+\\).*', '')), 'none'), lower(trim(n))) OR contains(lower(rule), lower(trim(n))))"


@query("event_search_index", f"SELECT n AS needle, video, ord FROM v_manifest, (SELECT unnest([{', '.join(f"'{n}'" for n in _NEEDLES)}]) AS n) WHERE {_HIT}", "v_manifest")
def _(v):
    """Several searches of one index of all events."""
    m, folder = v.manifest(), sinks.scratch(v.spark)
    search.write_search_index(m, folder, ["video", "ord"])
    found = [search.indexed_search(v.spark, folder, m, n, ["video", "ord"]).select(F.lit(n).alias("needle"), "video", "ord") for n in _NEEDLES]
    return rules.all_events(*found)


@query("evidence_entries", "SELECT ord, 'peak_z' AS name, CAST(peak_z AS VARCHAR) AS value FROM v_manifest WHERE peak_z IS NOT NULL UNION ALL SELECT ord, 'detector_class', detector_class FROM v_manifest WHERE detector_class IS NOT NULL", "v_manifest")
def _(v):
    m = v.manifest().select("ord", F.to_json(F.struct("peak_z", "detector_class", "rule", F.array("seat_id").alias("seats"))).alias("evidence"))
    return review.flatten_evidence(m, ["ord"])


@query("clip_specs", """SELECT video, ord, greatest(0, start_sec - 5) AS ss, greatest(0.5, end_sec - start_sec + 10) AS dur, split_part(video, '.mp4', 1) || '_' || format('{:03d}', row_number() OVER (PARTITION BY video ORDER BY ord) - 1) || '_' || action_label || '.mp4' AS clip FROM v_manifest""", "v_manifest")
def _(v):
    return review.clip_specs(v.manifest())


@query("clip_crops", """SELECT m.video, m.ord, s.x0 AS x, s.y0 AS y, greatest(m.seat_id * 3, 16) AS w, greatest(s.y1 - s.y0, 16) AS h FROM v_manifest m JOIN v_seats s ON s.seat_id = m.seat_id""", "v_manifest", "v_seats")
def _(v):
    boxes = v.seats().withColumn("x1", F.col("x0") + F.col("seat_id") * 3)  # seats 1 to 5 are narrower than a crop may be
    return v.manifest().join(boxes, "seat_id").select("video", "ord", *review.crop_box(*map(F.col, ("x0", "y0", "x1", "y1"))))


@query("overlay_batch", """, picked AS (SELECT * FROM v_manifest WHERE clip_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY action_label ORDER BY ord) = 1)
SELECT video, ord, action_label, (SELECT max(e.ord) FROM v_manifest e WHERE e.ord % 2 = 0 AND e.video = p.video AND e.seat_id = p.seat_id AND e.start_sec = p.start_sec AND e.end_sec = p.end_sec) AS evidence_window FROM picked p""", "v_manifest")
def _(v):
    m = v.manifest()
    saved = m.where("ord % 2 = 0").select("video", "seat_id", "start_sec", "end_sec", F.col("ord").alias("window_id"), F.col("ord").alias("saved"))
    return review.overlay_batch(m, saved).select("video", "ord", "action_label", "evidence_window")


@query("featured_event", "SELECT video, ord FROM v_manifest ORDER BY clip_path IS NULL, ord LIMIT 1", "v_manifest")
def _(v):
    return review.featured_event(v.manifest()).select("video", "ord")


@query("clip_urls", "SELECT ord, CASE WHEN clip_path IS NOT NULL AND ord % 8 < 6 THEN '/clips/' || ord || '.mp4' END AS clip_url FROM v_manifest", "v_manifest")
def _(v):
    m = v.manifest()
    files = m.where("ord % 8 < 6").select(F.concat(F.col("ord").cast("string"), F.lit(".mp4")).alias("name"))
    return review.with_clip_urls(m, files).select("ord", "clip_url")


@query("manifest_sorted", f"SELECT video, ord, round(start_sec, 2) AS start_sec, round(end_sec, 2) AS end_sec, action_label FROM v_manifest", "v_manifest")
def _(v):
    return sinks.rounded(v.manifest()).select("video", "ord", "start_sec", "end_sec", "action_label").orderBy("video", "start_sec")
