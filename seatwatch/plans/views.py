"""Input views over the stored tables, each as a DataFrame and as SQL.

The engine's own inputs (motion vectors, detections) come from decoders outside
it; the views shape the stored tables into the same schemas, deterministically.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import diagonal, box
from ..operators import motion, score
from ..sources.readers import table

SEATS, BINS, WIDTH = 8, 720, 61
FRAMES, WINDOW = 720, 40
RECORDINGS = 3  #: of the windows, their detections, tracks, seats and scores
WINDOWS = FRAMES // WINDOW


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._kept: dict[str, DataFrame] = {}

    def kept(self, name: str) -> DataFrame:
        """A view that several branches of one query read: computed once (memory, then disk)."""
        if name not in self._kept:
            self._kept[name] = getattr(self, name)().persist()
        return self._kept[name]

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def _hour(self) -> Column:
        return F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").cast("int")

    def seat_activity(self) -> DataFrame:
        raw = self.t("events").groupBy((F.col("user_id") % SEATS).cast("int").alias("seat_id"), self._hour().alias("bin")).agg(F.avg("value").alias("activity"))
        return motion.dense_series(raw, SEATS, BINS)

    def scores(self) -> DataFrame:
        return score.robust_z(self.seat_activity(), WIDTH)

    def motion(self) -> DataFrame:
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
        e = self.t("events").select(F.floor(F.col("event_id") / 10).alias("frame"), F.floor(self._hour() / 6).cast("int").alias("bin"), k.alias("k"), "value")
        return e.select("frame", "bin", F.floor(F.col("k") / 10).cast("int").alias("cy"), (F.col("k") % 10).cast("int").alias("cx"), F.col("value").alias("motion_x"), (F.col("k") % 7 - 3).cast("double").alias("motion_y"))

    def sparse_cube(self) -> DataFrame:
        return motion.cell_cube(self.motion())

    def cube(self) -> DataFrame:
        """Dense, with planted nuisances: a periodic signal in five cells, a jump of all cells in two bins."""
        c = motion.dense_cube(self.sparse_cube(), 120, 10, 10)
        periodic = F.when(F.col("cy") * 10 + F.col("cx") < 5, 200 * (1 + F.cos(2 * F.pi() * F.col("bin") / 8))).otherwise(0.0)
        jump = F.when(F.col("bin").isin(30, 31), 300.0).otherwise(0.0)
        return c.select("bin", "cy", "cx", (F.col("activity") + periodic + jump).alias("activity"))

    def _numbered(self, frame: Column) -> DataFrame:
        li = self.t("lineitem")
        order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
        d = li.withColumn("frame", frame.cast("int")).withColumn("det_idx", F.row_number().over(Window.partitionBy("frame").orderBy(*order)))
        x0, y0 = (F.col("l_partkey") * 37 % 80 * 14).cast("double"), (F.col("l_suppkey") * 53 % 40 * 14).cast("double")
        side = 40 + 2 * F.col("l_quantity")
        cls = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 67).otherwise(73)
        return d.select("frame", "det_idx", cls.alias("cls_id"), (0.05 + 8 * F.col("l_discount")).alias("conf"), x0.alias("x0"), y0.alias("y0"), (x0 + side).alias("x1"), (y0 + side).alias("y1"), (F.col("l_suppkey") % 10).cast("int").alias("track_id"))

    def detections(self) -> DataFrame:
        return self._numbered(F.col("l_orderkey") % FRAMES)

    def sweep_frames(self) -> int:
        return max(1, self.t("lineitem").count() // 8)

    def sweep(self) -> DataFrame:
        return self._numbered(F.col("l_orderkey") % self.sweep_frames()).withColumn("t", F.col("frame") * 5.0)

    def sweep_times(self) -> DataFrame:
        return self.spark.range(self.sweep_frames()).select(F.col("id").cast("int").alias("frame"), (F.col("id") * 5.0).alias("t"))

    def _placed(self, frame: Column) -> dict[str, Column]:
        """The recording, window and frame of a number that counts the frames of all recordings."""
        return {"video": F.floor(frame / FRAMES).cast("int"), "window_id": F.floor(frame % FRAMES / WINDOW).cast("int"), "frame": (frame % FRAMES).cast("int")}

    def tracks(self) -> DataFrame:
        """Tracks 5 to 9 cross the scene in two of five windows, else all stay."""
        li = self.t("lineitem").where(F.col("l_returnflag") == "A")
        track, number = (F.col("l_suppkey") % 10).cast("int"), F.col("l_orderkey") % (RECORDINGS * FRAMES)
        amp = F.when((track >= 5) & (F.floor(number / WINDOW) % 5 < 2), 90.0).otherwise(6.0)
        return li.select(
            *(c.alias(n) for n, c in self._placed(number).items()), track.alias("track_id"), (200 + 100 * track + amp * ((F.col("l_partkey") * 37 % 11) - 5) / 5).alias("cx"),
            (300 + 2.0 * ((F.col("l_partkey") * 53 % 7) - 3)).alias("cy"), (F.sqrt(F.lit(2.0)) * (80 + F.col("l_quantity"))).alias("diag"),
        )

    def seats(self) -> DataFrame:
        n = F.col("n_nationkey")
        x0, y0 = (n % 5 * 240).cast("int"), (F.floor(n / 5) * 130).cast("int")
        return self.t("nation").select((n + 1).cast("int").alias("seat_id"), x0.alias("x0"), y0.alias("y0"), (x0 + 200).alias("x1"), (y0 + 120).alias("y1"))

    def _windows(self) -> DataFrame:
        """18 windows of 40 frames in each recording, and the seat of each."""
        i = F.col("id")
        return self.spark.range(RECORDINGS * WINDOWS).select(F.floor(i / WINDOWS).cast("int").alias("video"), (i % WINDOWS).cast("int").alias("window_id"), (i % WINDOWS % 7 + 1).cast("int").alias("seat_id"))

    def recorded_scores(self) -> DataFrame:
        """Scores of several recordings: in the r-th a seat has the series of the seat r further."""
        video = F.explode(F.array(*map(F.lit, range(RECORDINGS)))).alias("video")
        return self.kept("scores").select(video, "seat_id", "bin", "z").withColumn("seat_id", ((F.col("seat_id") + SEATS - F.col("video")) % SEATS).cast("int"))

    def recorded_seats(self) -> DataFrame:
        video = F.explode(F.array(*map(F.lit, range(RECORDINGS)))).alias("video")
        s = self.seats().select(video, "seat_id", "x0", "y0", "x1", "y1")
        return s.withColumns({"x0": F.col("x0") + 8 * F.col("video"), "x1": F.col("x1") + 8 * F.col("video")})

    def windows(self) -> DataFrame:
        """Each window with its bins in the score series, and how high z is there."""
        first = F.col("window_id") * WINDOW
        w = self._windows().select("video", "window_id", "seat_id", first.alias("i0"), (first + WINDOW).alias("i1"), F.lit(float(WINDOW)).alias("duration_s"), F.lit(WINDOW).alias("n_frames"))
        z = self.recorded_scores().select("video", "seat_id", F.floor(F.col("bin") / WINDOW).cast("int").alias("window_id"), "z")
        return w.join(z, ["video", "seat_id", "window_id"]).groupBy(*w.columns).agg(F.avg("z").alias("mean_z"), F.max("z").alias("peak_z"))

    def neighbours(self) -> DataFrame:
        near = F.posexplode(F.array(F.col("seat_id") - 1, F.col("seat_id") + 1)).alias("ord", "neighbour")
        return self._windows().select("video", "window_id", near).select("video", "window_id", "neighbour", (F.col("ord") + 1).alias("ord"))

    def window_seats(self) -> DataFrame:
        own = self._windows().withColumn("ord", F.lit(0))
        return own.unionByName(self.neighbours().withColumnRenamed("neighbour", "seat_id")).join(self.recorded_seats(), ["video", "seat_id"]).select("video", "window_id", "seat_id", "ord", "x0", "y0", "x1", "y1")

    def window_detections(self) -> DataFrame:
        """Phones are faint in every second window and papers in every fifth, so that not all rules fire everywhere."""
        number = F.floor(F.col("frame") / WINDOW)
        faint = F.when((F.col("cls_id") == 67) & (number % 2 == 1), 0.2).when((F.col("cls_id") == 73) & (number % 5 == 0), 0.1).otherwise(1.0)
        d = self._numbered(F.col("l_orderkey") % (RECORDINGS * FRAMES)).withColumn("conf", F.col("conf") * faint)
        return d.withColumns(self._placed(F.col("frame"))).withColumn("t", F.col("frame") / 5.0)

    def walking_detections(self) -> DataFrame:
        """Window detections whose persons keep their place from frame to frame, but for those who cross."""
        k, moved = F.col("track_id"), F.when((F.col("track_id") >= 5) & ((F.col("video") * WINDOWS + F.col("window_id")) % 5 < 2), 4.0 * (F.col("frame") % WINDOW)).otherwise(0.0)
        jitter = F.col("x0") / 14 % 7 - 3
        x, y = 60 + 110.0 * k + moved + jitter, 200 + 150.0 * (k % 2) - jitter
        person = F.col("cls_id") == 0
        at = {"x0": x, "y0": y, "x1": x + 70 + jitter, "y1": y + 140}
        return self.window_detections().withColumns({c: F.when(person, e).otherwise(F.col(c)) for c, e in at.items()}).drop("track_id")

    def seat_motion(self) -> DataFrame:
        """A dense cube of each recording with more motion about every fourth cell of a 24 x 20 grid."""
        k, e = F.regexp_extract("props", "([0-9]+)", 1).cast("int"), F.col("event_id")
        video = (F.floor(e / 10) % RECORDINGS).cast("int").alias("video")
        vectors = self.t("events").select(video, F.floor(e / 10).alias("frame"), F.floor(self._hour() / 6).cast("int").alias("bin"), (k * 7 % 24).cast("int").alias("cy"), ((k * 11 + e) % 20).cast("int").alias("cx"), F.col("value").alias("motion_x"), (k % 7 - 3).cast("double").alias("motion_y"))
        recordings = self.spark.range(RECORDINGS).select(F.col("id").cast("int").alias("video"), F.lit(120).alias("bins"))
        cube = motion.dense_cube(motion.cell_cube(vectors, ["video", "frame"]), "bins", 24, 20, recordings, ["video"])
        seat = F.when((F.col("cy") % 4 == F.col("video") % 2 + 1) & (F.col("cx") % 5 == 2), 6.0).otherwise(1.0)
        return cube.select("video", "bin", "cy", "cx", (F.col("activity") * seat).alias("activity"))

    def calibration(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Recordings, frames (half an hour each, unevenly spaced), persons at one of 20 places, and a cube of 12 x 20 cells of 64 pixels."""
        t = (F.col("frame") * 2.5 + F.col("frame") % 3 * 0.1).alias("t")
        frames = self.window_frames().select("video", t)
        k = F.col("track_id") * 2 + F.col("det_idx") % 2
        x0, y0 = k % 5 * 240 + F.col("det_idx") % 7 * 3 + 4 * F.col("video"), F.floor(k / 5) * 180 + F.col("frame") % 5 * 2
        d = self.window_detections().select("video", t, F.col("det_idx").cast("int").alias("det_idx"), "cls_id", F.lit(0.5).alias("conf"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 200.0).alias("x1"), (y0 + 120.0).alias("y1"))
        recordings = self.spark.range(RECORDINGS).select(F.col("id").cast("int").alias("video"), F.lit(1800.0).alias("duration_s"), F.lit(120).alias("bins"))
        n, e = F.regexp_extract("props", "([0-9]+)", 1).cast("int"), F.col("event_id")
        vectors = self.t("events").select((F.floor(e / 10) % RECORDINGS).cast("int").alias("video"), F.floor(e / 10).alias("frame"), F.floor(self._hour() / 6).cast("int").alias("bin"), (n * 7 % 12).cast("int").alias("cy"), ((n * 11 + e) % 20).cast("int").alias("cx"), F.col("value").alias("motion_x"), (n % 7 - 3).cast("double").alias("motion_y"))
        return recordings, frames, d, motion.dense_cube(motion.cell_cube(vectors, ["video", "frame"]), "bins", 12, 20, recordings, ["video"])

    def window_frames(self) -> DataFrame:
        return self.spark.range(RECORDINGS * FRAMES).select(*(c.alias(n) for n, c in self._placed(F.col("id")).items())).withColumn("t", F.col("frame") / 5.0)

    def consecutive(self) -> DataFrame:
        """Consecutive seats of one recording, both ways."""
        s = self.seats().select("seat_id")
        return s.select(F.col("seat_id").alias("a"), (F.col("seat_id") + 1).alias("b")).unionByName(s.select((F.col("seat_id") + 1).alias("a"), F.col("seat_id").alias("b")))

    def edges(self) -> DataFrame:
        """Consecutive seats of each recording, both ways; in the last one seat 3 stands alone."""
        s = self.recorded_seats().select("video", F.col("seat_id").alias("a"), (F.col("seat_id") + 1).alias("b"))
        both = s.unionByName(s.select("video", F.col("b").alias("a"), F.col("a").alias("b")))
        return both.where((F.col("video") < RECORDINGS - 1) | ((F.col("a") != 3) & (F.col("b") != 3)))

    def manifest(self) -> DataFrame:
        o = self.t("orders")
        labels = F.array(*(F.lit(x) for x in LABELS))
        start = 3.0 * F.expr("datediff(o_orderdate, DATE'1995-01-01')")
        key = F.col("o_orderkey")
        return o.select(
            F.concat("o_orderpriority", F.lit(".mp4")).alias("video"), (key % 12 + 1).cast("int").alias("seat_id"), start.alias("start_sec"), (start + key % 20 + 2).alias("end_sec"), F.get(labels, (F.col("o_custkey") % 8).cast("int")).alias("action_label"),
            F.least(F.lit(0.97), F.col("o_totalprice") / 500000).alias("confidence"), key.alias("ord"), F.when(key % 3 > 0, (key % 500) / 10).alias("peak_z"), F.when(F.col("o_custkey") % 8 == 0, "cell phone (COCO 67)").alias("detector_class"),
            F.concat(F.lit("rule "), (key % 5).cast("string")).alias("rule"), F.when(key % 4 > 0, F.concat(F.lit("clips/"), key.cast("string"), F.lit(".mp4"))).alias("clip_path"),
        )

    def recordings(self) -> DataFrame:
        """A recording for each customer, as long as its dearest order is dear."""
        return self.t("orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".mp4")).alias("video")).agg((F.max("o_totalprice") / 50).alias("duration_s"))

    def videos(self) -> DataFrame:
        rows = [(n, float(d)) for n, d in VIDEOS]
        return self.spark.createDataFrame(rows, "video string, duration_s double")

    def truth(self) -> DataFrame:
        return self.spark.createDataFrame(TRUTH, "gt_id int, video string, start_sec double, end_sec double, label string")


LABELS = ["mobile_phone_usage", "paper_pass", "paper_pass_object_present", "seat_exchange", "talking_to_neighbour", "staff_or_transit", "crowd_gathering", "unclassified_anomaly"]
VIDEOS = [("1-URGENT.mp4", 7697), ("2-HIGH.mp4", 8040), ("3-MEDIUM.mp4", 282), ("4-NOT SPECIFIED.mp4", 0), ("5-LOW.mp4", 3725)]
TRUTH = [
    (1, "1-URGENT.mkv", 1000.0, 1015.0, "mobile_phone_usage"),
    (2, "2-HIGH.mp4", 2000.0, 2400.0, "talking_to_neighbour"),
    (3, "3-MEDIUM.mp4", 9000.0, 9010.0, "paper_pass"),
    (4, "4-NOT SPECIFIED.mp4", None, None, "crowd_gathering"),
    (5, "5-LOW.mp4", None, None, "staff_or_transit"),
    (6, "6-MISSING.mp4", None, None, "paper_pass"),
]


# --- the same as SQL -------------------------------------------------------------


def iou_sql(a: str, b: str, pa: str = "", pb: str = "") -> str:
    w = f"greatest(least({a}.{pa}x1, {b}.{pb}x1) - greatest({a}.{pa}x0, {b}.{pb}x0), 0)"
    h = f"greatest(least({a}.{pa}y1, {b}.{pb}y1) - greatest({a}.{pa}y0, {b}.{pb}y0), 0)"
    area = lambda t, p: f"({t}.{p}x1 - {t}.{p}x0) * ({t}.{p}y1 - {t}.{p}y0)"
    return f"CASE WHEN {w} * {h} > 0 THEN {w} * {h} / CAST({area(a, pa)} + {area(b, pb)} - {w} * {h} AS DOUBLE) ELSE 0 END"


def tiou_sql(a: str, b: str) -> str:
    shared = f"greatest(least({a}.end_sec, {b}.end_sec) - greatest({a}.start_sec, {b}.start_sec), 0)"
    union = f"(({a}.end_sec - {a}.start_sec) + ({b}.end_sec - {b}.start_sec) - {shared})"
    return f"CASE WHEN {union} > 0 THEN {shared} / {union} ELSE 0 END"


def blend_sql(p: str, s: str) -> str:
    return f"least(greatest(0.5::DOUBLE * least(greatest({p}, 0), 1) + 0.5::DOUBLE * least(greatest({s}, 0), 1), 0), 0.97::DOUBLE)"


def _literal(rows) -> str:
    value = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return ", ".join(f"({', '.join(value(v) for v in r)})" for r in rows)


_DETECTION = """row_number() OVER (PARTITION BY {frame} ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS det_idx,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 67 ELSE 73 END AS cls_id, 0.05::DOUBLE + 8 * l_discount AS conf,
  CAST(l_partkey * 37 % 80 * 14 AS DOUBLE) AS x0, CAST(l_suppkey * 53 % 40 * 14 AS DOUBLE) AS y0,
  l_partkey * 37 % 80 * 14 + (40 + 2 * l_quantity) AS x1, l_suppkey * 53 % 40 * 14 + (40 + 2 * l_quantity) AS y1, CAST(l_suppkey % 10 AS INT) AS track_id"""

#: name -> (needs, SQL)
SQL = {
    "v_seat_activity": ([], """SELECT CAST(s.i AS INT) AS seat_id, CAST(b.i AS INT) AS bin, coalesce(r.activity, 0) AS activity
  FROM range(8) s(i) CROSS JOIN range(720) b(i) LEFT JOIN
    (SELECT user_id % 8 AS seat_id, date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS bin, avg(value) AS activity FROM events GROUP BY 1, 2) r
    ON r.seat_id = s.i AND r.bin = b.i"""),
    "v_x": (["v_seat_activity"], "SELECT *, sqrt(greatest(activity, 0)) AS x FROM v_seat_activity"),
    "v_base": (["v_x"], """SELECT a.seat_id, a.bin, quantile_cont(y.x, 0.5) AS baseline FROM v_x a CROSS JOIN range(-30, 31) o(i)
  JOIN v_x y ON y.seat_id = a.seat_id AND y.bin = least(greatest(a.bin + o.i, 0), 719) GROUP BY a.seat_id, a.bin"""),
    "v_off": (["v_base"], "SELECT x.seat_id, x.bin, x.activity, x.x, b.baseline, abs(x.x - b.baseline) AS off FROM v_x x JOIN v_base b ON x.seat_id = b.seat_id AND x.bin = b.bin"),
    "v_roll": (["v_off"], """SELECT a.seat_id, a.bin, quantile_cont(y.off, 0.5) AS spread FROM v_off a CROSS JOIN range(-30, 31) o(i)
  JOIN v_off y ON y.seat_id = a.seat_id AND y.bin = least(greatest(a.bin + o.i, 0), 719) GROUP BY a.seat_id, a.bin"""),
    "v_mad": (["v_x"], "SELECT seat_id, quantile_cont(abs(x - m), 0.5) AS mad FROM v_x JOIN (SELECT seat_id, quantile_cont(x, 0.5) AS m FROM v_x GROUP BY seat_id) USING (seat_id) GROUP BY seat_id"),
    "v_scaled": (["v_roll", "v_mad"], """SELECT o.*, greatest(1.4826::DOUBLE * r.spread, greatest(0.25::DOUBLE * 1.4826::DOUBLE * m.mad, greatest(0.05::DOUBLE * (SELECT quantile_cont(x, 0.95) FROM v_x), 1e-6::DOUBLE))) AS scale
  FROM v_off o JOIN v_roll r ON o.seat_id = r.seat_id AND o.bin = r.bin JOIN v_mad m ON o.seat_id = m.seat_id"""),
    "v_z": (["v_scaled"], "SELECT seat_id, bin, activity, x, baseline, scale, greatest((x - baseline) / scale, 0) AS z FROM v_scaled"),
    "v_runs": (["v_z"], """SELECT seat_id, min(bin) AS i0, max(bin) + 1 AS i1, max(z) AS peak_z, avg(z) AS mean_z, CAST(count(*) AS DOUBLE) AS duration_s, avg(z) * sqrt(count(*)) AS salience
  FROM (SELECT seat_id, bin, z, bin - row_number() OVER (PARTITION BY seat_id ORDER BY bin) AS run FROM v_z WHERE z > 3.5) GROUP BY seat_id, run"""),
    "v_ranked": (["v_runs"], "SELECT *, row_number() OVER (ORDER BY round(salience, 9) DESC, seat_id, i0) AS rank FROM v_runs"),
    "v_motion": ([], """SELECT event_id // 10 AS frame, CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) // 6 AS INT) AS bin, k // 10 AS cy, k % 10 AS cx, value AS motion_x, CAST(k % 7 - 3 AS DOUBLE) AS motion_y
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)"""),
    "v_frame_motion": (["v_motion"], "SELECT frame, count(*) AS vectors, quantile_cont(motion_x, 0.5) AS gmv_x, quantile_cont(motion_y, 0.5) AS gmv_y FROM v_motion GROUP BY frame"),
    "v_sparse": (["v_frame_motion"], """SELECT bin, cy, cx, avg(sqrt((motion_x - gmv_x) ** 2 + (motion_y - gmv_y) ** 2)) AS activity, count(*) AS hits
  FROM v_motion m JOIN v_frame_motion f ON m.frame = f.frame GROUP BY bin, cy, cx"""),
    "v_dense": (["v_sparse"], """SELECT CAST(b.i AS INT) AS bin, CAST(c.i // 10 AS INT) AS cy, CAST(c.i % 10 AS INT) AS cx, coalesce(s.activity, 0) AS activity, coalesce(s.hits, 0) AS hits
  FROM range(120) b(i) CROSS JOIN range(100) c(i) LEFT JOIN v_sparse s ON s.bin = b.i AND s.cy = c.i // 10 AND s.cx = c.i % 10"""),
    "v_cube": (["v_dense"], """SELECT bin, cy, cx, activity + CASE WHEN cy * 10 + cx < 5 THEN 200 * (1 + cos(2 * pi() * bin / 8)) ELSE 0 END + CASE WHEN bin IN (30, 31) THEN 300 ELSE 0 END AS activity FROM v_dense"""),
    "v_cell_median": (["v_cube"], "SELECT cy, cx, quantile_cont(activity, 0.5) AS m FROM v_cube GROUP BY cy, cx"),
    "v_cell_scale": (["v_cell_median"], "SELECT c.cy, c.cx, any_value(m) AS m, greatest(1.4826::DOUBLE * quantile_cont(abs(activity - m), 0.5), 1e-3::DOUBLE) AS s FROM v_cube c JOIN v_cell_median d ON c.cy = d.cy AND c.cx = d.cx GROUP BY c.cy, c.cx"),
    "v_light": (["v_cell_scale"], "SELECT bin, avg(CASE WHEN (activity - m) / s > 3 THEN 1.0::DOUBLE ELSE 0 END) AS hot_share FROM v_cube c JOIN v_cell_scale d ON c.cy = d.cy AND c.cx = d.cx GROUP BY bin"),
    "v_power": (["v_cube"], """SELECT cy, cx, k, power(sum(v * cos(2 * pi() * k * bin / 120)), 2) + power(sum(v * sin(2 * pi() * k * bin / 120)), 2) AS p
  FROM (SELECT c.cy, c.cx, bin, (activity - mean) * (0.5 - 0.5 * cos(2 * pi() * bin / 119)) AS v FROM v_cube c JOIN (SELECT cy, cx, avg(activity) AS mean FROM v_cube GROUP BY cy, cx) m ON c.cy = m.cy AND c.cx = m.cx)
  CROSS JOIN (SELECT i AS k FROM range(61) f(i)) GROUP BY cy, cx, k"""),
    "v_band": (["v_power"], "SELECT cy, cx, k, CASE WHEN k >= 1 AND k / 120.0::DOUBLE >= 0.05::DOUBLE THEN p ELSE 0 END AS p FROM v_power"),
    "v_peak": (["v_band"], "SELECT cy, cx, arg_max(k, p) AS k, max(p) AS p, sum(p) AS total FROM v_band GROUP BY cy, cx"),
    "v_prominence": (["v_peak"], """SELECT a.cy, a.cx, (a.p + lo.p + hi.p) / a.total AS prominence, a.k / 120.0::DOUBLE AS frequency FROM v_peak a
  JOIN v_band lo ON lo.cy = a.cy AND lo.cx = a.cx AND lo.k = greatest(a.k - 1, 0) JOIN v_band hi ON hi.cy = a.cy AND hi.cx = a.cx AND hi.k = least(a.k + 1, 60)"""),
    "v_periodic": (["v_prominence"], "SELECT *, prominence >= 0.35 AND (SELECT avg(CASE WHEN prominence >= 0.35 THEN 1 ELSE 0 END) FROM v_prominence) <= 0.20 AS periodic FROM v_prominence"),
    "v_detections": ([], "SELECT CAST(l_orderkey % 720 AS INT) AS frame, " + _DETECTION.format(frame="l_orderkey % 720") + " FROM lineitem"),
    "v_n": ([], "SELECT greatest(count(*) // 8, 1) AS n FROM lineitem"),
    "v_sweep": (["v_n"], "SELECT *, frame * 5.0::DOUBLE AS t FROM (SELECT CAST(l_orderkey % (SELECT n FROM v_n) AS INT) AS frame, " + _DETECTION.format(frame="l_orderkey % (SELECT n FROM v_n)") + " FROM lineitem)"),
    "v_times": (["v_n"], "SELECT CAST(i AS INT) AS frame, i * 5.0::DOUBLE AS t FROM (SELECT unnest(range(n)) AS i FROM v_n)"),
    # windows of all recordings have one number here, window // 18 is the recording and frame // 720 too
    "v_tracks": ([], """SELECT CAST(l_orderkey % 2160 // 40 AS INT) AS window_id, CAST(l_suppkey % 10 AS INT) AS track_id, l_orderkey % 2160 % 720 AS frame,
    200 + 100 * (l_suppkey % 10) + CASE WHEN l_suppkey % 10 >= 5 AND l_orderkey % 2160 // 40 % 5 < 2 THEN 90.0::DOUBLE ELSE 6.0::DOUBLE END * ((l_partkey * 37 % 11) - 5) / 5 AS cx,
    300 + 2.0::DOUBLE * ((l_partkey * 53 % 7) - 3) AS cy, sqrt(2.0::DOUBLE) * (80 + l_quantity) AS diag FROM lineitem WHERE l_returnflag = 'A'"""),
    "v_moved": (["v_tracks"], """SELECT window_id, track_id, count(*) AS n, 2 * max(sqrt((cx - mx) ** 2 + (cy - my) ** 2)) / quantile_cont(diag, 0.5) AS displacement
  FROM v_tracks t JOIN (SELECT window_id, track_id, avg(cx) AS mx, avg(cy) AS my FROM v_tracks GROUP BY ALL) m USING (window_id, track_id) GROUP BY window_id, track_id HAVING count(*) >= 3 AND quantile_cont(diag, 0.5) > 1"""),
    "v_seats": ([], "SELECT n_nationkey + 1 AS seat_id, n_nationkey % 5 * 240 AS x0, n_nationkey // 5 * 130 AS y0, n_nationkey % 5 * 240 + 200 AS x1, n_nationkey // 5 * 130 + 120 AS y1 FROM nation"),
    "v_rz": (["v_z"], "SELECT CAST(r.i AS INT) AS video, CAST((seat_id + 8 - r.i) % 8 AS INT) AS seat_id, bin, z FROM v_z CROSS JOIN range(3) r(i)"),
    "v_rseats": (["v_seats"], "SELECT CAST(r.i AS INT) AS video, seat_id, x0 + 8 * r.i AS x0, y0, x1 + 8 * r.i AS x1, y1 FROM v_seats CROSS JOIN range(3) r(i)"),
    "v_windows": (["v_rz"], """SELECT CAST(w.i AS INT) AS window_id, CAST(w.i % 18 % 7 + 1 AS INT) AS seat_id, w.i % 18 * 40 AS i0, (w.i % 18 + 1) * 40 AS i1, 40.0::DOUBLE AS duration_s, 40 AS n_frames, avg(z.z) AS mean_z, max(z.z) AS peak_z
  FROM range(54) w(i) JOIN v_rz z ON z.video = w.i // 18 AND z.seat_id = w.i % 18 % 7 + 1 AND z.bin // 40 = w.i % 18 GROUP BY w.i"""),
    "v_neighbours": ([], "SELECT CAST(w.i AS INT) AS window_id, CAST(w.i % 18 % 7 + 1 + o.d AS INT) AS neighbour, o.k AS ord FROM range(54) w(i) CROSS JOIN (VALUES (-1, 1), (1, 2)) o(d, k)"),
    "v_window_seats": (["v_neighbours", "v_rseats"], """SELECT window_id, s.seat_id, ord, x0, y0, x1, y1 FROM (SELECT CAST(i AS INT) AS window_id, CAST(i % 18 % 7 + 1 AS INT) AS seat_id, 0 AS ord FROM range(54) w(i)
    UNION ALL SELECT window_id, neighbour, ord FROM v_neighbours) w JOIN v_rseats s ON s.seat_id = w.seat_id AND s.video = w.window_id // 18"""),
    "v_window_detections": ([], "SELECT * EXCLUDE (n, conf), conf * CASE WHEN cls_id = 67 AND n // 40 % 2 = 1 THEN 0.2::DOUBLE WHEN cls_id = 73 AND n // 40 % 5 = 0 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS conf, n AS place, n % 720 AS frame, CAST(n // 40 AS INT) AS window_id, n % 720 / 5.0::DOUBLE AS t FROM (SELECT CAST(l_orderkey % 2160 AS INT) AS n, " + _DETECTION.format(frame="l_orderkey % 2160") + " FROM lineitem)"),
    "v_c_motion": ([], """SELECT event_id // 10 AS frame, event_id // 10 % 3 AS video, CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) // 6 AS INT) AS bin, n * 7 % 12 AS cy, (n * 11 + event_id) % 20 AS cx, value AS motion_x, CAST(n % 7 - 3 AS DOUBLE) AS motion_y
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS n FROM events)"""),
    "v_c_energy": (["v_c_motion"], """SELECT video, cy, cx, sum(activity) / 120.0::DOUBLE AS energy FROM (SELECT m.video, bin, cy, cx, avg(sqrt((motion_x - gx) ** 2 + (motion_y - gy) ** 2)) AS activity
  FROM v_c_motion m JOIN (SELECT frame, quantile_cont(motion_x, 0.5) AS gx, quantile_cont(motion_y, 0.5) AS gy FROM v_c_motion GROUP BY frame) f ON f.frame = m.frame WHERE bin BETWEEN 0 AND 119 GROUP BY ALL) GROUP BY ALL"""),
    "v_c_samples": ([], """SELECT v.i * 6 + w.i AS window_id, v.i AS video, s.i AS sample, min(f.t) AS t FROM range(3) v(i) CROSS JOIN range(6) w(i) CROSS JOIN range(48) s(i)
  JOIN (SELECT i * 2.5::DOUBLE + i % 3 * 0.1::DOUBLE AS t FROM range(720) r(i)) f ON f.t >= 1680.0::DOUBLE * w.i / 5 + 120.0::DOUBLE * s.i / 48 - 1e-6 GROUP BY ALL"""),
    "v_pairs": (["v_window_detections", "v_window_seats"], f"""SELECT d.place, d.det_idx, s.seat_id, s.ord, round({iou_sql('d', 's')}, 12) AS iou,
    (d.x0 + d.x1) / 2 BETWEEN s.x0 AND s.x1 AND (d.y0 + d.y1) / 2 BETWEEN s.y0 AND s.y1 AS inside,
    round(sqrt(((d.x0 + d.x1) / 2 - (s.x0 + s.x1) / 2.0::DOUBLE) ** 2 + ((d.y0 + d.y1) / 2 - (s.y0 + s.y1) / 2.0::DOUBLE) ** 2), 9) AS far
  FROM v_window_detections d JOIN v_window_seats s ON s.window_id = d.window_id AND d.x0 <= s.x1 AND d.x1 >= s.x0 AND d.y0 <= s.y1 AND d.y1 >= s.y0"""),
    "v_best": (["v_pairs"], "SELECT place, det_idx, seat_id AS best FROM v_pairs WHERE iou >= 0.10 QUALIFY row_number() OVER (PARTITION BY place, det_idx ORDER BY iou DESC, ord) = 1"),
    "v_near": (["v_pairs"], "SELECT place, det_idx, seat_id AS near FROM v_pairs WHERE inside QUALIFY row_number() OVER (PARTITION BY place, det_idx ORDER BY far, ord) = 1"),
    "v_assigned": (["v_best", "v_near"], """SELECT d.*, coalesce(best, near) AS seat_id, CASE WHEN best IS NOT NULL THEN 'iou' WHEN near IS NOT NULL THEN 'centre' END AS how
  FROM v_window_detections d LEFT JOIN v_best b ON d.place = b.place AND d.det_idx = b.det_idx LEFT JOIN v_near c ON d.place = c.place AND d.det_idx = c.det_idx"""),
    "v_consecutive": (["v_seats"], "SELECT seat_id AS a, seat_id + 1 AS b FROM v_seats UNION ALL SELECT seat_id + 1, seat_id FROM v_seats"),
    "v_edges": (["v_rseats"], """SELECT * FROM (SELECT video, seat_id AS a, seat_id + 1 AS b FROM v_rseats UNION ALL SELECT video, seat_id + 1, seat_id FROM v_rseats) WHERE video < 2 OR (a <> 3 AND b <> 3)"""),
    "v_sweep_pairs": (["v_sweep", "v_seats"], f"""SELECT d.frame, d.det_idx, s.seat_id, round({iou_sql('d', 's')}, 12) AS iou, (d.x0 + d.x1) / 2 BETWEEN s.x0 AND s.x1 AND (d.y0 + d.y1) / 2 BETWEEN s.y0 AND s.y1 AS inside
  FROM v_sweep d JOIN v_seats s ON d.x0 <= s.x1 AND d.x1 >= s.x0 AND d.y0 <= s.y1 AND d.y1 >= s.y0"""),
    "v_sweep_seat": (["v_sweep_pairs"], """SELECT frame, det_idx, coalesce(arg_max(seat_id, (iou, -seat_id)) FILTER (WHERE iou > 0), min(seat_id) FILTER (WHERE inside)) AS seat_id FROM v_sweep_pairs GROUP BY frame, det_idx"""),
    "v_sweep_assigned": (["v_sweep_seat"], "SELECT d.*, s.seat_id FROM v_sweep d JOIN v_sweep_seat s ON d.frame = s.frame AND d.det_idx = s.det_idx WHERE s.seat_id IS NOT NULL"),
    "v_manifest": ([], f"""SELECT o_orderpriority || '.mp4' AS video, CAST(o_orderkey % 12 + 1 AS INT) AS seat_id, 3.0::DOUBLE * date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS start_sec,
    3.0::DOUBLE * date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 20 + 2 AS end_sec, [{', '.join(f"'{x}'" for x in LABELS)}][o_custkey % 8 + 1] AS action_label,
    least(0.97::DOUBLE, o_totalprice / 500000) AS confidence, o_orderkey AS ord, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 500) / 10.0::DOUBLE END AS peak_z,
    CASE WHEN o_custkey % 8 = 0 THEN 'cell phone (COCO 67)' END AS detector_class, 'rule ' || (o_orderkey % 5) AS rule, CASE WHEN o_orderkey % 4 > 0 THEN 'clips/' || o_orderkey || '.mp4' END AS clip_path FROM orders"""),
    "v_recordings": ([], "SELECT 'c' || o_custkey || '.mp4' AS video, max(o_totalprice) / 50 AS duration_s FROM orders GROUP BY o_custkey"),
    "v_videos": ([], f"SELECT * FROM (VALUES {_literal((n, float(d)) for n, d in VIDEOS)}) v(video, duration_s)"),
    "v_truth": ([], f"SELECT * FROM (VALUES {_literal(TRUTH)}) t(gt_id, video, start_sec, end_sec, label)"),
}


def _of_triage() -> dict[str, tuple[list[str], str]]:
    """The same scores over the cube of the vectors alone, with 120 bins and 25 seats of 2 x 2 cells: t_ for v_."""
    cells = "cell_median cell_scale light power band peak prominence periodic".split()
    seats = "x base off roll mad scaled z".split()
    inner = re.compile(rf"\bv_({'|'.join(['cube', 'seat_activity', *cells, *seats])})\b")
    out = {
        "t_cube": (["v_dense"], "SELECT bin, cy, cx, activity FROM v_dense"),
        "t_zeroed": (["t_periodic", "t_light"], """SELECT c.bin, c.cy, c.cx, CASE WHEN p.periodic THEN 0 ELSE c.activity END AS activity, l.hot_share >= 0.60 AS gated
  FROM t_cube c JOIN t_periodic p ON p.cy = c.cy AND p.cx = c.cx JOIN t_light l ON l.bin = c.bin"""),
        "t_fill": (["t_zeroed"], "SELECT cy, cx, quantile_cont(activity, 0.5) AS f FROM t_zeroed WHERE NOT gated GROUP BY cy, cx"),
        "t_seat_activity": (["t_fill"], """SELECT CAST(z.cy // 2 * 5 + z.cx // 2 AS INT) AS seat_id, bin, avg(CASE WHEN gated THEN coalesce(f, 0) ELSE activity END) AS activity
  FROM t_zeroed z LEFT JOIN t_fill f ON f.cy = z.cy AND f.cx = z.cx GROUP BY 1, 2"""),
    }
    for name in [*cells, *seats]:
        needs, text = SQL[f"v_{name}"]
        text = inner.sub(r"t_\1", text).replace("719", "119").replace("/ a.total", "/ nullif(a.total, 0)")  # a cell may have no motion at all
        out[f"t_{name}"] = ([inner.sub(r"t_\1", n) for n in needs], text)
    return out


SQL |= _of_triage()


def with_views(select: str, *names: str) -> str:
    """select with the views it names, and what they need, as common table expressions.

    A text that starts with ", " (or "RECURSIVE ") brings more expressions of its own.
    """
    order: list[str] = []

    def add(name: str) -> None:
        for need in SQL[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    body = select.lstrip()
    recursive = body.startswith("RECURSIVE ")
    body = body.removeprefix("RECURSIVE ").removeprefix(", ") if recursive or body.startswith(", ") else body
    own = select.lstrip() != body  # the text goes on with expressions of its own
    head = ",\n".join(f"{n} AS ({SQL[n][1]})" for n in order)
    if not head and not own:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{',' if head and own else ''}\n{body}"
