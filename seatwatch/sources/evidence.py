"""Evidence store: what each window saw, kept under its exact key and the parameters that made it.

One row a detection, in Parquet below <folder>/evidence-<hash of the parameters>/video=/slot=: a slot is a hash of the
window's key, so a lookup opens the few files of its slots only.  A frame that holds nothing has one row without a
detection, a window without frames one without a frame.  Written windows replace those of the same
key, in one dynamic overwrite of the slots they fall in; other slots are not touched.  A key that isn't stored has no evidence:
nothing of another parameter set, or of a window nearby, stands in for it.

``store_evidence`` and ``stored_evidence`` go by these rows, whatever a window holds; ``packed``, ``write_evidence`` and
``find_evidence`` have one row a window with all its frames as an array, for windows that fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..functions.geometry import BOX

SLOTS = 64
#: A window's key: recording, seat, and its span in whole tenths of a second.
KEY = ["video", "seat_id", "start_ds", "end_ds"]
_DETECTION = "struct<det_idx: bigint, cls_id: int, conf: double, x0: double, y0: double, x1: double, y1: double, track_id: bigint>"
SCHEMA = f"seat_id bigint, start_ds bigint, end_ds bigint, frame struct<t: double>, detection {_DETECTION}, video string, slot int"
_COLUMNS = ["seat_id", "start_ds", "end_ds", "frame", "detection", "video", "slot"]


def tenths(seconds: Column) -> Column:
    return F.round(seconds * 10).cast("long")


def slot() -> Column:
    return F.pmod(F.xxhash64("seat_id", "start_ds", "end_ds"), F.lit(SLOTS)).cast("int")


def keyed(windows: DataFrame) -> DataFrame:
    """windows (video, seat_id, start_sec, end_sec, ...) with the rest of the key and the slot."""
    w = windows.withColumns({"video": F.col("video").cast("string"), "seat_id": F.col("seat_id").cast("long"), "start_ds": tenths(F.col("start_sec")), "end_ds": tenths(F.col("end_sec"))})
    return w.withColumn("slot", slot())


def _as_stored(detections: DataFrame) -> Column:
    """A detection as it is stored: confidence on four decimals, box on one."""
    track = F.col("track_id") if "track_id" in detections.columns else F.lit(None)
    return F.struct(F.col("det_idx").cast("long").alias("det_idx"), F.col("cls_id").cast("int").alias("cls_id"), F.round("conf", 4).alias("conf"), *(F.round(c, 1).alias(c) for c in BOX), track.cast("long").alias("track_id"))


def packed(windows: DataFrame, frames: DataFrame, detections: DataFrame, window: list[str]) -> DataFrame:
    """One row a window: its frames in order of time, each with its detections in order of det_idx, frames that hold
    none too; confidences on four decimals, boxes on one, as stored.

    windows (window, video, seat_id, start_sec, end_sec), frames (window, t), detections (window, t, det_idx, cls_id, conf,
    x0 .. y1[, track_id]).
    """
    seen = detections.groupBy(*window, "t").agg(F.array_sort(F.collect_list(_as_stored(detections))).alias("detections"))
    none = F.array().cast(f"array<{_DETECTION}>")
    whole = frames.select(*window, "t").distinct().join(seen, [*window, "t"], "left").select(*window, F.struct("t", F.coalesce("detections", none).alias("detections")).alias("f"))
    whole = whole.groupBy(*window).agg(F.array_sort(F.collect_list("f")).alias("frames"))
    empty = F.array().cast(whole.schema["frames"].dataType)
    rows = keyed(windows.select(*{*window, "video", "seat_id", "start_sec", "end_sec"}).join(whole, window, "left"))
    return rows.select("seat_id", "start_ds", "end_ds", F.coalesce("frames", empty).alias("frames"), "video", "slot")


def store_path(folder: str, p: Params = DEFAULTS) -> str:
    return f"{folder}/evidence-{p.key()}"


def _stored(spark: SparkSession, folder: str, p: Params) -> DataFrame:
    path = store_path(folder, p)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def store_evidence(windows: DataFrame, frames: DataFrame, detections: DataFrame, folder: str, window: list[str], p: Params = DEFAULTS) -> None:
    """Puts what windows saw into the store, a row a detection; parameters as of packed().  Of windows with one key the
    one with the most frames stays, of those the last by name."""
    times = frames.select(*window, "t").distinct()
    own = {f"_{c}": F.col(c) for c in window}  # a key's video is text, whatever the frames go by
    n = times.groupBy(*(c.alias(x) for x, c in own.items())).agg(F.count("*").alias("_n"))
    most = F.struct(F.coalesce("_n", F.lit(0)), *own)
    best = keyed(windows.withColumns(own)).join(n, [*own], "left").groupBy(*KEY, "slot").agg(F.max_by(F.struct(*own), most).alias("_w"))
    own = best.select(*(F.col(f"_w._{c}").alias(c) for c in window), F.struct(*KEY, "slot").alias("_key"))
    none = F.lit(None).cast(_DETECTION).alias("detection")
    at = times.join(own, window)
    hit = detections.join(at, [*window, "t"]).select("_key", F.struct(F.col("t").cast("double").alias("t")).alias("frame"), _as_stored(detections).cast(_DETECTION).alias("detection"))
    still = at.join(detections.select(*window, "t").distinct(), [*window, "t"], "left_anti").select("_key", F.struct(F.col("t").cast("double").alias("t")).alias("frame"), none)
    empty = own.join(times, window, "left_anti").select("_key", F.lit(None).cast("struct<t: double>").alias("frame"), none)
    rows = hit.unionByName(still).unionByName(empty).select("_key.*", "frame", "detection")
    _replace(rows, own.select("_key.*"), folder, p)


def _replace(rows: DataFrame, keys: DataFrame, folder: str, p: Params) -> None:
    """Rows of the store in place of all rows of these keys.

    The slots that the keys fall in are read, joined with the rows, and replaced as one commit; one writer at a time.
    """
    touched = keys.select("video", "slot").distinct()
    old = _stored(rows.sparkSession, folder, p).join(touched, ["video", "slot"], "left_semi").join(keys.select(*KEY), KEY, "left_anti")
    both = old.select(*_COLUMNS).unionByName(rows.select(*_COLUMNS)).repartition("video", "slot")
    both.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("video", "slot").parquet(store_path(folder, p))


def stored_evidence(spark: SparkSession, folder: str, windows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """windows (video, seat_id, start_sec, end_sec, ...) with frame and detection: a row for each stored detection (or frame
    or window without any); windows that are not stored have no row."""
    return keyed(windows).join(_stored(spark, folder, p), [*KEY, "slot"]).drop("start_ds", "end_ds", "slot")


def write_evidence(rows: DataFrame, folder: str, p: Params = DEFAULTS) -> None:
    """Puts rows of packed() into the store; of rows with one key the one with the most frames stays."""
    rows = rows.groupBy(*KEY, "slot").agg(F.max_by("frames", F.struct(F.size("frames"), F.to_json("frames"))).alias("frames"))
    flat = rows.select(*KEY, "slot", F.explode_outer("frames").alias("f")).select(*KEY, "slot", F.when(F.col("f").isNotNull(), F.struct("f.t")).alias("frame"), F.explode_outer("f.detections").alias("detection"))
    _replace(flat, rows.select(*KEY, "slot"), folder, p)


def _windows(stored: DataFrame) -> DataFrame:
    """Rows of the store as one row a window, as packed() has them."""
    seen = stored.groupBy(*KEY, "slot", "frame").agg(F.array_sort(F.collect_list("detection")).alias("detections"))
    frame = F.when(F.col("frame").isNotNull(), F.struct("frame.t", "detections"))
    whole = seen.groupBy(*KEY, "slot").agg(F.array_sort(F.collect_list(frame)).alias("frames"))
    return whole.select("seat_id", "start_ds", "end_ds", "frames", "video", "slot")


def find_evidence(spark: SparkSession, folder: str, windows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """windows (video, seat_id, start_sec, end_sec, ...) with frames, null where nothing is stored under the exact key."""
    asked = keyed(windows)
    stored = _windows(_stored(spark, folder, p).join(asked.select(*KEY, "slot").distinct(), [*KEY, "slot"], "left_semi"))
    return asked.join(stored, [*KEY, "slot"], "left").drop("start_ds", "end_ds", "slot")


def one_window(spark: SparkSession, folder: str, video: str, seat_id: int, start_sec: float, end_sec: float, p: Params = DEFAULTS) -> DataFrame:
    """The row of one window, or none: a scan of the one slot it can be in."""
    asked = keyed(spark.range(1).select(F.lit(str(video)).alias("video"), F.lit(seat_id).alias("seat_id"), F.lit(start_sec).alias("start_sec"), F.lit(end_sec).alias("end_sec")))
    key = asked.select(*KEY, "slot").first()
    match = F.lit(True)
    for c in [*KEY, "slot"]:
        match = match & (F.col(c) == F.lit(key[c]))
    return _windows(_stored(spark, folder, p).where(match))


def unpacked(rows: DataFrame) -> DataFrame:
    """One row for each stored detection: the rows' other columns, t and the detection's."""
    rest = [c for c in rows.columns if c != "frames"]
    frames = rows.select(*rest, F.explode("frames").alias("f")).select(*rest, "f.t", F.explode("f.detections").alias("d"))
    return frames.select(*rest, "t", "d.*")
