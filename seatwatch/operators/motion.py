"""From motion vectors to a dense time by cell activity cube."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..functions.geometry import to_cell


def scan_vectors(vectors: DataFrame, start_s: float = 0.0, end_s: float | None = None) -> DataFrame:
    """Vectors of predicted frames within [start, end); the conditions reach the Parquet scan."""
    out = vectors.where(F.col("pict_type").isin("P", "B") & (F.col("ts") >= start_s))
    return out if end_s is None else out.where(F.col("ts") < end_s)


def sample_stride(vectors: DataFrame, stride: int) -> DataFrame:
    """Every stride-th frame of each video, the first kept being number ``stride``.

    Frames are numbered on a table of frames, so a video's vectors are not sorted in one task.
    """
    frames = vectors.select("video", "frame_no").distinct()
    numbered = frames.withColumn("_n", F.row_number().over(Window.partitionBy("video").orderBy("frame_no")))
    return vectors.join(numbered.where(F.col("_n") % stride == 0).select("video", "frame_no"), ["video", "frame_no"], "left_semi")


def scaled_vectors(vectors: DataFrame, videos: DataFrame, p: Params = DEFAULTS, start_s: float = 0.0) -> DataFrame:
    """video, frame, bin, cy, cx, motion_x, motion_y: vectors in pixels, on the cell grid and in time bins."""
    scale = F.greatest(F.coalesce("motion_scale", F.lit(1)), F.lit(1))
    grid = lambda size: F.ceil(F.col(size) / p.cell_px)
    return (
        vectors.join(videos.select("video", "width", "height"), "video")
        .withColumn("bin", F.floor((F.col("ts") - start_s) / p.bin_s).cast("int"))
        .where(F.col("bin") >= 0)
        .select("video", F.col("frame_no").alias("frame"), "bin", to_cell(F.col("dst_y"), p.cell_px, grid("height")).alias("cy"), to_cell(F.col("dst_x"), p.cell_px, grid("width")).alias("cx"), (F.col("motion_x") / scale).alias("motion_x"), (F.col("motion_y") / scale).alias("motion_y"))
    )


def global_motion(motion: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per frame: how many vectors and their exact median motion."""
    keys = keys or ["frame"]
    return motion.groupBy(*keys).agg(F.count("*").alias("vectors"), F.percentile("motion_x", F.lit(0.5)).alias("gmv_x"), F.percentile("motion_y", F.lit(0.5)).alias("gmv_y"))


def residual_motion(motion: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """motion with ``residual``: the distance from its frame's median motion."""
    keys = keys or ["frame"]
    frame = global_motion(motion, keys).drop("vectors")
    return motion.join(frame, keys).withColumn("residual", F.hypot(F.col("motion_x") - F.col("gmv_x"), F.col("motion_y") - F.col("gmv_y")))


def cell_cube(motion: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sparse cube: mean residual and number of vectors of each bin and cell."""
    lead = [k for k in (keys or ["frame"]) if k != "frame"]
    return residual_motion(motion, keys).groupBy(*lead, "bin", "cy", "cx").agg(F.avg("residual").alias("activity"), F.count("*").alias("hits"))


def _grid(spark, recordings: DataFrame | None, size: Column) -> DataFrame:
    """id from 0 to size - 1, for each row of recordings (whose columns size may name) or once."""
    one = spark.range(1).select() if recordings is None else recordings
    return one.select("*", F.explode(F.sequence(F.lit(0), F.greatest(size, F.lit(1)).cast("long") - 1)).alias("id")).where(F.col("id") < size)


def _number(n: int | str) -> Column:
    return F.col(n) if isinstance(n, str) else F.lit(n)


def dense_cube(cube: DataFrame, bins: int | str, rows: int | str, cols: int | str, recordings: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """The cube with every bin and cell of the grid; cells without vectors have activity 0.

    Of several recordings (``keys``, with one row each in ``recordings``) each has its own grid; its size is
    a number or the name of a column of recordings.
    """
    keys = keys or []
    bins, rows, cols = _number(bins), _number(rows), _number(cols)
    cell = (F.col("id") % (rows * cols)).cast("long")
    grid = _grid(cube.sparkSession, recordings, bins * rows * cols).select(*keys, F.floor(F.col("id") / (rows * cols)).cast("int").alias("bin"), F.floor(cell / cols).cast("int").alias("cy"), (cell % cols).cast("int").alias("cx"))
    return grid.join(cube, [*keys, "bin", "cy", "cx"], "left").select(*keys, "bin", "cy", "cx", F.coalesce("activity", F.lit(0.0)).alias("activity"), F.coalesce("hits", F.lit(0)).alias("hits"))


def bin_coverage(motion: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per (keys and) bin: frames with vectors, and the mean over frames of their median motion."""
    keys = keys or []
    frames = motion.groupBy(*keys, "bin", "frame").agg(F.percentile("motion_x", F.lit(0.5)).alias("x"), F.percentile("motion_y", F.lit(0.5)).alias("y"))
    return frames.groupBy(*keys, "bin").agg(F.count("*").alias("coverage"), F.avg("x").alias("gmv_x"), F.avg("y").alias("gmv_y"))


def heatmap(cube: DataFrame, bins: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Mean activity of each cell over (the first ``bins``) bins of a dense cube, with its recording's display ceiling."""
    keys = keys or []
    if bins is not None:
        cube = cube.where(F.col("bin") < bins)
    cells = cube.groupBy(*keys, "cy", "cx").agg(F.avg("activity").alias("activity"))
    top = cells.groupBy(*keys).agg(F.percentile("activity", F.lit(0.995)).alias("p"), F.max("activity").alias("m"))  # one row for each recording
    ceiling = top.select(*keys, F.when(F.col("p") > 0, F.col("p")).when(F.col("m") > 0, F.col("m")).otherwise(1.0).alias("vmax"))
    return cells.join(ceiling, keys) if keys else cells.join(F.broadcast(ceiling), F.lit(True))


def seat_series(cube: DataFrame, seat_cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean activity of each seat's cells per bin; a cell of two seats counts for both."""
    keys = keys or []
    return cube.join(seat_cells, [*keys, "cy", "cx"]).groupBy(*keys, "seat_id", "bin").agg(F.avg("activity").alias("activity"))


def dense_series(sparse: DataFrame, seats: int | str, bins: int | str, recordings: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys,) seat_id x bin with activity 0 where a bin has none; seats are 0 to seats - 1.  Numbers as in dense_cube."""
    keys = keys or []
    seats, bins = _number(seats), _number(bins)
    grid = _grid(sparse.sparkSession, recordings, seats * bins).select(*keys, F.floor(F.col("id") / bins).cast("int").alias("seat_id"), (F.col("id") % bins).cast("int").alias("bin"))
    return grid.join(sparse, [*keys, "seat_id", "bin"], "left").select(*keys, "seat_id", "bin", F.coalesce("activity", F.lit(0.0)).alias("activity"))
