"""Change points, candidates and the review budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..functions.geometry import salience


def change_points(x: np.ndarray, penalty: float, min_size: int = 2) -> list[int]:
    """Interior breaks of the optimal partition under squared error plus ``penalty`` a break.

    Dynamic programming with pruning of starts that can no longer win: a start that loses
    to a break at some end loses to it at all ends from min_size on.  Of equal
    costs (to six decimals) the lowest start is kept.  Series of under 8 values have no breaks.
    """
    n = len(x)
    if n < 8:
        return []
    s1 = np.concatenate([[0], np.cumsum(x, dtype=float)])
    s2 = np.concatenate([[0], np.cumsum(np.square(x, dtype=float))])
    best = np.full(n + 1, np.inf)
    best[0] = -penalty
    back = np.zeros(n + 1, int)
    starts, lost = np.array([0]), np.full(n + 1, n + 1)
    for end in range(min_size, n + 1):
        ok = starts[end - starts >= min_size]
        length = end - ok
        total = best[ok] + (s2[end] - s2[ok]) - (s1[end] - s1[ok]) ** 2 / length
        k = int(np.argmin(np.round(total, 6)))
        best[end], back[end] = total[k] + penalty, ok[k]
        lost[ok] = np.minimum(lost[ok], np.where(total <= best[end] + 1e-5, n + 1, end))
        starts = starts[end + 1 - lost[starts] < min_size]
        if np.isfinite(best[end]):
            starts = np.append(starts, end)
    breaks, at = [], n
    while at > 0:
        at = int(back[at])
        if at > 0:
            breaks.append(at)
    return breaks[::-1]


def segments(scores: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """(keys, segment, i0, i1): half-open runs of bins between change points of z; one group for each seat."""
    keys = keys or ["seat_id"]

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        first = int(pdf["bin"].iloc[0])
        edges = np.array([0, *change_points(pdf["z"].to_numpy(), p.pelt_penalty), len(pdf)])
        out = pd.DataFrame({k: pdf[k].iloc[0] for k in keys}, index=range(len(edges) - 1))
        out["segment"], out["i0"], out["i1"] = range(len(out)), edges[:-1] + first, edges[1:] + first
        return out

    types = dict(scores.dtypes)
    return scores.select(*keys, "bin", "z").groupBy(*keys).applyInPandas(cut, ", ".join(f"{k} {types[k]}" for k in keys) + ", segment int, i0 int, i1 int")


def measure_segments(scores: DataFrame, cuts: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None, start_s: float = 0.0) -> DataFrame:
    """Segments with start_sec, end_sec (bin edges), peak_z, mean_z and duration_s."""
    keys = keys or ["seat_id"]
    bins = cuts.select(*keys, "segment", "i0", "i1", F.explode(F.sequence(F.col("i0"), F.col("i1") - 1)).alias("bin"))
    out = bins.join(scores.select(*keys, "bin", "z"), [*keys, "bin"]).groupBy(*keys, "segment", "i0", "i1").agg(F.max("z").alias("peak_z"), F.avg("z").alias("mean_z"))
    edge = lambda c: F.col(c) * p.bin_s + start_s
    return out.select(*keys, "segment", "i0", "i1", edge("i0").alias("start_sec"), edge("i1").alias("end_sec"), "peak_z", "mean_z", ((F.col("i1") - F.col("i0")) * p.bin_s).alias("duration_s"))


def candidates(scores: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """Segments long and strong enough to be shown, with their salience."""
    found = measure_segments(scores, segments(scores, p, keys), p, keys)
    found = found.where((F.col("duration_s") >= p.min_event_s) & (F.col("mean_z") >= p.z_threshold)).drop("segment")
    return found.withColumn("salience", salience(F.col("mean_z"), F.col("duration_s")))


def runs_over(scores: DataFrame, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """Maximal runs of consecutive bins with z over the threshold, measured like segments."""
    keys = keys or ["seat_id"]
    w = Window.partitionBy(*keys).orderBy("bin")
    hot = scores.where(F.col("z") > p.z_threshold).withColumn("_run", F.col("bin") - F.row_number().over(w))
    out = hot.groupBy(*keys, "_run").agg(F.min("bin").alias("i0"), (F.max("bin") + 1).alias("i1"), F.max("z").alias("peak_z"), F.avg("z").alias("mean_z"))
    out = out.withColumn("duration_s", (F.col("i1") - F.col("i0")) * p.bin_s)
    return out.select(*keys, "i0", "i1", "peak_z", "mean_z", "duration_s", salience(F.col("mean_z"), F.col("duration_s")).alias("salience"))


def ranked(found: DataFrame, order: list[Column] | None = None, keys: list[str] | None = None) -> DataFrame:
    """found with ``rank`` by falling salience, then seat and first bin."""
    by = order or [F.round("salience", 9).desc(), F.col("seat_id"), F.col("i0")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*(keys or [])).orderBy(*by)))


def numbered(rows: DataFrame, order: list[Column], name: str, folder: str) -> DataFrame:
    """rows with ``name``: their place in the order of the whole, from 1, without bringing them together.

    Rows are written in order, range by range, below ``folder``; a row's place is its place within its range after the
    sizes of the ranges before (one number each).  The order must tell all rows apart.
    """
    spark = rows.sparkSession
    rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).write.parquet(folder)
    kept = spark.read.parquet(folder)
    sizes = kept.groupBy("_part").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("_part", "n")).alias("_sizes"))  # one row
    local = kept.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    before = F.aggregate(F.filter("_sizes", lambda s: s["_part"] < F.col("_part")), F.lit(0).cast("long"), lambda acc, s: acc + s["n"])
    return local.join(F.broadcast(sizes), F.lit(True)).withColumn(name, before + F.col("_n")).select(*rows.columns, name)


def top_fraction(found: DataFrame, share: float, keys: list[str] | None = None) -> DataFrame:
    """The most salient share of the candidates of each recording, at least one."""
    total = F.count("*").over(Window.partitionBy(*(keys or [])))
    return ranked(found, keys=keys).withColumn("_k", F.greatest(F.lit(1), F.bround(total * share))).where(F.col("rank") <= F.col("_k")).drop("_k")


def budget_shortlist(found: DataFrame, seat_seconds: float, p: Params = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """Candidates by salience while their summed duration fits the budget of each recording.

    The first is always taken; one that would overflow is skipped; taking ends once the budget is spent.
    The walk is a fold over one array of (rank, duration) for each recording.
    """
    keys = keys or []
    budget = seat_seconds * p.budget
    order = ranked(found, keys=keys)
    walk = F.array_sort(F.collect_list(F.struct("rank", "duration_s")))

    def step(acc, c):
        fits = (acc["spent"] < budget) & ((F.size(acc["taken"]) == 0) | (acc["spent"] + c["duration_s"] <= budget))
        return F.when(fits, F.struct((acc["spent"] + c["duration_s"]).alias("spent"), F.concat(acc["taken"], F.array(c["rank"])).alias("taken"))).otherwise(acc)

    empty = F.struct(F.lit(0.0).alias("spent"), F.array().cast("array<int>").alias("taken"))
    taken = order.groupBy(*keys).agg(walk.alias("_w")).select(*keys, F.explode(F.aggregate("_w", empty, step, lambda a: a["taken"])).alias("rank"))
    return order.join(taken, [*keys, "rank"])
