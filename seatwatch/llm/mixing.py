"""Mixing sources to target weights by capped water-filling; DataFrame operations only.

Targets: each source gets its weight's share of the budget; a source above
``max_epochs`` times its size is clamped there and its excess is shared among the
others by weight, until none is above.  With sources in order of cap / weight
that end point is found from running sums: the first source whose share of what
the clamped ones before it leave lies within its cap.

Taking: a source whose target is r times its size takes every document floor(r)
times, and of one more seeded random order of its documents the beginning, up to
the rounded target; the document at the cut is taken in part.  The order is by
md5 of id and seed.  The cut is found by radix: sizes are summed by the first
three hex digits, then by the next three, and only the keys that share all six
with the cut are ordered, so no task holds a source.  Rows of one key and size
(rows without an id, or that repeat one) are counted, not ordered: at the cut each
takes an equal part, rounded down.

Null ids sort as the empty text; a null source is a source, after all others;
null texts have size 0.  A source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

WORDS = r"[^\x20\x09-\x0D]+"


def cyclic_weights(docs: DataFrame, weights: list[float]) -> DataFrame:
    """(source, weight): the sources by code point, null last, weigh as in ``weights``, repeated."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    ranked = docs.select("source").distinct().withColumn("_n", F.row_number().over(order))
    return ranked.select("source", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).alias("weight"))


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """(source, weight, source_size) -> the same and target; the targets sum to ``share`` of all sizes,
    or to all caps if those are less."""
    one = Window.partitionBy()  # one row for each source
    by = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    s = sources.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    s = s.withColumn("_budget", F.sum("source_size").over(one) * F.lit(float(share)))
    s = s.withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)).withColumn("_n", F.row_number().over(by))
    s = s.withColumn("_level", F.min_by("_level", F.when(F.col("_level") <= F.col("_ratio"), F.col("_n"))).over(one))
    # min_by leaves out rows that are not feasible (null order); none is where all caps are reached
    return s.select("source", "weight", "source_size", F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("weight")), F.col("_cap")).alias("target"))


def _cut(sums: DataFrame, goal: Column, digits: str) -> DataFrame:
    """(source, digits, goal, _size) -> _before: what comes before the digits' run."""
    run = Window.partitionBy("source").orderBy(digits).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("_before", F.coalesce(F.sum("_size").over(run), F.lit(0)).cast("long")).withColumn("_goal", goal)


def _same(left: DataFrame, right: DataFrame, digits: str) -> DataFrame:
    r = right.withColumnRenamed("source", "_s").withColumnRenamed(digits, "_d")
    return left.join(r, left["source"].eqNullSafe(r["_s"]) & (left[digits] == r["_d"])).drop("_s", "_d")


def mix_sources(docs: DataFrame, weights: DataFrame, share: float = 1.5, max_epochs: float = 2.0, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target (of the document's source), taken (words, repeats counted),
    one row for each row of docs (doc_id, text, source).  weights (source, weight > 0) has every source once."""
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary"))
    sized = written(sized.withColumn("_key", key).withColumn("_d1", F.substring("_key", 1, 3)).withColumn("_d2", F.substring("_key", 4, 3)))
    first = sized.groupBy("source", "_d1").agg(F.sum("size").alias("_size"))
    totals = first.groupBy("source").agg(F.sum("_size").alias("source_size"))
    w = weights.select(F.col("source").alias("_s"), "weight")
    targets = water_fill(totals.join(w, totals["source"].eqNullSafe(w["_s"])).drop("_s"), share, max_epochs)
    targets = targets.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = targets.select(F.col("source").alias("_t"), "source_size", "target", "_whole", (F.floor(F.col("target") + 0.5).cast("long") - F.col("_whole") * F.col("source_size")).alias("_goal"))
    first = first.join(t, first["source"].eqNullSafe(t["_t"])).drop("_t")
    first = _cut(first, F.col("_goal"), "_d1")
    joined = _same(sized, first, "_d1")
    cut = (F.col("_before") < F.col("_goal")) & (F.col("_goal") < F.col("_before") + F.col("_size"))
    plain = joined.where(~cut).withColumn("_extra", F.when(F.col("_before") >= F.col("_goal"), 0).otherwise(F.col("size")))
    at_cut = joined.where(cut).withColumn("_goal", F.col("_goal") - F.col("_before")).drop("_before", "_size")
    second = _cut(at_cut.groupBy("source", "_d2").agg(F.sum("size").alias("_size"), F.first("_goal").alias("_g")), F.col("_g"), "_d2").drop("_g", "_goal")
    finer = _same(at_cut, second, "_d2")
    plain_finer = finer.where(~cut).withColumn("_extra", F.when(F.col("_before") >= F.col("_goal"), 0).otherwise(F.col("size")))
    tied = finer.where(cut)
    keys = tied.groupBy("source", "_key", "size").agg(F.count("*").alias("_rows"), F.first(F.col("_goal") - F.col("_before")).alias("_room"))
    run = Window.partitionBy("source").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("_part", F.floor((F.col("_room") - F.coalesce(F.sum(F.col("size") * F.col("_rows")).over(run), F.lit(0))) / F.col("_rows")).cast("long"))
    keys = keys.select(F.col("source").alias("_s"), F.col("_key").alias("_k"), F.col("size").alias("_z"), "_part")
    last = tied.join(keys, tied["source"].eqNullSafe(keys["_s"]) & (tied["_key"] == keys["_k"]) & (tied["size"] == keys["_z"]))
    last = last.withColumn("_extra", F.least(F.greatest("_part", F.lit(0)), F.col("size")))
    columns = ["doc_id", "size", "source_size", "target", (F.col("_whole") * F.col("size") + F.col("_extra")).cast("long").alias("taken")]
    return plain.select(columns).unionByName(plain_finer.select(columns)).unionByName(last.select(columns))
