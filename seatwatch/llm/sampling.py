"""Bounded, seeded samples of labelled texts for fitting a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, classes: list[int], train=None, seed: int = 17) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` texts of each class, and how many labelled ids each class has.

    docs (doc_id, text, ...); labels (doc_id, <label>, ...).  An id with several
    labels counts once, with the largest; of an id with several texts the smallest
    text is taken; null ids and labels are left out, and so are ids for which
    ``train`` (a column over doc_id) does not hold.  The choice is by hash of the
    id, the same on every run: ids below a threshold that some more than
    ``per_class`` meet, and of these the smallest hashes, so that what meets in one
    task is as large as the sample, whatever the number of partitions.
    """
    ids = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(classes))
    if train is not None:
        ids = ids.where(train)
    ids = ids.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
    sizes = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for k in classes:
        if n := sizes.get(k):
            share = min(1.0, (per_class + 8 * per_class**0.5 + 8) / n)
            below = F.col("_h") <= min(2**63 - 1, int(-(2**63) + share * 2**64))
            part = ids.where((F.col("label") == k) & below).orderBy("_h", "doc_id").limit(per_class)
            chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        chosen = ids.limit(0)
    # per_class * len(classes) ids bound this broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.drop("_h")), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), sizes
