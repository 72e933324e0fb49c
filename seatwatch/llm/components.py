"""Connected components of an edge table by hash-to-min with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import release, written


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges (a, b), undirected, any sortable type -> (node, root): the smallest node of each component.

    Self-edges name lone nodes; null ends are left out.  Each round takes the
    smallest label among the neighbours, then follows labels to their own
    labels, so that distances halve; a round's labels are a written table, which
    goes when the next one is written.
    Hub nodes: sums are combined before the shuffle and the joins are plain
    inner or left joins, whose large partitions adaptive execution splits.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = written(lower.join(jump, "root", "left").select("node", "was", F.least("root", "next").alias("root")))
        moved = not new.where(F.col("was") != F.col("root")).isEmpty()
        release(edges.sparkSession, labels)  # all that was read of it is in the new table
        labels = new.select("node", "root")
        if not moved:
            release(edges.sparkSession, both)
            return labels
    raise RuntimeError(f"components still changed after {rounds} rounds")
