"""Filter interaction audit: what a chain of document filters removes, in every order of the filters.

1. Each document has a mask: bit i says that it fails filter i.
2. Walsh-Hadamard sums: for each part and label and each set S of filters, the sum over
   documents of +1 or -1 by the parity of the filters of S that they fail (32 sums for
   five filters).  Sums are combined before the shuffle, so a part may hold any share of
   the rows, and what leaves a task is one row for each part and label.
3. The sums are inverted exactly (integers, divided by the number of sets): the number of
   documents of each mask.
4. What any order keeps and removes follows from these counts; so do the Shapley sums,
   in closed form: a document that fails c filters is removed by each of them in
   orders / c of all orders.

A null text counts as an empty one, a null part as ''.  Rows that repeat an id count each;
a null id repeats nothing and has no labels.  Of several labels of an id the worst holds for
toxicity and the best for quality.  No rows, no result.  Other columns play no part.
"""

from __future__ import annotations

import json
import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

WHITESPACE = " \t\n\x0b\x0c\r"


def document_filters(text: Column, words: Column) -> dict[str, Column]:
    """The filters that a text decides alone; ``words`` is its array of words."""
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask int, good, toxic): one row for each document; bit 4 (filter E) says that a smaller id has its text.

    What the texts tell is written once, narrow; copies meet by a 256-bit digest, and only the
    smallest id of a digest that occurs twice is joined back, so groups of copies stay dealt out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim("_text", F.lit(WHITESPACE))
    split = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    split = split.withColumn("_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")))
    mask = F.lit(0)
    for i, fails in enumerate(document_filters(F.col("_text"), F.col("_words")).values()):
        mask = mask + F.when(fails, 1 << i).otherwise(0)
    facts = written(split.select("doc_id", "part", F.unhex(F.sha2("_text", 256)).alias("digest"), mask.alias("mask")))
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where(F.col("_first") < F.col("_last")).drop("_last")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    out = facts.join(first, "digest", "left").join(marks, "doc_id", "left")
    copy = F.when(F.col("doc_id") > F.col("_first"), 16).otherwise(0)
    return out.select("part", (F.col("mask") + copy).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def parity_sums(masks: DataFrame, filters: int) -> DataFrame:
    """(part, label, sums array<long>): for each set S of filters the documents with an even number of
    failures within S less those with an odd one; label is all, good or toxic."""
    labels = F.array_compact(F.array(F.lit("all"), F.when(F.col("good"), "good"), F.when(F.col("toxic"), "toxic")))
    each = masks.select("part", "mask", F.explode(labels).alias("label"))
    signed = [F.sum(1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2)).alias(f"s{s}") for s in range(1 << filters)]
    sums = each.groupBy("part", "label").agg(*signed)
    return sums.select("part", "label", F.array(*(F.col(f"s{s}") for s in range(1 << filters))).alias("sums"))


def mask_counts(sums: DataFrame, filters: int) -> DataFrame:
    """(part, all, good, toxic): arrays with the number of documents of each mask, by the inverse transform."""
    n = 1 << filters
    sets = F.sequence(F.lit(0), F.lit(n - 1))
    sign = lambda s, m: (1 - 2 * (F.bit_count(s.bitwiseAND(m)) % 2)).cast("long")
    one = lambda m: F.aggregate(sets, F.lit(0).cast("long"), lambda acc, s: acc + sign(s, m) * F.get("sums", s))
    cells = sums.select("part", "label", F.transform(sets, lambda m: F.shiftright(one(m), filters)).alias("cells"))  # exact: every sum is a multiple of n
    none = F.array_repeat(F.lit(0).cast("long"), n)
    return cells.groupBy("part").agg(*(F.coalesce(F.first(F.when(F.col("label") == x, F.col("cells")), ignorenulls=True), none).alias(x) for x in ("all", "good", "toxic")))


def audit_orders(counts: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included."""
    masks = F.sequence(F.lit(0), F.lit((1 << len(letters)) - 1))
    steps = []
    for order in permutations(letters):
        before = 0
        for i, x in enumerate(order, 1):
            bit = 1 << letters.index(x)
            steps.append({"filter_order": "".join(order), "step": i, "bit": bit, "before": before})
            before |= bit
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    rows = counts.select("*", F.explode(plan).alias("_s")).select("part", "all", "good", "toxic", "_s.*")
    bit, before = F.col("bit"), F.col("before")
    failing = lambda m: m.bitwiseAND(bit) != 0
    passed = lambda m: m.bitwiseAND(before) == 0

    def total(cells: str, which, weight=lambda m: F.lit(1)) -> Column:
        return F.aggregate(masks, F.lit(0).cast("long"), lambda acc, m: acc + F.when(which(m), F.get(cells, m) * weight(m)).otherwise(0))

    orders = math.factorial(len(letters))
    share = F.array(F.lit(0), *(F.lit(orders // c) for c in range(1, len(letters) + 1)))
    return rows.select(
        "part", "filter_order", "step",
        total("all", lambda m: passed(m) & ~failing(m)).alias("kept"),
        total("all", lambda m: passed(m) & failing(m)).alias("removed"),
        total("all", lambda m: ~passed(m) & failing(m)).alias("redundant"),
        total("all", lambda m: m == bit).alias("unique_fails"),
        total("good", lambda m: passed(m) & failing(m)).alias("good_lost"),
        total("toxic", lambda m: passed(m) & failing(m)).alias("toxic_lost"),
        total("all", failing, lambda m: F.get(share, F.bit_count(m))).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """docs (doc_id, text, part), labels (doc_id, quality, toxic) -> part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley for the filters A to E in every order."""
    sums = parity_sums(failure_masks(docs, labels, part), 5)
    return audit_orders(mask_counts(sums, 5), "ABCDE")
