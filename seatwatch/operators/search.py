"""Text search over events by an index of character trigrams, verified by the scan's own condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.review import detector_text, hms, label_text, place_text
from .review import event_search

GRAM, SLOTS = 3, 64


def searched_texts() -> list[Column]:
    """The display texts that a search looks at, in lower case."""
    return [hms(F.col("start_sec")), *(F.lower(c) for c in (place_text(F.col("seat_id"), F.lit(None).cast("string")), label_text(F.col("action_label")), detector_text(F.col("detector_class")), F.coalesce("rule", F.lit(""))))]


def grams(text: Column) -> Column:
    return F.when(F.length(text) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substring(text, i, GRAM))).otherwise(F.array().cast("array<string>"))


def slot_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLOTS)).cast("int")


def _all_texts(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.select(*keys, F.explode(F.array_distinct(F.array_compact(F.array(*searched_texts())))).alias("text"))


def write_search_index(events: DataFrame, folder: str, keys: list[str]) -> None:
    """Postings (gram, text) of the distinct display texts, in SLOTS parts by gram, and the events (keys) of each text, in SLOTS
    parts by text; keys name an event.  Events with a text in common share its postings."""
    every = _all_texts(events, keys)
    every.withColumn("slot", slot_of(F.col("text"))).repartition("slot", F.xxhash64(*keys) % 8).write.mode("overwrite").partitionBy("slot").parquet(f"{folder}/events")
    texts = events.sparkSession.read.parquet(f"{folder}/events").select("text").distinct()
    grammed = texts.select("text", F.explode(F.array_distinct(grams(F.col("text")))).alias("gram"))
    grammed.withColumn("slot", slot_of(F.col("gram"))).repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(f"{folder}/grams")


def indexed_search(spark: SparkSession, folder: str, events: DataFrame, needle: str, keys: list[str]) -> DataFrame:
    """What event_search gives.  Only events with a text that holds every trigram of the needle are looked at; a needle of
    under three characters has none, so all are scanned."""
    low = needle.strip().lower()
    parts = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not parts:
        return event_search(events, needle)
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, parts))).alias("gram")).select("gram", slot_of(F.col("gram")).alias("slot")).collect()
    postings = spark.read.parquet(f"{folder}/grams").where(F.col("slot").isin(sorted({r["slot"] for r in asked})) & F.col("gram").isin(parts))
    able = postings.groupBy("text").agg(F.count("*").alias("_n")).where((F.col("_n") == len(parts)) & F.contains("text", F.lit(low))).select("text", slot_of(F.col("text")).alias("slot"))
    held = spark.read.parquet(f"{folder}/events").join(able, ["slot", "text"], "left_semi").select(*keys)
    return event_search(events.join(held, keys, "left_semi"), needle)
