"""Media columns: interleaved document sequences.

HTML becomes an ordered sequence of text and media-reference structs; references
name payloads by digest and are resolved by joins on it, with position and caption
kept beside them.  Payloads live once written in a store (digest, media) in the
form of 8-bit greyscale images (binary PGM, 24 samples a row), which hold any bytes
losslessly.

Of a video or audio element, its own source and those within are references; its other
content, and whatever is hidden, is left out.

A null text is empty.  References whose digest the store lacks keep their place,
with null media columns.  Repeated rows give repeated sequences.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_layout import BLOCK, UNSEEN, build, hiding
from .tables import arrow_rows, shared_folder, written

ROW = 24
UNIT = 576  #: bytes that a payload is padded to a multiple of; whole rows
PAD = 255  #: never a byte of UTF-8
REFERENCE = "sha256:"
MEDIA = frozenset("img video audio source embed iframe".split())

ITEM = "struct<position:int, kind:string, text:string, digest:string, source:string, caption:string>"


def sequence_of(html: str | None) -> list[dict]:
    """The ordered items of a document: runs of text between block edges, and media references.

    A reference's caption is the figcaption of its figure, or else its alt text.
    """
    items: list[dict] = []
    text: list[str] = []
    unseen = [(False, False)]  #: of each open element: whether its text, and its media, are not visible
    figure: list[int] = []  #: first item of each open figure
    caption: list[str] | None = None

    def flush():
        body = " ".join("".join(text).split())
        if body:
            items.append({"position": len(items), "kind": "text", "text": body, "digest": None, "source": None, "caption": None})
        text.clear()

    for kind, value, attrs in build(html or ""):
        if kind == "text":
            if not unseen[-1][0]:
                (text if caption is None else caption).append(value)
        elif kind == "open":
            gone = "hidden" in attrs or hiding(attrs.get("style", ""))[0] == "none" or (value in UNSEEN and value not in MEDIA)
            inside = (unseen[-1][0] or gone or value in MEDIA, unseen[-1][1] or gone)  # what stands in a media element is for readers without it
            unseen.append(inside)
            if value in MEDIA and not inside[1] and (src := attrs.get("src")):
                flush()
                digest = src[len(REFERENCE) :] if src.startswith(REFERENCE) else None
                items.append({"position": len(items), "kind": "media", "text": None, "digest": digest, "source": src, "caption": attrs.get("alt")})
            if inside[1]:
                continue
            if value == "figure":
                flush()
                figure.append(len(items))
            elif value == "figcaption" and figure:
                flush()
                caption = []
            elif value in BLOCK or value == "br":
                flush()
        else:
            if unseen.pop()[1]:
                continue
            if value == "figcaption" and caption is not None:
                told = " ".join("".join(caption).split())
                caption = None
                for item in items[figure[-1] if figure else len(items) :]:
                    if item["kind"] == "media":
                        item["caption"] = told
            elif value in BLOCK:
                if value == "figure" and figure:
                    figure.pop()
                flush()
    flush()
    return items


def interleaved(html: Column) -> Column:
    """array of items (see ITEM) of an HTML column."""

    @F.arrow_udf(f"array<{ITEM}>")
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fields = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("source", pa.string()), ("caption", pa.string())])
        for batch in batches:
            yield pa.array([sequence_of(x.as_py()) for x in batch], pa.list_(fields))

    return parse(html)


def as_image(payload: Column) -> Column:
    """The payload, padded to a positive multiple of UNIT bytes, as a binary PGM file."""
    units = F.greatest(F.ceil(F.length(payload) / UNIT), F.lit(1)).cast("int")
    padded = F.rpad(payload, units * UNIT, F.lit(bytes([PAD])))
    header = F.concat(F.lit(f"P5\n{ROW} "), (units * (UNIT // ROW)).cast("string"), F.lit("\n255\n")).cast("binary")
    return F.concat(header, padded)


def image_samples(media: bytes) -> bytes:
    """The samples of a binary PGM file of one byte each."""
    m = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", media)
    if not m or len(media) - m.end() != int(m[1]) * int(m[2]):
        raise ValueError("not an 8-bit PGM image")
    return media[m.end() :]


def features(samples: bytes) -> str:
    """Mean, deviation, a histogram of 16 levels and a 64-bit gradient hash of the samples as an image."""
    x = np.frombuffer(samples, np.uint8)
    bins = np.bincount(x >> 4, minlength=16) * 10000 // len(x)
    rows = x.reshape(-1, ROW)
    cut = np.linspace(0, len(rows), 9).astype(int)
    grid = np.add.reduceat(np.add.reduceat(rows.astype(np.int64), cut[:-1], 0), np.linspace(0, ROW, 10).astype(int)[:-1], 1)
    gradient = np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()
    return f"mean={x.mean():.4f};dev={x.std():.4f};hist={','.join(map(str, bins.tolist()))};grad={gradient}"


def write_store(media: DataFrame, folder: str) -> None:
    """media (media binary) -> the store (digest, media).  Copies are stored where they are met, without a
    shuffle of payloads; readers take one of each digest."""
    media.select(F.sha2("media", 256).alias("digest"), "media").write.option("compression", "zstd").parquet(folder)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each digest: digest, n_bytes (without padding), payload_bytes, payload_sha256, tail_crc32
    (of the last 32), media_bytes, media_sha256, feature; all from the bytes as read."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column("digest").to_pylist(), batch.column("media")):
                media = media.as_py()
                own = hashlib.sha256(media).hexdigest()
                if own != digest:
                    raise ValueError(f"stored media do not match their digest {digest}")
                p = image_samples(media)
                rows.append((digest, len(p.rstrip(bytes([PAD]))), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), own, features(p)))
            names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names) if rows else pa.RecordBatch.from_pylist([], pa.schema([(n, pa.string() if n in ("digest", "payload_sha256", "media_sha256", "feature") else pa.int64()) for n in names]))

    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    with arrow_rows(spark, 256):
        return written(spark.read.parquet(folder).mapInArrow(look, schema).dropDuplicates(["digest"]))


def resolve(sequences: DataFrame, store: DataFrame) -> DataFrame:
    """sequences (doc_id, items) -> one row for each item, with the store's columns of its digest (left join:
    text items and unknown digests have nulls)."""
    items = sequences.select("doc_id", F.explode("items").alias("item")).select("doc_id", "item.*")
    return items.join(store, "digest", "left")


def _escaped(text: Column) -> Column:
    for plain, written_as in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(written_as))
    return text


def text_media(docs: DataFrame) -> DataFrame:
    """Every text as a document of its paragraphs (lines) and then a figure of the whole text with a caption,
    stored, read back and resolved: doc_id, position (how many paragraphs with words come before it), caption and
    the columns of read_store."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    image = as_image(text.cast("binary"))
    folder = f"{shared_folder(spark)}/media"
    write_store(docs.select(image.alias("media")), folder)
    body = F.concat(F.lit("<p>"), F.replace(_escaped(text), F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    figure = F.concat(F.lit(f'<figure><img src="{REFERENCE}'), F.sha2(image, 256), F.lit('"><figcaption>Text of document '), _escaped(F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))), F.lit("</figcaption></figure>"))
    sequences = docs.select("doc_id", interleaved(F.concat(body, figure)).alias("items"))
    sequences = sequences.select("doc_id", F.filter("items", lambda i: i["kind"] == "media").alias("items"))
    return resolve(sequences, read_store(spark, folder))
