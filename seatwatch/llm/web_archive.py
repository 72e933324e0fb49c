"""WARC as a content-addressed archive; DataFrame operations only.

An archive is two tables in one folder: ``payloads`` (digest, payload) holds each
distinct payload once, ``records`` (record_id, digest, header, http_header, ...)
the exact header bytes of every record.  Joined on the digest they give back each
record byte for byte.  Digests are SHA-256, taken of the bytes that are stored and
verified against those that are read.

Of records with equal payloads of at least ``least`` bytes the one with the
smallest id is the response, the others are revisits of it; smaller payloads are
always responses.  Records that repeat an id and payload are alike: all of them
are responses if that id is the smallest.  Null html is an empty payload; null ids
are never referred to.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEWLINE = "\r\n"


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-record:"), F.coalesce(F.url_encode(record_id.cast("string")), F.lit("none")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(NEWLINE))


def write_archive(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", least: int = 100) -> None:
    """Writes one record for each row of pages (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", F.sha2(payload, 256).alias("digest"), payload.alias("payload"))
    # copies meet before the shuffle: a group of them sends one payload from each task
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{folder}/payloads")
    narrow = rows.select("page_id", "url", "digest", F.length("payload").cast("long").alias("size"))
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("response"))
    r = narrow.join(first, "digest")
    revisit = (F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("response"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NEWLINE}Content-Type: text/html; charset=utf-8{NEWLINE}Content-Length: "), F.col("size").cast("string"), F.lit(NEWLINE * 2))
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7f]", "%20")
    header = F.concat(
        F.lit(VERSION + NEWLINE),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Target-URI", uri),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _urn(F.col("response"))), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.length(http) + F.when(revisit, 0).otherwise(F.col("size"))).cast("string")),
        F.lit(NEWLINE),
    )
    records = r.select(F.col("page_id").alias("record_id"), "digest", header.cast("binary").alias("header"), http.cast("binary").alias("http_header"))
    records.write.option("compression", "zstd").parquet(f"{folder}/records")


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r]*)\r\n", 1)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, record_type, refers_to (null but for revisits), url, digest, header, http_header, payload
    (full, also for revisits), payload_digest and payload_bytes (of the payload as read).

    Raises where a stored payload does not have the digest it is stored under.  A reader that does not
    select the payload joins narrow rows only.
    """
    return _records(spark, folder).join(_payloads(spark, folder), "digest")


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    actual = F.sha2("payload", 256)
    checked = F.when(actual == F.col("digest"), actual).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))).cast("string"))
    return spark.read.parquet(f"{folder}/payloads").select("digest", "payload", checked.alias("payload_digest"), F.length("payload").cast("long").alias("payload_bytes"))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    records = spark.read.parquet(f"{folder}/records")
    kind = dict(records.dtypes)["record_id"]
    refers = F.regexp_extract(_field("WARC-Refers-To"), "^<urn:x-record:(.*)>$", 1)
    return records.select("record_id", _field("WARC-Type").alias("record_type"), F.when(refers != "", F.url_decode(refers)).cast(kind).alias("refers_to"), _field("WARC-Target-URI").alias("url"), F.substring_index(_field("WARC-Payload-Digest"), ":", -1).alias("digest"), "header", "http_header")


def _record() -> Column:
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return F.concat("header", "http_header", body, F.lit((NEWLINE * 2).encode()))


def reconstruct(archive: DataFrame) -> DataFrame:
    """record_id, record (the record's exact bytes as in a WARC file)."""
    return archive.select("record_id", _record().alias("record"))


def verified_records(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, record_type, refers_to, payload_bytes, payload_digest, record_bytes for every record of an archive,
    from its reconstructed bytes.

    A response's payload is cut out of its record by the lengths that its own headers state and hashed again;
    a revisit's is that of the payload it names.  Raises where lengths or digests do not agree.  Payloads go
    to their responses only, so a group of revisits moves narrow rows.
    """
    records, stored = _records(spark, folder), _payloads(spark, folder)
    whole = records.where(F.col("record_type") == "response").join(stored, "digest").withColumn("record", _record())
    at = F.length("header") + F.length("http_header")
    size = F.regexp_extract(F.col("http_header").cast("string"), r"Content-Length: (\d+)", 1).cast("int")
    payload = F.substring("record", at + 1, size)
    told = F.regexp_extract(F.col("header").cast("string"), r"\r\nContent-Length: (\d+)", 1).cast("long")
    right = (F.length("record") == F.length("header") + told + 4) & (F.sha2(payload, 256) == F.col("digest"))
    digest = F.when(right, F.sha2(payload, 256)).otherwise(F.raise_error(F.concat(F.lit("record does not hold the payload of its digest "), F.col("digest"))).cast("string"))
    whole = whole.select("record_id", "record_type", "refers_to", size.cast("long").alias("payload_bytes"), digest.alias("payload_digest"), F.length("record").cast("long").alias("record_bytes"))
    again = records.where(F.col("record_type") == "revisit").join(stored.drop("payload"), "digest")
    again = again.select("record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", (F.length("header") + F.length("http_header") + 4).cast("long").alias("record_bytes"))
    return whole.unionByName(again)


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields, block) of the records of an uncompressed WARC file; for checks of what is written."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(NEWLINE)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"broken record at byte {at}")
        yield fields, block
        at = end + 8 + size
