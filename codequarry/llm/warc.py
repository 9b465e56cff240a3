"""Content-addressed WARC archive: payload bytes once, record headers apart.

An archive is two Parquet tables in one folder.  ``payloads`` (digest, payload) holds each distinct
payload once, named by its SHA-256.  ``records`` (digest, headers) holds a record's exact header
block and the name of its payload.  A record is its headers, the payload and two line ends; the
two tables joined on the digest give every original record back.

Rows: NULL html is the empty payload, a NULL url gives no target header, and a line end in a url is
written in percent form.  Rows that repeat are records of their own, told apart by a number; of
records with equal payloads the first by page_id, NULL last, then url and number is the response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.session import scratch_path

REVISIT_BYTES = 100  # smaller payloads are stored with every record
END = "\r\n"


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit(END)))


def _name(page: Column, number: Column) -> Column:
    """A record's id: a URN with the page and, for repeated rows, a number."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), number.cast("string"), F.lit(">"))


def records(pages: DataFrame, least: int = REVISIT_BYTES, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """(digest, headers) of a record per row of pages (page_id, url, html).

    Only ids, urls and digests are shuffled.  Equal rows are counted before and numbered after the
    shuffle; the first record of a digest is a plain minimum, so a payload that a third of all
    pages share is reduced in the tasks that read them.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", F.sha2(payload, 256).alias("digest"), F.length(payload).cast("bigint").alias("bytes"))
    counted = rows.groupBy("page_id", "url", "digest", "bytes").agg(F.count(F.lit(1)).alias("rows"))
    # one number series per page_id, so that ids of records differ even where ids of pages repeat
    salted = F.concat_ws(".", F.substring(F.sha2(F.concat_ws("|", F.coalesce("url", F.lit("")), "digest"), 256), 1, 16))
    each = counted.withColumn("number", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).withColumn(
        "number", F.concat_ws("-", salted, F.col("number").cast("string"))
    )
    place = F.struct(F.col("page_id").isNull(), "page_id", "url", "number")
    first = counted.where(F.col("bytes") >= least).groupBy(F.col("digest").alias("same")).agg(
        F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url", F.concat_ws("-", salted, F.lit("1")).alias("number"))).alias("first")
    )
    joined = each.join(first, (F.col("digest") == F.col("same")) & (F.col("bytes") >= least), "left")
    revisit = F.col("first").isNotNull() & ~place.eqNullSafe(F.struct("first.last", "first.page_id", "first.url", "first.number"))
    headers = F.concat(
        F.lit("WARC/1.1" + END),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", _name(F.col("page_id"), F.col("number"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _header("WARC-Refers-To", F.when(revisit, _name(F.col("first.page_id"), F.col("first.number")))),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit(END),
    )
    return joined.select("digest", headers.cast("binary").alias("headers"))


def payloads(pages: DataFrame) -> DataFrame:
    """(digest, payload) of each distinct payload; equal ones are reduced before the shuffle."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    named = pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload"))
    return named.groupBy("digest").agg(F.first("payload").alias("payload"))


def write_archive(pages: DataFrame, folder: str | None = None, least: int = REVISIT_BYTES) -> str:
    """Write the archive of ``pages``; returns its folder."""
    folder = folder or scratch_path(pages.sparkSession, "archive")
    payloads(pages).write.option("compression", "zstd").parquet(f"{folder}/payloads")
    records(pages, least).write.option("compression", "zstd").parquet(f"{folder}/records")
    return folder


def verified_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, payload) as stored; a payload that no longer has its digest stops the job."""
    stored = spark.read.parquet(f"{folder}/payloads")
    damaged = F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(damaged.cast("binary"))
    return stored.select("digest", checked.alias("payload"))


def field(headers: Column, name: str) -> Column:
    """The value of a header in a header block, NULL if it has none."""
    value = F.regexp_extract(headers.cast("string"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.nullif(value, F.lit(""))


def _page(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, "^<urn:page:(-?[0-9]+):", 1), F.lit("")).cast("bigint")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record_type, refers_to, url, payload_digest, payload_bytes, headers) from the stored bytes.

    Lengths and digests are taken of each stored payload once and joined to the records by name.
    """
    kept = verified_payloads(spark, folder).select(
        F.col("digest").alias("of"), F.length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    head = F.col("headers")
    rows = spark.read.parquet(f"{folder}/records").join(kept, F.col("digest") == F.col("of"))
    return rows.select(
        _page(field(head, "WARC-Record-ID")).alias("page_id"), field(head, "WARC-Type").alias("record_type"),
        _page(field(head, "WARC-Refers-To")).alias("refers_to"), field(head, "WARC-Target-URI").alias("url"),
        "payload_digest", "payload_bytes", "headers",
    )


def reconstruct(spark: SparkSession, folder: str, full: bool = False) -> DataFrame:
    """(page_id, record) with each record's exact bytes.

    A revisit's record ends after its headers; ``full`` adds the payload there too, as a reader
    that follows the reference would see it.
    """
    rows = spark.read.parquet(f"{folder}/records").join(verified_payloads(spark, folder), "digest")
    body = F.col("payload")
    if not full:
        body = F.when(field(F.col("headers"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(body)
    record = F.concat(F.col("headers"), body, F.lit(b"\r\n\r\n"))
    return rows.select(_page(field(F.col("headers"), "WARC-Record-ID")).alias("page_id"), record.alias("record"))
