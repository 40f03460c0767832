"""A web archive that stores equal payloads once.

``write_archive`` makes two tables in one folder: ``payloads`` holds each distinct payload under
its SHA-256, ``headers`` the exact header bytes of every record (WARC header block and HTTP
header block) with the address of its payload. ``read_records`` joins them back to whole WARC
records, after checking each stored payload against its address. Of records with equal payloads
the one with the largest page id is the response, the others are revisits that refer to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recollect.sources.tables import stage

# The record layout of WARC 1.1, with the revisit profile for equal payloads.
CRLF = "\r\n"
END = "\r\n\r\n"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:recollect:page:"
HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CAPTURED_AT = "2024-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits are 8 groups of 20."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), HEX32, BASE32)


def record_urn(page_id: Column, uid: Column) -> Column:
    """<urn:...:page id:row number>; the page id is empty where it is NULL."""
    return F.concat(
        F.lit(f"<{RECORD_URN}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), uid.cast("string"), F.lit(">")
    )


def _line(name: str, value: Column) -> Column:
    """One header line; nothing where the value is NULL. Line breaks in values are escaped."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    captured_at: str = CAPTURED_AT,
) -> None:
    """Write one record for each row of ``pages`` to ``path``/payloads and ``path``/headers.

    A NULL body is an empty payload; a NULL URL leaves its header line out; a NULL page id is
    less than any other. Repeated rows are records of their own: one of them at most is the
    response. Other columns are ignored. An empty table gives an archive without records.
    """
    body = F.coalesce(F.col(f"`{body_col}`"), F.lit("")).cast("binary")
    captures = stage(
        pages.select(
            F.monotonically_increasing_id().alias("uid"),
            F.col(f"`{id_col}`").cast("long").alias("page_id"),
            F.col(f"`{url_col}`").cast("string").alias("url"),
            F.sha2(body, 256).alias("address"),
            base32_sha1(body).alias("digest"),
            F.octet_length(body).cast("long").alias("bytes"),
        ),
        "captures",
    )
    (
        pages.select(F.sha2(body, 256).alias("address"), body.alias("payload"))
        .groupBy("address")
        .agg(
            F.first("payload").alias("payload"),
            (F.min(F.xxhash64("payload")) == F.max(F.xxhash64("payload"))).alias("agrees"),
        )
        .select("address", "payload", F.assert_true("agrees", F.lit("one address, two payloads")).alias("_ok"))
        .drop("_ok")
        .write.parquet(f"{path}/payloads")
    )
    # The largest page id of each payload; among equal ids, any one row.
    known = F.coalesce("page_id", F.lit(-(2**63)))
    responses = captures.groupBy("address").agg(F.max_by("uid", known).alias("to_uid"), F.max("page_id").alias("to_page"))
    records = captures.join(responses, "address")
    revisit = F.col("uid") != F.col("to_uid")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + CRLF),
        F.lit("Content-Type: text/html; charset=utf-8" + CRLF),
        _line("Content-Length", F.col("bytes")),
        F.lit(CRLF),
    )
    block_bytes = F.octet_length("http") + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit(VERSION + CRLF),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", record_urn(F.col("page_id"), F.col("uid"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Date", F.lit(captured_at)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, record_urn(F.col("to_page"), F.col("to_uid")))),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF),
        _line("Content-Length", block_bytes),
        F.lit(CRLF),
    )
    (
        records.withColumn("http", http)
        .select("address", F.concat(head, F.col("http")).cast("binary").alias("header"))
        .write.parquet(f"{path}/headers")
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(header BINARY, payload BINARY, digest): every record with its full payload.

    The bytes of the original capture are ``header`` followed by ``payload``; in a revisit the
    header says that the record itself holds none of it. A stored payload that does not fit its
    address, or one that is missing, fails the read.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    checked = payloads.select(
        "address",
        "payload",
        base32_sha1(F.col("payload")).alias("digest"),
        (F.sha2("payload", 256) == F.col("address")).alias("fits"),
    )
    joined = spark.read.parquet(f"{path}/headers").join(checked, "address", "left")
    broken = F.raise_error(F.concat(F.lit("payload is missing or damaged: "), F.col("address")))
    return joined.select(
        "header",
        F.when(F.coalesce("fits", F.lit(False)), F.col("payload")).otherwise(broken.cast("binary")).alias("payload"),
        "digest",
    )


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(header.rlike(rf"\r\n{name}: "), found)


def parse_records(records: DataFrame) -> DataFrame:
    """Fields of records: page_id, url, record_type, refers_to, payload_digest as declared, payload.

    Everything is taken from the header bytes and the payload; ``intact`` says that the declared
    digest and the HTTP length are those of the payload.
    """
    header = F.col("header").cast("string")
    urn = rf"^<{RECORD_URN}(-?[0-9]+):"
    return records.select(
        F.regexp_extract(_field(header, "WARC-Record-ID"), urn, 1).alias("_page"),
        _field(header, "WARC-Target-URI").alias("url"),
        _field(header, "WARC-Type").alias("record_type"),
        F.regexp_extract(_field(header, "WARC-Refers-To"), urn, 1).alias("_refers"),
        F.replace(_field(header, "WARC-Payload-Digest"), F.lit("sha1:"), F.lit("")).alias("payload_digest"),
        _field(F.substring_index(header, END, -2), "Content-Length").cast("long").alias("declared_bytes"),
        "payload",
        "digest",
    ).select(
        F.expr("try_cast(_page AS bigint)").alias("page_id"),
        "url",
        "record_type",
        F.expr("try_cast(_refers AS bigint)").alias("refers_to"),
        "payload_digest",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "payload",
        (
            (F.col("payload_digest") == F.col("digest")) & (F.col("declared_bytes") == F.octet_length("payload"))
        ).alias("intact"),
    )
