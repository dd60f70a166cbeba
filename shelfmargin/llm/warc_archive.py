"""A content-addressed WARC archive: payloads once, exact record headers apart.

``write`` lays down two Parquet tables in one folder: ``headers`` with the exact header bytes
of every record, and ``payloads`` with each distinct payload once under its SHA-256 digest.
``read`` joins them by digest and returns whole records, after each stored payload has been
checked against its digest. All steps are built-in expressions.

Of the records with equal payloads of at least ``least`` bytes, that with the largest page id
is a response and the others revisit it; smaller payloads are responses all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmargin.session import new_folder

DATE = "2020-01-01T00:00:00Z"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_ID = "urn:page:"


def base32_sha1(data: Column) -> Column:
    """SHA-1 as 32 upper-case base32 characters: 20 bits, or five hex digits, give four."""
    hexes = F.sha1(data)

    def letters(start: int) -> list[Column]:
        bits = F.conv(F.substring(hexes, start, 5), 16, 10).cast("int")
        return [F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]

    return F.concat(*[letter for k in range(8) for letter in letters(5 * k + 1)])


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null; control characters are percent-coded."""
    clean = value.cast("string")
    for code in (*range(0x20), 0x7F):
        clean = F.replace(clean, F.lit(chr(code)), F.lit(f"%{code:02X}")) if code in (0, 9, 10, 13) else clean
    return F.coalesce(F.concat(F.lit(name + ": "), clean, F.lit("\r\n")), F.lit(""))


def write(pages: DataFrame, folder: str, least: int = 0) -> None:
    """Archive ``page_id, url, html`` of ``pages``: one record per row.

    A null html is an empty payload. Rows that repeat both the id and the payload are responses
    alike and share the stored payload. A null id has no id field; a payload that only null ids
    hold is a response each time. Other columns are ignored. Payloads are folded before the
    shuffle, and hot ones meet their few columns in joins that adaptive execution can split.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    owners = rows.groupBy("digest").agg(
        F.max("page_id").alias("owner"), F.max(F.octet_length("payload")).alias("payload_bytes"),
    )
    rows.groupBy("digest").agg(F.any_value("payload").alias("payload")).write.parquet(f"{folder}/payloads")
    slim = rows.select("page_id", "url", "digest", base32_sha1(F.col("payload")).alias("sha1"))
    owned = slim.join(owners, "digest")
    revisit = (
        (F.col("payload_bytes") >= least) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    )
    page = F.concat(F.lit(_ID), F.col("page_id").cast("string"))
    target = F.concat(F.lit(_ID), F.col("owner").cast("string"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", F.concat(F.lit("<"), page, F.lit(">"))),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _field("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), target, F.lit(">")))),
        _field("Content-Type", F.lit("text/html")),
        _field("Content-Length", F.when(revisit, 0).otherwise(F.col("payload_bytes"))),
        F.lit("\r\n"),
    )
    owned.select("digest", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{folder}/headers")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload, payload_digest, record``.

    ``payload`` is the full page for revisits too; ``record`` has the exact bytes of the record,
    a revisit's without payload. A stored payload that does not fit its digest fails the job.
    """
    checked = spark.read.parquet(f"{folder}/payloads").withColumn(
        "payload",
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
            F.raise_error(F.concat(F.lit("damaged payload "), "digest"))
        ),
    )
    headers = spark.read.parquet(f"{folder}/headers")
    lines = F.decode("header", "UTF-8")

    def field(name: str, pattern: str = "([^\r\n]*)") -> Column:
        value = F.regexp_extract(lines, f"\r\n{name}: {pattern}\r\n", 1)
        return F.when(value != "", value)

    record_type = field("WARC-Type")
    body = F.when(record_type == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return headers.join(checked, "digest").select(
        field("WARC-Record-ID", f"<{_ID}(-?\\d+)>").cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        record_type.alias("record_type"),
        field("WARC-Refers-To", f"<{_ID}(-?\\d+)>").cast("long").alias("refers_to"),
        "payload",
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]*)").alias("payload_digest"),
        F.concat("header", body, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"),
    )


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Every page's record, written to an archive in the shared folder and read back."""
    folder = new_folder(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(spark, folder).select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )


OP7_SQL = f"""
WITH paged AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), owned AS (
    SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS owner FROM paged
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}',
        ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM owned
"""
