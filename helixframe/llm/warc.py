"""A content-addressed WARC archive.

A payload is stored once, under the SHA-256 of its bytes; a record keeps its exact header bytes and the digest. A record is
put together again by a join of the two tables on the digest. Reading verifies: a payload that is missing, has not the
digest that it is stored under, or not the SHA-1 or the length that the record's own header declares, stops the job. The
archive can also be written as plain WARC files, and such files read back.

Nulls: a null payload is an empty one; a null id sorts below all others and is written `null`. Rows with equal ids and
payloads are records of their own with equal headers. A group of equal payloads that has no id at all has only responses.
An empty table makes an empty archive. A very long payload is one cell, as in the input. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import saved

CRLF = "\r\n"
RECORD_END = "\r\n\r\n"


#: What would break a header line.
_UNFIT = r"[\x00-\x20\x7F]"


def _uri(url: Column) -> Column:
    """Without control characters and spaces; the exact URL goes to a header of its own where there are any."""
    return F.regexp_replace(F.coalesce(url, F.lit("urn:x-none")), _UNFIT, "%20")


@F.pandas_udf(T.BinaryType())
def _pack(payloads: pd.Series) -> pd.Series:
    pack = zstandard.ZstdCompressor(6).compress
    return payloads.map(lambda x: pack(bytes(x)))


@F.pandas_udf(T.BinaryType())
def _unpack(packed: pd.Series) -> pd.Series:
    unpack = zstandard.ZstdDecompressor().decompress
    return packed.map(lambda x: None if x is None else unpack(bytes(x)))


def archive_tables(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", revisit_from: int = 1000, date: str = "1970-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """(records, payloads). records: headers (the exact bytes), digest (SHA-256 of the payload).
    payloads: digest, packed, one row per distinct payload, packed by Zstandard before it is shuffled.

    Of records with equal payloads of at least revisit_from bytes, the one with the largest id is the response and the
    others are revisits that refer to it. A revisit's payload is still found by its digest."""
    body = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    payloads = rows.select("digest", _pack("payload").alias("packed")).groupBy("digest").agg(F.first("packed").alias("packed"))
    heads = rows.select("id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size"))
    # Only groups that hold more than one record matter; their number is that of distinct payloads, not of records.
    latest = heads.where(F.col("size") >= revisit_from).groupBy(F.col("digest").alias("d")).agg(F.max("id").alias("latest"))
    heads = heads.join(latest, F.col("digest") == F.col("d"), "left")
    revisit = F.col("latest").isNotNull() & ~F.col("id").eqNullSafe(F.col("latest"))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _uri(F.col("url"))),
        F.when(F.col("url").rlike(_UNFIT), F.concat(F.lit("X-Target-URI-Base64: "), F.regexp_replace(F.base64(F.col("url").cast("binary")), r"\s", ""))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("latest")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
    ]
    headers = F.concat(F.concat_ws(CRLF, *lines), F.lit(RECORD_END)).cast("binary")
    return heads.select(headers.alias("headers"), "digest"), payloads


def header(name: str, headers: Column | None = None) -> Column:
    """A header's value from the header bytes; null where there is no such line."""
    got = F.regexp_extract((F.col("headers") if headers is None else headers).cast("string"), rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(got != "", got)


def _checked(value: Column, fits: Column, what: str) -> Column:
    """value, which only comes out if it fits."""
    return F.when(F.coalesce(fits, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(f"{what}, stored under "), F.col("digest"))).cast("binary"))


def reconstruct(records: DataFrame, payloads: DataFrame, verify: bool = True) -> DataFrame:
    """records with their payloads by a join on the digest. verify: a payload is given out only if it has that digest;
    else the job stops."""
    joined = records.join(payloads, "digest", "left").withColumn("payload", _unpack("packed")).drop("packed")
    return joined.withColumn("payload", _checked(F.col("payload"), F.sha2("payload", 256) == F.col("digest"), "payload missing or damaged")) if verify else joined


def read_records(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url), read off the archive alone and verified."""
    number = lambda c: F.regexp_extract(c, r"<urn:x-page:(-?\d+)>", 1).try_cast("long")
    declared, length = header("WARC-Payload-Digest"), header("Content-Length")
    fits = (F.concat(F.lit("sha1:"), F.sha1("payload")) == declared) & (length == F.when(header("WARC-Type") == "revisit", 0).otherwise(F.octet_length("payload")).cast("string"))
    whole = reconstruct(records, payloads).withColumn("payload", _checked(F.col("payload"), fits, "payload unlike its record's header"))
    exact = header("X-Target-URI-Base64")
    return whole.select(
        number(header("WARC-Record-ID")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        header("WARC-Type").alias("record_type"),
        number(header("WARC-Refers-To")).alias("refers_to"),
        F.coalesce(F.unbase64(exact).cast("string"), header("WARC-Target-URI")).alias("url"),
    )


def write_warc(records: DataFrame, payloads: DataFrame, path: str) -> None:
    """Plain WARC files in a folder: header, payload (none for a revisit) and two line ends, written by Spark's text writer."""
    whole = reconstruct(records, payloads)
    body = F.when(header("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    whole.select(F.concat(F.col("headers"), body).cast("string").alias("value")).write.option("lineSep", RECORD_END).text(path)


def _parse(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = data[at:end]
        length = next(int(x[15:]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        yield head, data[end : end + length]
        at = end + length + 4


def read_warc(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """WARC files as (records, payloads). A file is one task's unit, as WARC files are cut to a size for that."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                yield pd.DataFrame(list(_parse(bytes(content))), columns=["headers", "block"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "headers binary, block binary")
    declared = F.regexp_extract(F.col("headers").cast("string"), r"\r\nWARC-Block-Digest: sha256:([0-9a-f]{64})", 1)
    rows = saved(rows.withColumn("digest", F.when(declared != "", declared).otherwise(F.sha2("block", 256))), "warc")
    stored = rows.where(F.sha2("block", 256) == F.col("digest")).select("digest", _pack("block").alias("packed")).groupBy("digest").agg(F.first("packed").alias("packed"))
    return rows.select("headers", "digest"), stored


def op1_warc(spark, sf_dir: str) -> DataFrame:
    records, payloads = archive_tables(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    read = read_records(saved(records, "warc-records"), saved(payloads, "warc-payloads"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS h FROM pages),
g AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS latest FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND latest IS NOT NULL AND page_id IS DISTINCT FROM latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM latest THEN latest END AS refers_to
FROM g
"""
