"""A content-addressed WARC archive: every payload once, exact record headers in a table of their own, records rebuilt by joins.

``write_archive`` makes two things below one folder:

* ``payloads/``: gzip WARC files with one ``resource`` record per distinct payload, named by its SHA-256. Spark's text writer puts the
  records out (the record end is its line separator), so files appear by Spark's commit and in any store Spark writes to;
* ``headers/``: a table with a row per record: its identifier, the exact header, the payload's digests and length, ``response`` or
  ``revisit`` and what a revisit refers to.

Payloads are brought together by digest AND bytes, combined before the shuffle, so a payload with a third of all records is one row per
task; should two different payloads share a digest the write fails instead of losing one. Reading parses the files by their
Content-Length and recomputes every digest. ``read_archive`` joins headers and payloads back to the original records.

Defined cases: a null payload is the empty payload; ids may be null (larger than any other) or repeated: of rows that share payload and id
one is the response, chosen by the header and then by the written order; an empty table gives an empty archive. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from heldout.plans.storage import scratch_path

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
#: Bytes of payload that one batch handed back by a reader may hold.
BATCH_BYTES = 8 << 20


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: each five hexadecimal digits are four characters."""
    digest, out = F.sha1(payload), []
    for group in range(8):
        bits = F.conv(F.substring(digest, 1 + 5 * group, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(ALPHABET), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def page_header(url: Column, payload: Column) -> Column:
    """The header of a page's record (without the blank line that ends it)."""
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"),
    )


def write_archive(records: DataFrame, path: str, min_bytes: int = 0) -> None:
    """``records``: record_id, header (string), payload (string or binary). Payloads below ``min_bytes`` get no revisits."""
    spark: SparkSession = records.sparkSession
    bytes_ = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    rows = records.select("record_id", "header", bytes_.alias("payload"))
    facts = rows.select(
        "record_id", "header", F.sha2("payload", 256).alias("sha256"), base32_sha1(F.col("payload")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.monotonically_increasing_id().alias("at"),
    )
    facts_path = f"{path}/facts"
    facts.write.parquet(facts_path)
    facts = spark.read.schema(facts.schema).parquet(facts_path)

    seen = Observation()
    once = rows.groupBy(F.sha2("payload", 256).alias("sha256"), "payload").agg(F.count(F.lit(1)).alias("n"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:sha256:"), F.col("sha256"), F.lit(">\r\nWARC-Payload-Digest: sha1:"),
        base32_sha1(F.col("payload")), F.lit("\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END), F.col("payload").cast("string"),
    )
    stored = once.select(record.alias("value")).observe(seen, F.count(F.lit(1)).alias("n"))
    stored.write.option("lineSep", END).option("compression", "gzip").text(f"{path}/payloads")
    first = facts.groupBy("sha256").agg(
        F.min(F.struct(F.col("record_id").isNull().alias("no_id"), F.col("record_id").alias("id"), F.col("header").alias("h"), F.col("at").alias("at"))).alias("first")
    )
    if first.count() != seen.get["n"]:
        raise ValueError("different payloads have the same SHA-256")
    typed = facts.join(first, "sha256")
    revisit = (F.col("payload_bytes") >= min_bytes) & (F.col("at") != F.col("first.at"))
    typed.select(
        "record_id", "header", "sha256", "payload_digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.id")).alias("refers_to"),
    ).write.parquet(f"{path}/headers")


def _records(blob: bytes) -> Iterator[tuple[str, str, bytes]]:
    """Parse one archive file: identifier, payload digest and payload of each record, by Content-Length."""
    data, at = gzip.decompress(blob), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8").split("\r\n")[1:])
        length = int(fields["Content-Length"])
        payload = data[end + 4 : end + 4 + length]
        at = end + 4 + length + 4
        if len(payload) != length or data[at - 4 : at] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields["WARC-Record-ID"][len("<urn:sha256:") : -1], fields["WARC-Payload-Digest"][len("sha1:") :], payload


def _read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import base64

    names = ["sha256", "payload_digest", "payload_bytes", "payload"]
    for batch in batches:
        for blob in batch["content"]:
            rows, size = [], 0
            for sha256, sha1, payload in _records(blob):
                real = base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")
                if real != sha1 or hashlib.sha256(payload).hexdigest() != sha256:
                    raise ValueError(f"payload {sha256} does not have the digest it is stored under")
                rows.append((sha256, real, len(payload), payload))
                size += len(payload)
                if size >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Every stored payload, its digests recomputed from the bytes read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{path}/payloads").select("content")
    return files.mapInPandas(_read_files, "sha256 string, payload_digest string, payload_bytes long, payload binary")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The original records: record_id, header, payload, ``record`` (header, blank line, payload), their type, digest and length."""
    headers = spark.read.parquet(f"{path}/headers").select("record_id", "header", "sha256", "record_type", "refers_to")
    joined = headers.join(read_payloads(spark, path), "sha256")
    record = F.concat(F.col("header").cast("binary"), F.lit(END).cast("binary"), F.col("payload"))
    return joined.select("record_id", "header", "payload", record.alias("record"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def archive_pages(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per page to an archive (a new one in the shared folder without ``path``) and return what is read back."""
    path = path or scratch_path(pages.sparkSession, "archive")
    html = F.coalesce(F.col(html_col), F.lit(""))
    write_archive(pages.select(F.col(id_col).alias("record_id"), page_header(F.col(url_col), html).alias("header"), html.alias("payload")), path)
    return read_archive(pages.sparkSession, path)
