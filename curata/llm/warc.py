"""WARC records in a content-addressed archive.

`write_archive` stores each distinct payload once, keyed by its SHA-256 and bucketed by it, and the exact header block
of every record in a table of its own. `read_records` verifies each stored payload against its key and rebuilds the
records (header block, payload where they carry one, two line ends) by joining the two: the payload side is read by bucket and not moved
again. `read_pages` gives every record, revisits too, the payload it stands for. The longest payload group is cut to one row per task before the shuffle (window group limit), and the join that
gives every record its payload's facts exchanges both sides, so that adaptive execution splits a very common payload.

Defined results: a null html is the empty payload; payloads below `min_revisit_bytes` are all written as responses; of
equal longer payloads the record with the largest page_id is the response; rows that repeat both page_id and payload are
the same record and are all responses where that page_id is the largest; a null page_id is written as "-" and comes back
null; null urls are written as empty target URIs; line ends and other control characters in urls become "%XX"; an empty
table gives an empty archive; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curata.llm.common import scratch_path, table

CRLF = "\r\n"
#: The base32 alphabet of RFC 4648, and the digits that conv() writes in base 32.
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: five hex digits make four base32 digits, and 40 divide evenly."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


class Archive:
    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "warc")
        self.payload_table = f"warc_payloads_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))


def _uri(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    for char, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        url = F.replace(url, F.lit(char), F.lit(code))
    return url


def header_block(kind: Column, page_id: Column, url: Column, digest: Column, length: Column, refers_to: Column, date: str) -> Column:
    """The exact header bytes of a record, up to and with the empty line."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    revisit = kind == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), text(page_id), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _uri(url)),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), text(refers_to), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(length).cast("string")),
        F.lit(CRLF),
    ]
    return F.encode(F.concat_ws(CRLF, *lines), "UTF-8")


def write_archive(pages: DataFrame, archive: Archive, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> Archive:
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = Window.partitionBy("digest").orderBy(F.col("page_id").desc_nulls_last())
    store = rows.select("digest", "page_id", "payload", F.row_number().over(first).alias("place")).where("place = 1")
    store = store.select("digest", F.col("page_id").alias("response_id"), "payload")
    writer = store.write.format("parquet").option("compression", "zstd").bucketBy(archive.buckets, "digest").sortBy("digest")
    writer.option("path", f"{archive.path}/payloads").saveAsTable(archive.payload_table)
    roots = archive.spark.read.schema("digest string, response_id long").parquet(f"{archive.path}/payloads")
    facts = rows.select("page_id", "url", "digest", F.length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("sha1"))
    records = facts.join(roots, "digest")
    is_response = F.col("page_id").eqNullSafe(F.col("response_id")) | (F.col("n") < min_revisit_bytes)
    records = records.withColumn("kind", F.when(is_response, "response").otherwise("revisit"))
    block = header_block(F.col("kind"), F.col("page_id"), F.col("url"), F.col("sha1"), F.col("n"), F.col("response_id"), date)
    stored = records.select("page_id", F.col("digest").alias("payload_key"), block.alias("header"), (F.col("kind") == "response").alias("has_payload"))
    stored.write.option("compression", "zstd").parquet(f"{archive.path}/headers")
    return archive


def read_payloads(archive: Archive) -> DataFrame:
    """The stored payloads, each verified against its key; a damaged one ends the query."""
    kept = archive.spark.table(archive.payload_table)
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload"))
    return kept.select(F.col("digest").alias("payload_key"), F.coalesce(sound, F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary")).alias("payload"))


def read_headers(archive: Archive) -> DataFrame:
    return archive.spark.read.schema("page_id long, payload_key string, header binary, has_payload boolean").parquet(f"{archive.path}/headers")


def _responses(archive: Archive) -> DataFrame:
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    records = read_headers(archive).where("has_payload").join(read_payloads(archive).hint("merge"), "payload_key")
    return records.select("page_id", "payload_key", "header", "payload", F.concat("header", "payload", end).alias("record"))


def read_records(archive: Archive) -> DataFrame:
    """All records: page_id, payload_key, header, payload (null for revisits, which carry none), record (the original bytes)."""
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    revisits = read_headers(archive).where("not has_payload").select("page_id", "payload_key", "header", F.lit(None).cast("binary").alias("payload"), F.concat("header", end).alias("record"))
    return _responses(archive).unionByName(revisits)


def read_pages(archive: Archive) -> DataFrame:
    """Each record with the payload that it stands for, revisits with that of their response: page_id, header, payload. Both sides are
    exchanged, so that the records of a very common payload can be split over tasks."""
    stored = archive.spark.read.schema("digest string, response_id long, payload binary").parquet(f"{archive.path}/payloads")
    return read_headers(archive).join(stored.select(F.col("digest").alias("payload_key"), "payload"), "payload_key").select("page_id", "header", "payload")


def field(header: Column, name: str) -> Column:
    return F.regexp_extract(F.decode(header, "UTF-8"), rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)


def report(archive: Archive) -> DataFrame:
    """Per record, from the archive alone: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    content = F.expr("substring(record, length(header) + 1, length(record) - length(header) - 4)")
    rebuilt = _responses(archive).select("payload_key", content.alias("content"))
    facts = rebuilt.select("payload_key", F.length("content").cast("long").alias("payload_bytes"), base32_sha1(F.col("content")).alias("sha1"))
    facts = facts.dropDuplicates(["payload_key", "sha1"])
    heads = read_headers(archive).select("payload_key", field(F.col("header"), "WARC-Payload-Digest").alias("named"), field(F.col("header"), "WARC-Type").alias("record_type"), field(F.col("header"), "WARC-Record-ID").alias("record_id"), field(F.col("header"), "WARC-Refers-To").alias("refers"))
    key = lambda x: F.regexp_extract(x, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    # joined on both digests: neither side is then already dealt out by the join's keys, and a hot payload can be split
    found = heads.withColumn("sha1", F.substring("named", 6, 32)).join(facts, ["payload_key", "sha1"], "left")
    return found.select(key(F.col("record_id")).alias("page_id"), "payload_bytes", F.col("sha1").alias("payload_digest"), "record_type", key(F.col("refers")).alias("refers_to"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), Archive(spark)))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex FROM p),
m AS (SELECT hex, max(page_id) AS keep FROM h GROUP BY hex)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0x' || substr(h.hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4)) & 31 AS BIGINT), 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM h JOIN m USING (hex)
"""
