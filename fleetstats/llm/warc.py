"""Content-addressed WARC archive: payloads stored once, record headers kept exactly.

An archive is two Parquet tables below one folder:

- ``payloads``: each payload once, zstd-compressed, under its SHA-256 digest;
- ``records``: each record's header block, byte for byte, and the digest of its payload.

``write_archive`` digests and compresses payloads in the tasks of the scan; equal digests
meet in one aggregate (partial first, so a payload of a third of all rows sends one row per
task), where a second hash shows that their payloads are equal. Headers are decided by a join
with the digests' first records. ``read_archive`` joins headers to payloads, and digests every
payload again; a record is its header, its payload and two line ends.

A join on digests has few rows on one side but may have a third of the other side on one
digest: ``join_digests`` takes the digests of more than 1/HOT_PARTS of all rows, of which
there are less than HOT_PARTS, by broadcast, and the rest by shuffle.

Defined results: a null or empty payload has no bytes; a null id is written as such, comes
after all others and is referred to by none; rows that repeat the smallest id of a payload
are responses each; a null url leaves out its header; line ends in a url are percent-encoded;
an empty table gives an empty archive; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstats.llm.common import in_tasks, unused

#: Bytes from which equal payloads are written once as a response and else as revisits.
SMALLEST = 100
#: A digest with more than this part of all rows is joined by broadcast.
HOT_PARTS = 1000
#: Fixed values of the WARC format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "\r\n"
#: Capture time of records whose source has none.
NO_DATE = "1970-01-01T00:00:00Z"


# ---- writing -------------------------------------------------------------------------
def digest_payloads(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                    packing: bool = True) -> DataFrame:
    """(id, url, digest, second, n_bytes, packed) of every row's whole payload in UTF-8.

    ``packed`` is null without ``packing``.
    """
    picked = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                          F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            raw = [x.as_buffer() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()),
                 pa.array([xxhash.xxh64_intdigest(x) - (1 << 63) for x in raw], pa.int64()),
                 pa.array([len(x) for x in raw], pa.int64()), pa.array([pack(x) if packing else None for x in raw], pa.binary())],
                names=["id", "url", "digest", "second", "n_bytes", "packed"])

    return in_tasks(picked, run, "id long, url string, digest binary, second long, n_bytes long, packed binary")


def join_digests(rows: DataFrame, digests: DataFrame, total: int) -> DataFrame:
    """Inner join on ``digest``; ``digests`` has each once, with its number of rows ``n``."""
    hot = F.broadcast(digests.filter(F.col("n") * HOT_PARTS > total))
    keys = hot.select("digest")
    return (rows.join(hot, "digest")
            .unionByName(rows.join(keys, "digest", "left_anti")
                         .join(digests.filter(F.col("n") * HOT_PARTS <= total), "digest")))


def _record_id(id_col: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_col.cast("string"), F.lit("none")), F.lit(">"))


def _header(id_col: Column, first: Column, date: str) -> Column:
    """The header block of a record, its empty line at the end included."""
    response = id_col.eqNullSafe(first) | first.isNull() | (F.col("n_bytes") < SMALLEST)
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(LINE))

    return F.concat(
        F.lit(VERSION + LINE), line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        line("WARC-Record-ID", _record_id(id_col)), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("digest")))),
        F.when(response, line("Content-Type", F.lit("text/html; charset=utf-8"))).otherwise(F.concat(
            line("WARC-Refers-To", _record_id(first)), line("WARC-Profile", F.lit(SAME_PAYLOAD)),
            line("X-Payload-Length", F.col("n_bytes").cast("string")))),
        line("Content-Length", F.when(response, F.col("n_bytes")).otherwise(F.lit(0)).cast("string")), F.lit(LINE))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  date: str = NO_DATE) -> None:
    """One record per row below ``path``, a folder that the driver and all executors share."""
    spark, heads = pages.sparkSession, f"{path}/heads"
    # Ids and digests are read twice more; without their payloads they are a few bytes a row.
    digest_payloads(pages, id_col, url_col, payload_col, packing=False).drop("packed").write.parquet(heads)
    first = digest_payloads(pages, id_col, url_col, payload_col).groupBy("digest").agg(
        F.first("packed").alias("packed"), F.first("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n"),
        F.min("id").alias("first_id"), F.min("second").alias("low"), F.max("second").alias("high"))
    collision = F.raise_error(F.concat(F.lit("payloads differ under the digest "), F.hex("digest")))
    (first.withColumn("n", F.when(F.col("low") == F.col("high"), F.col("n")).otherwise(collision.cast("long")))
     .drop("low", "high").write.option("compression", "uncompressed").parquet(f"{path}/payloads"))
    rows = spark.read.parquet(heads)
    total = rows.count()
    decided = join_digests(rows.drop("second", "n_bytes"),
                           spark.read.parquet(f"{path}/payloads").select("digest", "n_bytes", "n", "first_id"), total)
    header = _header(F.col("id"), F.col("first_id"), date)
    decided.select("id", "digest", header.alias("header")).write.parquet(f"{path}/records")


# ---- reading -------------------------------------------------------------------------
def header_field(name: str) -> Column:
    """A field of the ``header`` column; null where the record has none."""
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.contains(F.col("header"), F.lit(f"{LINE}{name}: ")), found)


def _page_id(field: str) -> Column:
    return F.regexp_extract(header_field(field), "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(id, header, payload, payload_bytes, payload_digest, record_type, refers_to) of all records.

    ``payload`` is what stands in the record: null bytes long for a revisit. All other columns
    are read from the header, digests and lengths checked against the payload itself.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    records = spark.read.parquet(f"{path}/records")
    joined = join_digests(records, payloads.select("digest", "packed", "n"), records.count())
    typed = joined.select("header", header_field("WARC-Type").alias("record_type"),
                          F.substring_index(header_field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
                          F.coalesce(header_field("X-Payload-Length"), header_field("Content-Length")).cast("long").alias("payload_bytes"),
                          "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            bodies = []
            for kind, digest, n, packed in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                body = unpack(packed)
                if len(body) != n or hashlib.sha256(body).hexdigest() != digest:
                    raise ValueError(f"the payload stored under {digest} is not the one digested")
                bodies.append(body if kind == "response" else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bodies, pa.binary())],
                                             names=["header", "record_type", "payload_digest", "payload_bytes", "payload"])

    read = in_tasks(typed, run, "header string, record_type string, payload_digest string, payload_bytes long, payload binary")
    return read.select(_page_id("WARC-Record-ID").alias("id"), "header", "payload", "payload_bytes", "payload_digest",
                       "record_type", _page_id("WARC-Refers-To").alias("refers_to"))


def restore_payloads(records: DataFrame) -> DataFrame:
    """``records`` with ``whole_payload``: a revisit's is that of the response with its digest."""
    whole, key = unused(records, "whole_payload"), unused(records, "source_digest")
    sources = (records.filter("record_type = 'response'").groupBy("payload_digest").agg(F.first("payload").alias(whole))
               .withColumnRenamed("payload_digest", key))
    revisits = records.filter("record_type = 'revisit'").join(sources, F.col("payload_digest") == F.col(key), "left").drop(key)
    return records.filter("record_type = 'response'").withColumn(whole, F.col("payload")).unionByName(revisits)


def export_files(records: DataFrame, path: str) -> None:
    """WARC files below ``path``: the text sink puts the two line ends behind each record."""
    block = F.concat("header", F.decode("payload", "UTF-8"))
    records.select(block.alias("value")).write.option("lineSep", LINE + LINE).text(path)
