"""The content-addressed archive: exact round trips, plain SQL, and a reader of its files."""

import glob
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from fleetstats.llm import queries, warc

SMALL = "/root/testdata/sf0.001"


def parse(raw):
    """(header fields, block) of the records in the bytes of a WARC file, by their lengths."""
    out = []
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        n = int(fields["Content-Length"])
        assert version == "WARC/1.1" and rest[n:n + 4] == b"\r\n\r\n"
        out.append((fields, rest[:n]))
        raw = rest[n + 4:]
    return out


def expected(pages):
    """(id, bytes, digest, type, refers_to) of plain rows (id, html)."""
    first = {}
    for i, html in pages:
        key = (html or "").encode()
        if i is not None:
            first[key] = min(first.get(key, i), i)
    out = []
    for i, html in pages:
        key = (html or "").encode()
        response = len(key) < 100 or key not in first or first[key] == i
        out.append((i, len(key), hashlib.sha256(key).hexdigest(), "response" if response else "revisit",
                    None if response else first[key]))
    return sorted(out, key=str)


EDGES = [(1, "http://a/", "x" * 100), (2, "http://b/", "x" * 100), (0, None, "x" * 100), (3, "u", "x" * 99), (4, "u", "x" * 99),
         (5, "u", None), (6, "u", ""), (None, "u", "x" * 100), (None, "u", "only one " * 20), (7, "two\r\nlines", "é" * 50),
         (8, "", "é" * 50), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (10, "u", "y" * 3_000_000)]


@pytest.fixture(params=[1, 1000])
def hot_parts(request, monkeypatch):
    monkeypatch.setattr(warc, "HOT_PARTS", request.param)


def test_edges_and_round_trip(spark, tmp_path, hot_parts):
    pages = spark.createDataFrame(EDGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("id", F.lit("z"))
    warc.write_archive(pages, str(tmp_path / "a"))
    records = warc.read_archive(spark, str(tmp_path / "a"))
    got = [tuple(r) for r in records.select("id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == expected([(i, h) for i, _, h in EDGES])
    whole = sorted(((r.id, bytes(r.whole_payload)) for r in warc.restore_payloads(records).collect()), key=str)
    assert whole == sorted(((i, (h or "").encode()) for i, _, h in EDGES), key=str)
    stored = spark.read.parquet(str(tmp_path / "a/payloads"))
    assert stored.count() == len({(h or "") for _, _, h in EDGES}) == stored.select("digest").distinct().count()


def test_files_hold_the_records(spark, tmp_path):
    pages = spark.createDataFrame(EDGES, "page_id long, url string, html string").coalesce(2)
    warc.write_archive(pages, str(tmp_path / "a"))
    records = warc.read_archive(spark, str(tmp_path / "a"))
    warc.export_files(records, str(tmp_path / "files"))
    read = [x for f in glob.glob(str(tmp_path / "files/part-*")) for x in parse(open(f, "rb").read())]
    assert sorted((f["WARC-Type"], f["WARC-Record-ID"], b) for f, b in read) == sorted(
        (r.record_type, f"<urn:page:{'none' if r.id is None else r.id}>", bytes(r.payload)) for r in records.collect())
    urls = {f["WARC-Record-ID"]: f.get("WARC-Target-URI") for f, _ in read}
    assert urls["<urn:page:7>"] == "two%0D%0Alines" and urls["<urn:page:0>"] is None
    assert all(hashlib.sha256(b).hexdigest() == f["WARC-Payload-Digest"][7:] for f, b in read if f["WARC-Type"] == "response")


def test_a_changed_payload_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    other = warc.digest_payloads(spark.createDataFrame([(1, "u", "z" * 200)], pages.schema)).select("packed").first()[0]
    spark.read.parquet(str(tmp_path / "a/payloads")).withColumn("packed", F.lit(other)).write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/records")).write.parquet(str(tmp_path / "b/records"))
    with pytest.raises(Exception, match="is not the one digested"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()


def test_query_against_sql_and_empty_table(spark, tmp_path):
    duckdb.sql(f"create or replace view pages as select * from '{SMALL}/pages.parquet'")
    want = duckdb.sql(queries.ORACLE_SQL["op12_warc_archive"]).fetchall()
    got = queries.QUERIES["op12_warc_archive"](spark, SMALL).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").limit(0)
    warc.write_archive(pages, str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0
