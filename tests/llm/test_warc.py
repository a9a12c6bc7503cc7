"""Archives as they were written, and decisions by hand."""

import base64
import gzip
import hashlib
import io

import duckdb
import pytest

from cilens.llm import warc
from cilens.llm.common import scratch_path

PAGES = [(5, "http://a b/é", "x", 1), (3, "u", "x", 1), (None, "u", "x", 1), (9, None, None, 1), (8, "u\r\nWARC-Type: resource", "", 1), (None, "n", "solo", 1),
         (None, "n", "solo", 1), (7, "u", "é\r\n\r\nWARC/1.1\r\n" * 50_000, 1)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id int, url string, html string, payload_length int")


def test_records_and_revisits(spark, pages):
    folder = scratch_path(spark, "warc")
    warc.write(pages, folder)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    got = sorted(map(str, (tuple(r) for r in warc.records(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())))
    first = {5: 3, None: 3, 9: 8}
    want = [(i, len((t or "").encode()), digest(t), *(("revisit", first[i]) if i in first and t != "solo" else ("response", None))) for i, _, t, _ in PAGES]
    assert got == sorted(map(str, want))


def test_chunks_carry_running_digests(spark, pages):
    folder = scratch_path(spark, "warc")
    warc.write(pages, folder)
    chunks = warc.chunks(spark, folder).where("page_id = 7").orderBy("chunk").collect()
    sha, data = hashlib.sha1(), b""
    for k, c in enumerate(chunks):
        sha.update(c.data)
        data += c.data
        assert (c.chunk, c.upto, c.digest, c.last) == (k, len(data), warc.base32(sha.digest()), k == len(chunks) - 1)
        assert len(c.data) <= warc.CHUNK
    assert len(chunks) > 5 and data == PAGES[-1][2].encode()


def record(html, **more):
    row = {"page_id": 1, "url": "u", "html": html, "record_type": "response", "refers_to": None}
    row["payload_digest"], row["payload_length"] = warc.digest(html)
    out = io.BytesIO()
    warc.write_record(out, row | more)
    return out.getvalue()


def test_damage_is_noticed():
    good = record("abc")
    assert [c["data"] for c in warc.read_records(io.BytesIO(good + record("")))] == [b"abc", b""]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(gzip.compress(gzip.decompress(good).replace(b"abc", b"abd")))))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(record("abc", payload_digest=warc.digest("abcd")[0]))))


def test_small_payloads_may_always_be_responses(spark, pages):
    folder = scratch_path(spark, "warc")
    warc.write(pages, folder, least_bytes=1)
    rows = warc.records(spark, folder).collect()
    assert {r.record_type for r in rows if r.payload_bytes == 0} == {"response"}
    assert {r.record_type for r in rows if r.page_id == 5} == {"revisit"}


def test_no_pages(spark, pages):
    folder = scratch_path(spark, "warc")
    warc.write(pages.limit(0), folder)
    assert warc.records(spark, folder).count() == 0


def test_query_agrees_with_sql(spark, folder):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    columns = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = duck.execute(f"SELECT {columns} FROM ({warc.ORACLE}) ORDER BY page_id").fetchall()
    assert [tuple(r) for r in warc.query(spark, folder).orderBy("page_id").select(*columns.split(", ")).collect()] == want
