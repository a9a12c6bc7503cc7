"""Web archives as a table of chunks.

Writing streams each payload through its digest and into its record a slice at a time; reading yields rows of record
identifier and chunk number with at most ``CHUNK`` bytes each, so that no step holds the bytes of a whole record. A
chunk carries the digest and length of the payload up to its end: a record's last chunk has those of the whole, and a
reader that joins chunks can check any prefix.

Of records with equal payloads, that with the smallest page_id is a response and the others are revisits that refer
to it; this is decided on a narrow table of ids and digests. Tasks write archives under names of their own into a
folder that all executors share; a manifest written by Spark lists those of the attempts that succeeded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from cilens.llm.common import arrow_schema, cut_lineage, scratch_path, shared_folder, table

CHUNK = 1 << 16
#: Payloads of fewer bytes are stored again each time.
LEAST_BYTES = 0
ARCHIVE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("b6a1f3c2-1f0e-4f6e-9d55-0c8f3a9e7d21")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "path string, n_records bigint, payload_bytes bigint"
_CHUNKS = ("record_id string, page_id bigint, url string, record_type string, refers_to bigint, payload_length bigint, payload_digest string, "
           "chunk int, data binary, upto bigint, digest string, last boolean")


def _slices(text: str) -> Iterator[bytes]:
    for a in range(0, len(text), CHUNK):
        yield text[a:a + CHUNK].encode("utf-8", "surrogatepass")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def digest(text: str) -> tuple[str, int]:
    """Base32 SHA-1 and length of a text in UTF-8, taken slice by slice."""
    sha, size = hashlib.sha1(), 0
    for part in _slices(text):
        sha.update(part)
        size += len(part)
    return base32(sha.digest()), size


def record_id(page_id: int | None, url: str, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {payload_digest} {url}')}>"


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c > " " and c != "\x7f")


def write_record(out, row: dict) -> None:
    """Append one record, a gzip member of its own: page_id, url, html, payload_digest, payload_length, refers_to."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    url = _clean(row["url"])
    fields = {
        "WARC-Type": row["record_type"], "WARC-Record-ID": record_id(row["page_id"], url, row["payload_digest"]), "WARC-Date": DATE,
        "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{row['payload_digest']}",
        "Page-ID": row["page_id"], "Payload-Length": row["payload_length"],
        "Content-Length": len(http) + (0 if revisit else row["payload_length"]),
    }
    if revisit:
        fields |= {"WARC-Profile": _PROFILE, "Refers-To-Page-ID": row["refers_to"]}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None and v != "") + "\r\n"
    out.write(packer.compress(head.encode() + http))
    if not revisit:
        for part in _slices(row["html"]):
            out.write(packer.compress(part))
    out.write(packer.compress(b"\r\n\r\n") + packer.flush())


def _fields(stream) -> dict[str, str]:
    out = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8").partition(":")
        out[name.lower()] = value.strip()
    return out


def read_records(stream) -> Iterator[dict]:
    """Chunk rows of an archive, in order; a payload that does not match its digest raises an error."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 17)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = _fields(stream)
        left = int(head["content-length"])
        number = lambda name: int(head[name]) if name in head else None
        record = {"record_id": head["warc-record-id"], "page_id": number("page-id"), "url": head.get("warc-target-uri", ""),
                  "record_type": head["warc-type"], "refers_to": number("refers-to-page-id"), "payload_length": number("payload-length"),
                  "payload_digest": head["warc-payload-digest"].removeprefix("sha1:")}
        while left > 0:
            line = stream.readline()
            left -= len(line)
            if line in (b"\r\n", b""):
                break
        sha, upto, chunk = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(CHUNK, left))
            left -= len(data)
            upto += len(data)
            sha.update(data)
            last = left == 0
            if not data and not last:
                raise ValueError(f"{record['record_id']} ends early")
            if last and record["record_type"] == "response" and (base32(sha.digest()), upto) != (record["payload_digest"], record["payload_length"]):
                raise ValueError(f"{record['record_id']} does not match its digest")
            yield record | {"chunk": chunk, "data": data, "upto": upto, "digest": base32(sha.digest()), "last": last}
            chunk += 1
            if last:
                break


def _digested(pages: DataFrame, html: str) -> DataFrame:
    """(page_id, url, html, payload_digest, payload_length) of every page; null texts are empty."""
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), url.alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(t) for t in batch.column(2).to_pylist()]
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "payload_digest", "payload_length"])

    return rows.mapInArrow(run, "page_id bigint, url string, html string, payload_digest string, payload_length bigint")


def write(pages: DataFrame, folder: str, html: str = "html", least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row of ``pages`` (page_id, url if there is one, the payload column) below ``folder``.

    A null payload is empty. Rows without an id revisit the smallest id with their payload, or are responses where no
    such row has an id; rows that repeat the responding id with its payload are responses too. An empty table gives an
    empty manifest; other columns are not stored. ``folder`` is a new path in a store that pyarrow can open.
    """
    rows, folder = _digested(pages, html), shared_folder(pages.sparkSession, folder)
    # the narrow table of first holders is written before texts move, so digests are not taken twice over in a retry
    first = cut_lineage(rows.where(F.col("payload_length") >= least_bytes).groupBy("payload_digest").agg(
        F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").select("payload_digest", "refers_to"))
    marked = rows.join(first, "payload_digest", "left")
    other = F.col("refers_to").isNotNull() & ~F.col("refers_to").eqNullSafe(F.col("page_id"))
    marked = marked.select("page_id", "url", F.when(~other, F.col("html")).alias("html"), "payload_digest", "payload_length",
                           F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("refers_to")).alias("refers_to"))
    schema = arrow_schema(_MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, path, records, size = None, "", 0, 0
        for batch in batches:
            names = batch.schema.names
            for k in range(batch.num_rows):
                row = {name: batch.column(c)[k].as_py() for c, name in enumerate(names)}
                if out is None:
                    store.create_dir(root, recursive=True)
                    path, records, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                write_record(out, row)
                records, size = records + 1, size + row["payload_length"] * (row["record_type"] == "response")
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"path": path, "n_records": records, "payload_bytes": size}], schema=schema)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "n_records": records, "payload_bytes": size}], schema=schema)

    marked.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/manifest")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk table of the archives below ``folder``: a row per record and chunk, an empty payload having one chunk.

    record_id, page_id, url, record_type, refers_to, payload_length and payload_digest are the record's; chunk counts
    from 0, data holds its bytes, upto and digest are length and digest of the payload to its end, last marks the end.
    """
    folder, schema = shared_folder(spark, folder), arrow_schema(_CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for row in read_records(stream):
                        held.append(row)
                        size += len(row["data"])
                        if size >= CHUNK * 64 or len(held) >= 4096:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    files = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").select("path")
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, _CHUNKS)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record, from its last chunk: length and digest are those of the full payload, also for revisits."""
    ends = chunks(spark, folder).where("last")
    full = F.col("record_type") == "response"
    return ends.select("page_id", "url", F.when(full, F.col("upto")).otherwise(F.col("payload_length")).alias("payload_bytes"),
                       F.when(full, F.col("digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


def query(spark: SparkSession, folder: str) -> DataFrame:
    archive = scratch_path(spark, "warc")
    write(table(spark, folder, "pages"), archive)
    return records(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH digests AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), spelled AS (
  SELECT page_id, payload_bytes,
    (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
       1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INTEGER, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1), '' ORDER BY i)
     FROM range(32) AS places(i)) AS payload_digest
  FROM digests
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM spelled
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id OR page_id IS NULL THEN first_id END AS refers_to
FROM firsts
"""
