"""Token ids in directly addressable codes.

An id is split into chunks of eight bits. Level 0 of a file holds the lowest chunk of every token; a continuation
bitmap marks the tokens that go on, whose next chunks form level 1, and so forth. A rank directory counts the set
bits before every block of a bitmap, so token i is found by one chunk, one bit and one count per level, without
decoding what lies before it.

Documents are range-partitioned by id; each task writes files of at most about ``FILE_TOKENS`` tokens, each with an
index of its documents, into a folder that all executors share. Every attempt of a task uses names of its own, and a
manifest written by Spark lists the files of the attempts that succeeded: files of a lost executor are never read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cilens.llm.common import arrow_schema, scratch_path, shared_folder, steps, table, whole_text

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
FILE_TOKENS = 1 << 24
MAGIC = b"CLDAC001"
#: Bits of a bitmap that one entry of its rank directory covers.
RANK_BITS = 512
_STEP = 1 << 22
_READ = 1 << 20
_MANIFEST = "part int, seq int, path string, n_docs bigint, n_tokens bigint"
_KNOWN_WORDS = 1_000_000


class Encoder:
    """The tokenizer, with the ids of words already seen.

    Byte-level tokenizers of this family cut a text before every single space or line end between two other
    characters, whatever stands around it, so a text's ids are those of its parts, a part being a word with what
    separates it from the word before. Parts are encoded by the library once while they are remembered; texts in
    which white space meets white space, or is of another kind, are encoded whole.
    """

    _other = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def __init__(self, path: str):
        # a task has one core: the library's own threads would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        state = json.loads(self.library.to_str())
        before, added = state["pre_tokenizer"] or {}, state["added_tokens"]
        self.line_end = self._library_ids(["\n"])[0]
        self.by_parts = (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
                         and state["normalizer"] is None and len(self.line_end) == 4
                         and not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in added))
        self.known: dict[str, bytes] = {}

    def _library_ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, text: str) -> bool:
        return (text[:1] in (" ", "\n", "") or text[-1:] in (" ", "\n") or "  " in text or " \n" in text or "\n " in text or "\n\n" in text
                or self._other.search(text) is not None)

    def _learn(self, parts: list[str]) -> None:
        """Remember the ids of parts: a word alone follows a space, one with a line end before it follows that.

        Many words go into one text, each on a line of its own. A line end there is a token by itself, and no other
        token has its id, so the ids of the words can be told apart.
        """
        mark = int(np.frombuffer(self.line_end, "<u4")[0])
        lines = [p for p in parts if p[0] == "\n"]
        spaced = [p for p in parts if p[0] != "\n"]
        for keys, before, words in ((spaced, b"", [f" {p}" for p in spaced]), (lines, self.line_end, [p[1:] for p in lines])):
            cuts = range(0, len(words), 4000)
            texts = ["\n".join(words[k:k + 4000]) for k in cuts]
            for k, encoded in zip(cuts, self.library.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(encoded.ids, "<u4")
                ends = np.append(np.flatnonzero(ids == mark), len(ids)) * 4
                data, starts, ends = ids.tobytes(), [0, *(ends[:-1] + 4).tolist()], ends.tolist()
                values = [before + data[x:y] for x, y in zip(starts, ends)] if before else [data[x:y] for x, y in zip(starts, ends)]
                self.known.update(zip(keys[k:k + 4000], values, strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        whole = [not self.by_parts or self._whole(t) for t in texts]
        parts = [[] if alone else t.replace("\n", " \n").split(" ") for t, alone in zip(texts, whole)]
        heads = self._library_ids([t if alone else p[0] for t, alone, p in zip(texts, whole, parts)])
        rest = [p[1:] for p in parts]
        new = set().union(*rest).difference(self.known)
        if len(self.known) + len(new) > _KNOWN_WORDS:
            self.known.clear()
            new = set().union(*rest)
        self._learn(list(new))
        ids = self.known.__getitem__
        return [head + b"".join(map(ids, p)) for head, p in zip(heads, rest)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_file(out, docs: list[tuple[int | None, int]], ids: np.ndarray) -> None:
    """Write one file: ``docs`` are (doc_id, n_tokens) in order, ``ids`` all their tokens as unsigned 32-bit integers."""
    sections: list[tuple[str, int, int]] = []
    at = out.write(MAGIC)

    def add(name: str, values: np.ndarray) -> None:
        nonlocal at
        data = values.tobytes()
        sections.append((name, at, len(data)))
        out.write(data)
        at += len(data)

    add("doc_ids", np.array([d or 0 for d, _ in docs], "<i8"))
    add("doc_null", np.array([d is None for d, _ in docs], np.uint8))
    add("doc_starts", np.cumsum([0, *[n for _, n in docs]], dtype=np.int64).astype("<i8"))
    level, rest = 0, ids
    while True:
        more = rest > 0xFF
        add(f"chunks{level}", (rest & 0xFF).astype(np.uint8))
        bits = np.packbits(np.concatenate((more, np.zeros(-len(more) % RANK_BITS, bool))), bitorder="little")
        add(f"bits{level}", bits)
        counts = np.bitwise_count(bits.view("<u8")).reshape(-1, RANK_BITS // 64).sum(axis=1, dtype=np.int64)
        add(f"ranks{level}", (np.cumsum(counts) - counts).astype("<i8"))
        if not more.any():
            break
        level, rest = level + 1, rest[more] >> np.uint32(8)
    foot = json.dumps({"tokens": len(ids), "docs": len(docs), "levels": level + 1, "sections": {n: [a, s] for n, a, s in sections}}).encode()
    out.write(foot)
    out.write(len(foot).to_bytes(4, "little") + MAGIC)


class TokenFile:
    """Random access to a file of ``encode_file``; only what is asked for is read."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = self._bytes(size - 12, 12)
        if tail[4:] != MAGIC:
            raise ValueError("not a token file")
        length = int.from_bytes(tail[:4], "little")
        foot = json.loads(self._bytes(size - 12 - length, length))
        self.n_tokens, self.n_docs, self.levels, self.at = foot["tokens"], foot["docs"], foot["levels"], foot["sections"]

    def _bytes(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset)

    def _part(self, name: str, first: int, count: int, kind: str) -> np.ndarray:
        width = np.dtype(kind).itemsize
        return np.frombuffer(self._bytes(self.at[name][0] + first * width, count * width), kind)

    def documents(self, a: int, b: int) -> tuple[list[int | None], np.ndarray]:
        """Ids of documents a .. b - 1, and the first tokens of documents a .. b."""
        ids, null = self._part("doc_ids", a, b - a, "<i8").tolist(), self._part("doc_null", a, b - a, "u1").tolist()
        return [None if n else i for i, n in zip(ids, null)], self._part("doc_starts", a, b - a + 1, "<i8")

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Tokens a .. b - 1."""
        value, held = np.zeros(b - a, np.uint32), np.arange(b - a)
        for level in range(self.levels):
            if a >= b:
                break
            value[held] |= self._part(f"chunks{level}", a, b - a, "u1").astype(np.uint32) << np.uint32(8 * level)
            block = a // RANK_BITS
            last = -(-b // RANK_BITS)
            bits = np.unpackbits(self._part(f"bits{level}", block * RANK_BITS // 8, (last - block) * RANK_BITS // 8, "u1"), bitorder="little")
            skip = a - block * RANK_BITS
            more = bits[skip:skip + b - a].astype(bool)
            before = int(self._part(f"ranks{level}", block, 1, "<i8")[0]) + int(bits[:skip].sum())
            held, a, b = held[more], before, before + int(more.sum())
        return value

    def token(self, i: int) -> int:
        """Token i, from one chunk, one block of bits and one count per level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        return int(self.tokens(i, i + 1)[0])


def _flush(root: str, part: int, seq: int, docs: list, ids: list[bytes]) -> dict:
    store, folder = fs.FileSystem.from_uri(root)
    store.create_dir(folder, recursive=True)
    path = f"{folder}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tok"
    with store.open_output_stream(path) as out:
        encode_file(out, docs, np.frombuffer(b"".join(ids), "<u4"))
    return {"part": part, "seq": seq, "path": path, "n_docs": len(docs), "n_tokens": sum(n for _, n in docs)}


def write(docs: DataFrame, folder: str, text: str = "text", tokenizer: str | None = None, end_id: int = END_ID,
          file_tokens: int = FILE_TOKENS, partitions: int | None = None) -> None:
    """Encode every row of ``docs`` into token files below ``folder``, in ascending order of doc_id.

    Null ids come first, rows of one id follow the hash of their texts; a null text is empty and gives the end id
    alone. ``folder`` is a new path in a store that pyarrow can open (local or shared folders, object stores, HDFS);
    ``tokenizer`` is a path that every executor has. An empty table gives an empty manifest; other columns are not read.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    folder = shared_folder(spark, folder)
    whole = whole_text(docs, text)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(whole).alias("h"), whole.alias("t"))
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "t")
    schema, end = arrow_schema(_MANIFEST), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in steps(map(len, texts), _STEP):
                for doc_id, found in zip(doc_ids[a:b], encoder(path)(texts[a:b])):
                    ids += [found, end]
                    held.append((doc_id, len(found) // 4 + 1))
                    size += held[-1][1]
                    if size >= file_tokens:
                        yield pa.RecordBatch.from_pylist([_flush(folder, part, seq, held, ids)], schema=schema)
                        seq, held, ids, size = seq + 1, [], [], 0
        if held:
            yield pa.RecordBatch.from_pylist([_flush(folder, part, seq, held, ids)], schema=schema)

    ordered.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a store with ``base``, the number of tokens in all files before each."""
    files = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    total = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = total.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return files.join(before, "part").withColumn("base", F.col("b") + F.coalesce(inside, F.lit(0))).drop("b")


def _ranges(starts: np.ndarray, most: int) -> Iterable[tuple[int, int]]:
    return steps(np.diff(starts).tolist(), most)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a store, from its files.

    start counts the ids of all documents before; the checksum is over the ids as little-endian 32-bit integers. Of a
    file, about a million tokens are in memory at a time.
    """
    folder, schema = shared_folder(spark, folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(*(batch.column(k).to_pylist() for k in range(2))):
                with store.open_input_file(path) as file:
                    own = TokenFile(file)
                    ids, starts = own.documents(0, own.n_docs)
                    for a, b in _ranges(starts, _READ):
                        data = own.tokens(int(starts[a]), int(starts[b])).astype("<u4").tobytes()
                        cut = ((starts[a:b + 1] - starts[a]) * 4).tolist()
                        crc = [zlib.crc32(memoryview(data)[x:y]) for x, y in zip(cut, cut[1:])]
                        columns = ids[a:b], starts[a:b] + base, np.diff(starts[a:b + 1]), crc
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    files = manifest(spark, folder).select("path", "base")
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    store = scratch_path(spark, "tokens")
    write(table(spark, folder, "documents"), store)
    return read(spark, store)
