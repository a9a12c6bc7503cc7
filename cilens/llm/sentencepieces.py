"""SentencePiece encoding and decoding that keeps the place of every piece in the original bytes.

Normalisation follows the model's compiled character map: at each place the longest key of its double-array trie is
replaced by the mapped text, a character without a key stays, and white space is escaped and trimmed as the model
says. Each byte of the result records the original byte it stems from. The library cuts the text into pieces; their
lengths add up over the normalised bytes, and the record projects each piece to its original byte span, end exclusive.
A character that is spelled in byte pieces belongs to the last of them; the others are empty spans at its start.

Models without a character map are normalised by array operations over whole texts. Each task reads the model file
once. There is no shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F
from sentencepiece import sentencepiece_model_pb2

from cilens.llm.common import map_rows, steps, table, whole_text

MODEL = "piece_bpe_32k.model"
SPACE = "▁".encode()
_STEP = 1 << 20


@lru_cache(maxsize=4)
def character_map(compiled: bytes) -> dict[bytes, bytes]:
    """Keys and replacements of a compiled character map: the size of a double-array trie, the trie, the replacements."""
    if not compiled:
        return {}
    size = struct.unpack_from("<I", compiled)[0]
    units = struct.unpack_from(f"<{size // 4}I", compiled, 4)
    texts = compiled[4 + size:]
    out: dict[bytes, bytes] = {}

    def child_base(at: int) -> int:
        unit = units[at]
        return at ^ (unit >> 10 << (unit >> 6 & 8))

    stack = [(child_base(0), b"")]
    while stack:
        base, key = stack.pop()
        for byte in range(1, 256):
            at = base ^ byte
            if at < len(units) and units[at] & 0x800000FF == byte:
                if units[at] >> 8 & 1:
                    value = units[child_base(at)] & 0x7FFFFFFF
                    out[key + bytes([byte])] = texts[value:texts.index(b"\0", value)]
                stack.append((child_base(at), key + bytes([byte])))
    return out


@dataclass
class Normaliser:
    """The normalisation a model asks for, with the original place of every byte of its result."""

    replaced: dict[bytes, bytes] = field(default_factory=dict)
    kept: frozenset[bytes] = frozenset()
    dummy_prefix: bool = True
    trim: bool = False
    escape: bool = True
    suffix: bool = False

    def __post_init__(self):
        self.longest = max(map(len, self.replaced), default=0)
        self.longest_kept = max(map(len, self.kept), default=0)
        self.space = SPACE if self.escape else b" "

    @classmethod
    def of(cls, model: sentencepiece_model_pb2.ModelProto) -> Normaliser:
        spec = model.normalizer_spec
        kept = frozenset(p.piece.encode() for p in model.pieces if p.type == p.USER_DEFINED)
        return cls(character_map(spec.precompiled_charsmap), kept, spec.add_dummy_prefix, spec.remove_extra_whitespaces,
                   spec.escape_whitespaces, model.trainer_spec.treat_whitespace_as_suffix)

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each the original byte it stems from; one more entry holds the end."""
        if self.replaced or self.kept or self.trim or self.suffix:
            return self._by_prefixes(text)
        data = np.frombuffer(text, np.uint8)
        if not len(data):
            return b"", np.zeros(1, np.int64)
        lead = (data & 0xC0) != 0x80
        start = np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0))
        at = np.repeat(start, np.where(data == 32, len(self.space), 1))
        head = [0] * (len(self.space) * self.dummy_prefix)
        return self.space * self.dummy_prefix + text.replace(b" ", self.space), np.concatenate((head, at, [len(data)])).astype(np.int64)

    def _prefix(self, text: bytes, at: int) -> tuple[bytes, int]:
        """What the longest prefix of text[at:] becomes, and its length."""
        for size in range(min(self.longest_kept, len(text) - at), 0, -1):
            if text[at:at + size] in self.kept:
                return text[at:at + size], size
        for size in range(min(self.longest, len(text) - at), 0, -1):
            if (found := self.replaced.get(text[at:at + size])) is not None:
                return found, size
        lead = text[at]
        size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return text[at:at + size], size

    def _by_prefixes(self, text: bytes) -> tuple[bytes, np.ndarray]:
        at, out, origin = 0, bytearray(), []
        parts = []
        while at < len(text):
            part, size = self._prefix(text, at)
            parts.append((part, at))
            at += size
        if self.trim:
            first = next((k for k, (part, _) in enumerate(parts) if part != b" "), len(parts))
            parts = parts[first:]
        if not parts:
            return b"", np.zeros(1, np.int64)

        def add(piece: bytes, place: int) -> None:
            out.extend(piece)
            origin.extend([place] * len(piece))

        if self.dummy_prefix and not self.suffix:
            add(self.space, parts[0][1])
        blank = self.trim
        for part, place in parts:
            if blank:
                part = part.lstrip(b" ")
            if part:
                add(part.replace(b" ", self.space), place)
                blank = part.endswith(b" ")
            blank = blank and self.trim
        end = len(text)
        if self.trim:
            while out.endswith(self.space):
                end = origin[len(out) - len(self.space)]
                del out[-len(self.space):], origin[-len(self.space):]
        if self.dummy_prefix and self.suffix:
            add(self.space, end)
        return bytes(out), np.array([*origin, end], np.int64)


class Pieces:
    """A model with its normaliser and the normalised length of each piece."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            content = file.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(content)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.normalise = Normaliser.of(model)
        self.unknown = self.library.unk_id()
        self.size = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.names = [str(k) for k in range(len(model.pieces))]

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Original byte spans (start, end) of the pieces of a text."""
        plain, origin = self.normalise(text.encode("utf-8", "surrogatepass"))
        if self.unknown in ids:
            size = np.array([len(p.piece.encode()) for p in self.library.encode(text, return_type="proto").pieces], np.int64)
        else:
            size = self.size[np.array(ids, np.int64)]
        cut = np.concatenate(([0], np.cumsum(size)))
        if cut[-1] != len(plain):
            raise ValueError(f"{len(plain)} normalised bytes, but pieces of {cut[-1]}")
        return origin[cut[:-1]], origin[cut[1:]]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _encoded(cols, path: str):
    """(doc_ids, texts, their ids) of runs of rows with about a megabyte of text each."""
    doc_ids, texts = cols["doc_id"], cols["t"].to_pylist()
    for a, b in steps(map(len, texts), _STEP):
        yield doc_ids[a:b], texts[a:b], pieces(path).library.encode(texts[a:b], num_threads=1)


def _rows(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text(docs, text).alias("t"))


def encode(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, ids, starts, ends, round_trip) for every row: piece ids, their original byte spans, and whether the ids
    decode to the text.

    ``model`` is a path that every executor has; by default the public model. A null text is empty and has no pieces.
    Repeated rows and null ids are kept, an empty table gives no rows, other columns are not read.
    """
    path = model or public_tokenizers.path(MODEL)

    def work(cols):
        own = pieces(path)
        for doc_ids, texts, ids in _encoded(cols, path):
            spans = [own.spans(t, i) for t, i in zip(texts, ids)]
            yield {"doc_id": doc_ids, "ids": [np.array(i, np.int32) for i in ids], "starts": [s for s, _ in spans], "ends": [e for _, e in spans],
                   "round_trip": [own.library.decode(i) == t for t, i in zip(texts, ids)]}

    return map_rows(_rows(docs, text), work, "doc_id bigint, ids array<int>, starts array<bigint>, ends array<bigint>, round_trip boolean")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text, no ids an empty one."""
    path = model or public_tokenizers.path(MODEL)

    def work(cols):
        return {"doc_id": cols["doc_id"], "text": [None if i is None else pieces(path).library.decode(i) for i in cols["ids"].to_pylist()]}

    return map_rows(encoded.select("doc_id", "ids"), work, "doc_id bigint, text string")


def digests(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """What identifies the encoding of every row, the texts, ids and spans staying in the task that made them.

    (doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32); the last is the crc32 of all starts, then all ends,
    as little-endian 64-bit integers. Nulls, repeated rows and empty tables as in ``encode``.
    """
    path = model or public_tokenizers.path(MODEL)

    def work(cols):
        own = pieces(path)
        for doc_ids, texts, ids in _encoded(cols, path):
            spans = [own.spans(t, i) for t, i in zip(texts, ids)]
            yield {"doc_id": doc_ids, "n_tokens": list(map(len, ids)),
                   "ids_sha256": [hashlib.sha256(",".join([own.names[k] for k in i]).encode()).hexdigest() for i in ids],
                   "decoded_sha256": [hashlib.sha256(own.library.decode(i).encode()).hexdigest() for i in ids],
                   "spans_crc32": [zlib.crc32(e.astype("<i8").tobytes(), zlib.crc32(s.astype("<i8").tobytes())) for s, e in spans]}

    return map_rows(_rows(docs, text), work, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"))
