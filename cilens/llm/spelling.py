"""Spelling variants grouped around their commonest form, by PartEnum signatures.

Two words one edit apart have letter multisets that, as binary vectors over (letter, how many so far), differ in at
most two places. The letters are partitioned into ``PARTS`` parts of about equal use; two places lie in at most two
parts, so such words agree on the letters of some choice of all parts but two. Each word emits one signature per
choice: the hash of its letters in the chosen parts, in the order of the word, which near words share as well and
which tells far more words apart than the multiset. Equal signatures are joined, and an edit distance of one decides.
The filter is exact: a hash may let a pair through, never drop one.

Texts are read once, in Arrow batches: runs of letters are found and checksummed as whole arrays, and only distinct
words with counts leave a step. What follows is work on the vocabulary alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from cilens.llm.common import LOWER, arrow_schema, cut_lineage, map_rows, mix, steps, table, whole_text

LEAST_CHARS = 7
LEAST_COUNT = 2
#: A form is at least so many times as frequent as its variant.
RATIO = 10
#: One in so many occurrences loses a code point.
DROP = 31
PARTS = 7
STEP = 4 << 20
_WIDE = 0xC3  # the first byte of U+00C0 to U+00FF, and of nothing else
_LONG_RUN = 64


def _crc_table() -> np.ndarray:
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, np.uint32(0xEDB88320) ^ (row >> np.uint32(1)), row >> np.uint32(1))
    return row


_CRC = _crc_table()
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True


def _letters(data: np.ndarray) -> np.ndarray:
    wide = data == _WIDE
    held = _ASCII[data] | wide
    held[1:] |= wide[:-1]
    return held


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text cut between runs of letters; a run longer than a step stays whole."""
    a = 0
    while len(text) - a > STEP:
        held = _letters(np.frombuffer(text, np.uint8, STEP, a))
        held[-1] |= held[-1] or text[a + STEP - 1] == _WIDE
        gaps = np.flatnonzero(~held)
        b = a + int(gaps[-1]) + 1 if len(gaps) else a + STEP
        while not len(gaps) and b < len(text):  # go on to the end of the run
            size = min(STEP, len(text) - b)
            rest = _letters(np.frombuffer(text, np.uint8, size + 1, b - 1))[1:]
            ends = np.flatnonzero(~rest)
            b += int(ends[0]) if len(ends) else size
            if len(ends):
                break
        yield text[a:b]
        a = b
    yield text[a:]


def _checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each slice, continued from the checksum ``before`` it."""
    size, out = end - start, np.empty(len(start), np.uint32)
    for k in np.flatnonzero(size > _LONG_RUN).tolist():
        out[k] = zlib.crc32(data[start[k]:end[k]].tobytes(), int(before[k]))
    short = np.flatnonzero(size <= _LONG_RUN)
    short = short[np.argsort(-size[short], kind="stable")]
    at, length, state = start[short], size[short], ~before[short]
    for k in range(int(length[0]) if len(length) else 0):
        m = int(np.searchsorted(-length, -k, side="left"))  # slices longer than k come first
        state[:m] = _CRC[(state[:m] ^ data[at[:m] + k]) & np.uint32(255)] ^ (state[:m] >> np.uint32(8))
    out[short] = ~state
    return out


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The slices of one buffer as strings."""
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at]))


def _words(heads: list[bytes], texts: list[bytes]) -> pa.Array:
    """Every run of letters that counts, lower-cased and with its code point dropped where the checksum says so."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    held = np.concatenate(([False], _letters(data), [False]))
    edge = np.flatnonzero(held[1:] != held[:-1])
    start, end = edge[::2], edge[1::2]
    wide = np.concatenate(([0], np.cumsum(data == _WIDE)))
    chars = end - start - (wide[end] - wide[start])
    keep = chars >= LEAST_CHARS
    start, end, chars = start[keep], end[keep], chars[keep]
    data = LOWER[data]
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    h = _checksums(data, start, end, np.array([zlib.crc32(x) for x in heads], np.uint32)[doc])
    cut = h % np.uint32(DROP) == 0
    odd = []
    for k in np.flatnonzero(cut & (chars > LEAST_CHARS)).tolist():
        run, at = data[start[k]:end[k]].tobytes().decode(), int(h[k]) % int(chars[k])
        odd.append(run[:at] + run[at + 1:])
    return pa.concat_arrays([_gather(data, start[~cut], end[~cut]), pa.array(odd, pa.large_string())])


def _counted(cols: dict) -> Iterator[dict]:
    heads = [b":" if i is None else f"{i}:".encode() for i in cols["id"].to_pylist()]
    raw = [t.encode("utf-8", "replace") for t in cols["text"].to_pylist()]
    for a, b in steps(map(len, raw), STEP):
        for texts in ([p] for p in _pieces(raw[a])) if b == a + 1 and len(raw[a]) > STEP else (raw[a:b],):
            words = _words(heads[a:b], texts)
            if len(words):
                found = pc.value_counts(words)
                yield {"word": found.field("values").cast(pa.string()), "n": found.field("counts")}


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n): the words of ``LEAST_CHARS`` and more code points that occur ``LEAST_COUNT`` times or more."""
    rows = docs.select(F.col(key).cast("string").alias("id"), whole_text(docs, text).alias("text"))
    found = map_rows(rows, _counted, "word string, n bigint")
    return cut_lineage(found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT))


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, the word each belongs to)."""
    texts = words.to_pylist()
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return flat, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def balanced_parts(words: DataFrame, parts: int = PARTS) -> np.ndarray:
    """The part of each code point up to U+00FF: letters are dealt out by falling use, each to the part least used so far."""
    def used(cols):
        n = np.bincount(np.minimum(_flat(cols["word"])[0], 255), minlength=256)
        return {"letter": np.flatnonzero(n), "n": n[n > 0]}

    total = map_rows(words.select("word"), used, "letter int, n bigint").groupBy("letter").agg(F.sum("n").alias("n"))
    part, load = np.zeros(256, np.int64), [0] * parts
    for r in sorted(total.collect(), key=lambda r: (-r["n"], r["letter"])):  # at most 256 rows
        part[r["letter"]] = least = load.index(min(load))
        load[least] += r["n"]
    return part


def signatures(words: DataFrame, part: np.ndarray, parts: int = PARTS) -> DataFrame:
    """(sig, word, n): for each choice of all parts but two, the hash of a word's letters in the chosen parts."""
    ddl = "sig bigint, word string, n bigint"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = batch.column(0), batch.column(1)
            flat, row = _flat(word)
            if not len(flat):
                continue
            value, where = mix(flat.astype(np.uint64) + np.uint64(1)), part[np.minimum(flat, 255)]
            first = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1))
            power = np.full(int(np.bincount(row).max()) + 1, 0x9E3779B97F4A7C15, np.uint64).cumprod()  # odd, so no power loses bits
            for k, out in enumerate(combinations(range(parts), 2)):
                held = (where != out[0]) & (where != out[1])
                upto = np.cumsum(held)
                rank = upto - np.repeat(upto[first] - held[first], np.bincount(row))  # place among the letters held
                sums = np.add.reduceat(np.where(held, value * power[rank], np.uint64(0)), first)
                sig = mix(sums + np.uint64((k + 1) * 0xD6E8FEB86659FD93 % (1 << 64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sig), word, n], schema=schema)

    return words.select("word", "n").mapInArrow(run, ddl)


def _one_edit(cols: dict) -> dict | None:
    """The pairs that exactly one inserted, deleted or replaced code point parts; their lengths differ by one at most."""
    a, b = cols["a"].to_pylist(), cols["b"].to_pylist()
    size_a, size_b = np.array(list(map(len, a))), np.array(list(map(len, b)))
    swap = size_a > size_b
    short, long = [y if s else x for x, y, s in zip(a, b, swap)], [x if s else y for x, y, s in zip(a, b, swap)]
    size = np.minimum(size_a, size_b)
    points = lambda words: np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    first, x, y = np.concatenate(([0], np.cumsum(size)[:-1])), points(short), points(long)
    at = np.arange(len(x)) - np.repeat(first, size)
    other = np.repeat(np.cumsum(np.maximum(size_a, size_b)) - np.maximum(size_a, size_b), size) + at
    differ = x != y[other]
    replaced = (size_a == size_b) & (np.add.reduceat(differ.astype(np.int64), first) == 1)
    # one more code point: equal up to some place, and from there on equal to the rest after it
    shifted = x != y[np.minimum(other + 1, len(y) - 1)]
    begin = np.minimum.reduceat(np.where(differ, at, np.repeat(size, size)), first)
    rest = np.maximum.reduceat(np.where(shifted, at, -1), first)
    held = np.flatnonzero(replaced | ((size_a != size_b) & (begin > rest)))
    return {name: column.take(pa.array(held)) for name, column in cols.items()} if len(held) else None


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(a, na, b, nb) with a < b: the pairs of words that one inserted, deleted or replaced code point parts, each once.

    One edit leaves the first or the second half of the shorter word as it is, which is cheap to see in the join.
    """
    signed = signatures(words, balanced_parts(words, parts), parts)
    a, b = signed.toDF("sig", "a", "na"), signed.toDF("sig", "b", "nb")
    size_a, size_b = F.char_length("a"), F.char_length("b")
    less = F.least(size_a, size_b)
    head, tail = F.shiftright(less, 1), F.shiftright(less - 1, 1) + 1  # together as long as the shorter word
    half = (F.left("a", head) == F.left("b", head)) | (F.right("a", tail) == F.right("b", tail))
    pairs = a.join(b, "sig").where((F.col("a") < F.col("b")) & (F.abs(size_a - size_b) <= 1) & half).select("a", "na", "b", "nb")
    return map_rows(pairs, _one_edit, "a string, na bigint, b string, nb bigint").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word with a form (word, form), by following forms to the last one.

    Paths are doubled each round. A form is at least ``RATIO`` times as frequent, so paths have fewer than 20 steps.
    """
    chain = cut_lineage(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = chain.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        moved = cut_lineage(chain.join(ahead, chain["root"] == ahead["_word"], "left"))
        if moved.where("_root is not null").isEmpty():
            return chain
        chain = moved.select("word", F.coalesce("_root", "root").alias("root"))


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts.

    A null text has no words, a null id is written as nothing, repeated rows count again, ties of forms go to the word
    that is smallest by code points. An empty table gives no rows; further columns are not read.
    """
    words = vocabulary(docs, text, key)
    pairs = cut_lineage(near_pairs(words))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")),
                                          F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))).alias("l")).select("l.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("o"), F.col("near").alias("w"))).alias("best"))
    taken = -F.col("best.o") >= RATIO * F.col("n")
    forms = cut_lineage(words.join(best, "word", "left").select("word", F.when(taken, F.col("best.w")).alias("form"), "n",
                                                                F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(taken, -F.col("best.o")).alias("form_n")))
    last = roots(forms).select(F.col("word").alias("_word"), "root")
    return (forms.join(last, forms["word"] == last["_word"], "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return variants(table(spark, folder, "documents"))
