"""Benchmark decontamination: the q-gram lemma in overlapping diagonal bands, verified by banded alignment.

Texts and items are lower-cased and every run of anything but letters and digits becomes one space. A document is
contaminated by an item if some stretch of it is within ``floor(RATE * n)`` edits of the item's n bytes. By the
q-gram lemma such a stretch shares at least n - q + 1 - k q of the item's q-grams, and their diagonals (place in the
document less place in the item) span at most 2 k + 1. Bands of twice that width, each overlapping the next by half,
therefore hold all of them: bands with fewer shared grams are dropped, the others are aligned within the band.

All documents are read once per block of items. Items are sent to the tasks in blocks of at most ``BLOCK_BYTES``, so
what is sent stays bounded however many there are, and no document is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cilens.llm.common import map_rows, steps, table, whole_text

Q = 8
RATE = 0.1
#: Shorter items are too common to be searched for inside documents; they match documents that equal them.
LEAST_CHARS = 32
BLOCK_BYTES = 8 << 20
SCHEMA = "doc_id bigint, item_id bigint, edits int, start bigint, end bigint"
_BITS = 22
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = bytes(b if b >= 128 or bytes([b]).isalnum() else 32 for b in range(256))
_GAP = re.compile(rb"  +")


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normal(text: str) -> bytes:
    return _GAP.sub(b" ", lowered(text).encode("utf-8", "surrogatepass").translate(_PLAIN)).strip(b" ")


def places(text: str) -> np.ndarray:
    """For each byte of normal(text): the place, in code points, that it stems from."""
    raw = lowered(text).encode("utf-8", "surrogatepass")
    plain = np.frombuffer(raw.translate(_PLAIN), np.uint8)
    point = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
    blank = plain == 32
    kept = ~blank
    kept[1:] |= blank[1:] & ~blank[:-1]
    if len(kept):
        kept[: np.argmax(~blank) if (~blank).any() else len(kept)] = False
    at = np.flatnonzero(kept)
    while len(at) and plain[at[-1]] == 32:
        at = at[:-1]
    return point[at]


def grams(data: np.ndarray) -> np.ndarray:
    """The Q = 8 bytes at each place as one integer."""
    out = np.empty(max(0, len(data) - Q + 1), "<u8")
    for shift in range(min(Q, len(out))):
        count = (len(data) - shift) // 8
        out[shift::8] = data[shift:shift + 8 * count].view("<u8")
    return out


class Items:
    """A block of benchmark items, indexed by q-gram."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.texts, self.short = [], [], {}
        for item_id, text in rows:
            plain = normal(text)
            if len(plain) >= LEAST_CHARS:
                self.ids.append(item_id)
                self.texts.append(plain)
            elif plain:
                self.short.setdefault(plain, []).append(item_id)
        size = np.array([len(t) for t in self.texts], np.int64)
        self.budget = np.minimum((RATE * size).astype(np.int64), (size - Q) // Q)
        self.need = size - Q + 1 - self.budget * Q
        self.width = 2 * self.budget + 1
        all_grams = [grams(np.frombuffer(t, np.uint8)) for t in self.texts]
        gram = np.concatenate(all_grams) if all_grams else np.empty(0, "<u8")
        item = np.repeat(np.arange(len(self.texts)), [len(g) for g in all_grams])
        place = np.concatenate([np.arange(len(g)) for g in all_grams]) if all_grams else np.empty(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.item, self.place = item[order], place[order]
        self.gram, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self._slot(self.gram)] = True

    @staticmethod
    def _slot(gram: np.ndarray) -> np.ndarray:
        return ((gram * _SPREAD) >> np.uint64(64 - _BITS)).astype(np.int64)

    def bands(self, data: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal) of each band that holds enough shared grams."""
        found = grams(data)
        at = np.flatnonzero(self.seen[self._slot(found)])
        if not len(at) or not len(self.gram):
            return []
        slot = np.minimum(np.searchsorted(self.gram, found[at]), len(self.gram) - 1)
        exact = self.gram[slot] == found[at]
        at, slot = at[exact], slot[exact]
        count = self.count[slot]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        post = np.repeat(self.first[slot], count) + step
        item = self.item[post]
        half = (np.repeat(at, count) - self.place[post]) // self.width[item]
        low = half.min(initial=0) - 1
        span = half.max(initial=0) - low + 2
        key, hits = np.unique(item * span + (half - low), return_counts=True)
        # a band is two neighbouring halves: each half also counts for the band that begins one half earlier
        both, where = np.unique(np.concatenate((key, key - 1)), return_inverse=True)
        total = np.bincount(where, np.concatenate((hits, hits)))
        held = both[total >= self.need[both // span]]
        if not len(held):
            return []
        # what is left is counted again by distinct places of the item: a gram that a document repeats counts once
        key = item * span + (half - low)
        pairs = []
        for back in (0, 1):
            slot = np.minimum(np.searchsorted(held, key - back), len(held) - 1)
            inside = held[slot] == key - back
            pairs.append(slot[inside] << 32 | self.place[post[inside]])
        total = np.bincount(np.unique(np.concatenate(pairs)) >> 32, minlength=len(held))
        held = held[total >= self.need[held // span]]
        item = held // span
        return list(zip(item.tolist(), ((held % span + low) * self.width[item]).tolist()))

    def align(self, item: int, diagonal: int, data: bytes) -> tuple[int, int, int] | None:
        """(edits, start, end) of the closest stretch within the band that begins at ``diagonal``, if close enough."""
        text, k, w = self.texts[item], int(self.budget[item]), int(self.width[item])
        low = diagonal - k
        a, b = max(0, low), min(len(data), diagonal + 2 * w + k + len(text))
        exact = data.find(text, a, b)
        if exact >= 0:
            return 0, exact, exact + len(text)
        pattern = np.frombuffer(text, np.uint8)
        region = np.zeros(2 * w + 2 * k + len(text), np.uint8)  # outside the document: a byte that no text holds
        region[a - low:b - low] = np.frombuffer(data[a:b], np.uint8)
        edits, offset = banded(pattern, region, 2 * w + 2 * k + 1, False)
        if edits > k:
            return None
        end = offset + len(text)
        back = np.concatenate((np.zeros(2 * k + 1, np.uint8), region[:end]))[::-1][: len(text) + k]
        _, short = banded(pattern[::-1], np.concatenate((np.zeros(k, np.uint8), back, np.zeros(k + 1, np.uint8))), 2 * k + 1, True)
        return edits, max(0, low + end - (len(text) + short - k)), min(len(data), low + end)


def banded(pattern: np.ndarray, region: np.ndarray, width: int, fixed: bool) -> tuple[int, int]:
    """Least edits between the pattern and a stretch of the region, and the diagonal where that alignment ends.

    Row i of the table holds places i .. i + width - 1 of the region. A stretch may begin anywhere in row 0, or only
    at its middle if ``fixed``. Of equal ends, the one closest to the pattern's length is taken if fixed, else the first.
    """
    step = np.arange(width)
    far = len(pattern) + width
    row = np.where(step == width // 2, 0, np.abs(step - width // 2) + (step < width // 2) * far) if fixed else np.zeros(width, np.int64)
    for i in range(len(pattern)):
        other = np.full(width, 1)
        part = region[i:i + width]
        other[: len(part)] = part != pattern[i]
        new = np.minimum(row + other, np.append(row[1:], far) + 1)
        row = np.minimum.accumulate(new - step) + step
    best = int(row.min())
    at = np.flatnonzero(row == best)
    return best, int(at[np.argmin(np.abs(at - width // 2))] if fixed else at[0])


def search(texts: list[str], items: Items) -> list[tuple[int, int, int, int, int]]:
    """(row, item_id, edits, start, end) for each text and item that it holds, the closest and then first stretch."""
    plain = [normal(t) for t in texts]
    out = []
    for a, b in steps(map(len, plain)):
        # zero bytes between documents: no gram of an item holds one, so nothing matches across
        start = np.cumsum([0, *[len(t) + Q for t in plain[a:b]]])
        data = np.frombuffer(b"".join(t + b"\0" * Q for t in plain[a:b]), np.uint8)
        tasks: dict[tuple[int, int], list[int]] = {}
        for item, diagonal in items.bands(data):
            reach = np.arange(*np.searchsorted(start, [diagonal + 1, diagonal + 2 * int(items.width[item]) + len(items.texts[item])], side="left") - [1, 0])
            for doc in reach[(reach >= 0) & (reach < b - a)].tolist():
                tasks.setdefault((doc, item), []).append(diagonal - int(start[doc]))
        for (doc, item), diagonals in tasks.items():
            found = [m for m in (items.align(item, d, plain[a + doc]) for d in diagonals) if m]
            if found:
                edits, s, e = min(found)
                at = places(texts[a + doc])
                out.append((a + doc, items.ids[item], edits, int(at[s]), int(at[e - 1]) + 1))
    for row, t in enumerate(plain):
        out += [(row, i, 0, 0, len(texts[row])) for i in items.short.get(t, ())]
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator:
    """Broadcasts of the distinct items, about ``block_bytes`` of text in each."""
    asked = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), whole_text(benchmark).alias("t")).where("t <> ''").distinct()
    total = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = -(-total // block_bytes)
    for part in range(parts):
        block = asked.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(parts)) == part).orderBy("item_id", "t").collect()
        yield benchmark.sparkSession.sparkContext.broadcast([(r["item_id"], r["t"]) for r in block])


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, edits, start, end) per document and item found in it; start and end count code points.

    Null and empty texts and items match nothing. Repeated items count once, repeated documents each for themselves;
    of several stretches the one with fewest edits, then the first, is given. An empty table gives no rows. Other
    columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text(docs, text).alias("t"))
    found = []
    for sent in _blocks(benchmark, block_bytes):
        def work(cols, sent=sent):
            ids = cols["doc_id"].to_pylist()
            hits = search(cols["t"].to_pylist(), _index(sent))
            return dict(zip(("doc_id", "item_id", "edits", "start", "end"), zip(*[(ids[h[0]], *h[1:]) for h in hits]))) if hits else None

        found.append(map_rows(rows, work, SCHEMA))
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; decided row by row, without a shuffle."""
    at = docs.columns.index(text)
    for sent in _blocks(benchmark, block_bytes):
        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaks = {h[0] for h in search([t or "" for t in batch.column(at).to_pylist()], _index(sent))}
                yield batch.filter(pa.array([k not in leaks for k in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


_BUILT: dict[int, Items] = {}


def _index(sent) -> Items:
    """The index of a block, kept by the worker as long as it works on that block."""
    rows = sent.value
    if id(rows) not in _BUILT:
        _BUILT.clear()
        _BUILT[id(rows)] = Items(rows)
        _BUILT[id(rows)].rows = rows  # held, so that no other block can take its place in memory
    return _BUILT[id(rows)]


def query(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
