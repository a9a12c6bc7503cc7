"""Near duplicates by SimHash, with candidates pruned by the pigeonring principle.

A 64-bit fingerprint is cut into seven segments laid out as a ring. If two fingerprints differ in at most four
bits, then by the pigeonring principle some segment starts a chain in which every prefix of l segments differs in
at most floor(4 l / 7) bits. The first five segments of such a chain differ in at most two bits, so three of them
are equal, the first one included; a table keyed by each set of three segments (27 bits) therefore meets every
linked pair. Pairs that meet are tested along the ring first, and by full Hamming distance only if a chain holds.

Copies are folded before any pairing: the work is on distinct fingerprints. Buckets with two fingerprints are
read off an aggregate, larger ones are compared inside one task which returns a spanning forest of their links,
never all pairs. Buckets beyond ``BUCKET`` fingerprints are never gathered: two fingerprints are at most four bits
apart exactly if both are at most two bits from some common value, so each of their fingerprints is joined to the
2,081 values around it and the components of that table are the same.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from cilens.llm.common import cut_lineage, map_rows, table, whole_text
from cilens.llm.components import components
from cilens.session import small

SHINGLE_WORDS = 4
MOST_BITS = 4
#: Widths of the ring's segments, lowest bits first.
SEGMENTS = (10, 9, 9, 9, 9, 9, 9)
#: Distinct fingerprints of a bucket that one task compares; larger buckets go through values around them.
BUCKET = 4096
#: Size of the written table of larger buckets up to which it is sent to the tasks; beyond it is joined by a shuffle.
SENT_BYTES = 16 << 20
_SEED = 42
_BLOCK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE_WORDS) -> int:
    """The fingerprint as a signed 64-bit integer. ASCII letters are lower-cased, words end at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    bits = np.zeros(64, np.int64)
    for a in range(0, n, _BLOCK):
        hashes = np.array([digest(joined[s:e], _SEED) for s, e in zip(starts[a:a + _BLOCK], ends[a:a + _BLOCK])], dtype="<u8")
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * bits > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, h, fp) for every row of ``docs``: h is xxhash64 of the text and tells rows with one id apart.

    A null text is empty, an empty text has fingerprint zero.
    """
    def work(cols):
        return {"doc_id": cols["doc_id"], "h": cols["h"], "fp": [fingerprint(t, shingle) for t in cols["t"].to_pylist()]}

    whole = whole_text(docs, text)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(whole).alias("h"), whole.alias("t"))
    return map_rows(rows, work, "doc_id bigint, h bigint, fp bigint")


def _masks() -> list[int]:
    at = np.concatenate(([0], np.cumsum(SEGMENTS)))
    return [((1 << SEGMENTS[k]) - 1) << int(at[k]) for k in range(len(SEGMENTS))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _patterns() -> list[int]:
    """Masks of the segment triples that chains of five segments can leave equal."""
    ring, masks, found = len(SEGMENTS), _masks(), set()
    quota = [MOST_BITS * (k + 1) // ring for k in range(5)]
    for start in range(ring):
        for rest in combinations(range(1, 5), 2):
            equal = {0, *rest}
            if all(sum(k not in equal for k in range(upto + 1)) <= quota[upto] for upto in range(5)):
                found.add(frozenset((start + k) % ring for k in equal))
    return [_signed(sum(masks[k] for k in one)) for one in sorted(found, key=sorted)]


def ring_holds(x: np.ndarray) -> np.ndarray:
    """Whether some chain around the ring keeps its proportional budgets; x: the differing bits of pairs, unsigned."""
    ring = len(SEGMENTS)
    counts = np.stack([np.bitwise_count(x & np.uint64(m)).astype(np.int16) for m in _masks()])
    quota = (MOST_BITS * np.arange(1, ring + 1) // ring)[:, None]
    held = np.zeros(len(x), bool)
    for start in range(ring):
        held |= (np.cumsum(np.roll(counts, -start, axis=0), axis=0) <= quota).all(axis=0)
    return held


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of unsigned fingerprints link: the ring prunes, the full distance decides."""
    x = a ^ b
    out = np.zeros(len(x), bool)
    left = np.flatnonzero(np.bitwise_count(x & np.uint64(0xFFFFFFFF)) <= MOST_BITS)
    left = left[ring_holds(x[left])]
    out[left] = np.bitwise_count(x[left]) <= MOST_BITS
    return out


def forest(values: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what belongs together within each bucket; ``values`` holds the buckets one after another."""
    total = len(values)
    left = np.repeat(np.cumsum(size), size) - np.arange(total)  # members from here to the end of the bucket
    root = np.arange(total)
    a_out, b_out = [], []
    live = np.arange(total)
    for step in range(1, int(size.max(initial=0))):
        live = live[left[live] > step]  # small buckets are done after few steps
        at = live[root[live] != root[live + step]]
        at = at[linked(values[at], values[at + step])]
        if not len(at):
            continue
        a_out.append(at)
        b_out.append(at + step)
        while True:  # each tree takes the smallest root that it meets
            x, y = root[at], root[at + step]
            if (x == y).all():
                break
            low = np.minimum(x, y)
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            while (root != (up := root[root])).any():
                root = up
    if not a_out:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return values[np.concatenate(a_out)], values[np.concatenate(b_out)]


def _around() -> list[int]:
    """Zero and the masks of one and two bits."""
    one = [1 << k for k in range(64)]
    return [0, *map(_signed, one), *(_signed(a | b) for a, b in combinations(one, 2))]


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links between the distinct fingerprints ``prints`` (fp); their components are those of all links."""
    keyed = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).cast("tinyint").alias("p"), F.col("fp").bitwiseAND(F.lit(mask)).alias("k")) for k, mask in enumerate(_patterns())
    ])).alias("s")).select("fp", "s.p", "s.k")
    buckets = cut_lineage(keyed.groupBy("p", "k").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))

    def pairs(cols):
        a, b = (np.asarray(cols[c]).view(np.uint64) for c in "ab")
        keep = linked(a, b)
        return {"a": a[keep].view(np.int64), "b": b[keep].view(np.int64)}

    def compare(cols):
        lists = cols["fps"]
        a, b = forest(np.asarray(lists.flatten()).view(np.uint64), np.diff(np.asarray(lists.offsets)))
        return {"a": a.view(np.int64), "b": b.view(np.int64)}

    two = map_rows(buckets.where("n = 2").select("a", "b"), pairs, "a bigint, b bigint")
    # few fingerprints share a bucket with two others: they are picked out before the shuffle, not by it
    larger = small(cut_lineage(buckets.where(f"n > 2 and n <= {bucket}").select("p", "k")), SENT_BYTES)
    more = map_rows(keyed.join(larger, ["p", "k"])
                    .groupBy("p", "k").agg(F.collect_list("fp").alias("fps")).select("fps"), compare, "a bigint, b bigint")
    found = two.union(more)
    hot = buckets.where(f"n > {bucket}").select("p", "k")
    if not hot.isEmpty():
        crowded = cut_lineage(keyed.join(hot, ["p", "k"]).select("fp").distinct())
        near = crowded.select("fp", F.explode(F.lit(_around())).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("x"))
        centre = near.groupBy("x").agg(F.min("fp").alias("b"), F.max("fp").alias("c")).where("b <> c").select("x", "b")
        found = found.union(near.join(centre, "x").where("fp <> b").select(F.col("fp").alias("a"), "b"))
    return found.distinct()


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = SHINGLE_WORDS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, h, fp, root, component_id) for every row of ``docs``; root names the component, h is as in ``fingerprints``.

    component_id is the smallest doc_id reachable over links, the row's own included; null ids count only where a
    component has no other. Empty and blank texts share fingerprint zero and form one group. Repeated rows give
    repeated results; an empty table gives none; other columns of ``docs`` are not read.
    """
    prints = cut_lineage(fingerprints(docs, text, shingle))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), bucket))
    named = cut_lineage(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(smallest, "root").select("fp", "root", "component_id")
    return prints.join(classes, "fp").select("doc_id", "h", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", shingle: int = SHINGLE_WORDS, bucket: int = BUCKET) -> DataFrame:
    """One row of ``docs`` from each group of near duplicates, all columns: that with the smallest id.

    Rows without an id come last, of equal ids the one whose text has the smallest hash is taken, and of equal rows
    any one.
    """
    return least_of_each(docs, near_duplicates(docs, text, shingle, bucket), text)


def least_of_each(docs: DataFrame, named: DataFrame, text: str = "text") -> DataFrame:
    """The row of ``docs`` that ``one_of_each`` takes from each group of ``named`` (doc_id, h, root)."""
    nobody = F.lit(-(1 << 63))
    best = named.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", nobody).alias("i"), "h")).alias("b"))
    kept = best.select(F.col("b.i").alias("__near_id"), F.col("b.h").alias("__near_h"))
    keyed = docs.withColumns({"__near_id": F.coalesce(docs["doc_id"].cast("bigint"), nobody), "__near_h": F.xxhash64(whole_text(docs, text))})
    keys = ["__near_id", "__near_h"]
    return keyed.join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys)


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
