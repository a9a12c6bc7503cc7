"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters, of digits and of one punctuation mark. A document's features are hashed token unigrams,
token bigrams (a token that repeats the one before, or the one before that, has a feature of its own) and trigrams
of token shapes; each feature weighs its share of the document's n-grams. The score is the sparse dot product with
the trained weights, put through the logistic function.

Fitting takes a bounded sample of labelled rows, ``SAMPLE_ROWS`` on average, drawn by a hash of the id: their sparse
rows go to one task, which makes a few passes of per-coordinate updates and returns the weights, a vector of fixed
size. Scoring is one pass over all rows without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cilens.llm.common import LOWER, STEP_BYTES, blocks, map_rows, mix, runs, slice_hashes, steps, table, whole_text

SAMPLE_ROWS = 4000
BITS = 18
SCALE = 12.0
PASSES = 3
ALPHA, BETA, L1, L2 = 0.6, 1.0, 1e-4, 1e-2
_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, shape) of the tokens of a buffer."""
    start, end, kind = runs(data)
    upper = np.concatenate(([0], np.cumsum((data >= 65) & (data < 91))))
    small = np.concatenate(([0], np.cumsum((data >= 97) & (data < 123))))
    shape = kind.astype(np.uint64) + np.uint64(16)
    letters = kind == 1
    has_upper, has_small = upper[end] > upper[start], small[end] > small[start]
    shape[letters] = (1 + has_upper[letters] + 2 * has_small[letters] + 4 * (end - start == 1)[letters]).astype(np.uint64)
    return start, slice_hashes(LOWER[data], start, end), shape


def _features(h: np.ndarray, shape: np.ndarray, new: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position of the first token, bucket) of each n-gram; ``new`` marks tokens that begin a document."""
    n = len(h)
    to_bucket = np.uint64(64 - BITS)
    yield np.arange(n), (mix(h ^ _SALTS[0]) >> to_bucket).astype(np.int64)
    at = np.flatnonzero(~new[1:]) if n else np.empty(0, np.int64)
    pair = mix(h[at] * _SALTS[1] + h[at + 1])
    pair[h[at] == h[at + 1]] = mix(_SALTS[1:2])[0] if n else 0
    yield at, (pair >> to_bucket).astype(np.int64)
    third = at[:-1][at[1:] == at[:-1] + 1]
    yield third, (mix((shape[third] << np.uint64(40)) + (shape[third + 1] << np.uint64(20)) + shape[third + 2] + _SALTS[2]) >> to_bucket).astype(np.int64)
    again = third[h[third] == h[third + 2]]
    yield again, np.full(len(again), mix(_SALTS[3:4])[0] >> to_bucket, np.int64)


def documents_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, shape) of all tokens of some texts."""
    docs, hashes, shapes = [], [], []
    for a, b in steps(map(len, texts)):
        if b == a + 1 and len(texts[a]) > STEP_BYTES:
            for block in blocks(texts[a]):
                start, h, shape = _tokens(np.frombuffer(block, np.uint8))
                docs.append(np.full(len(start), a))
                hashes.append(h)
                shapes.append(shape)
        else:
            data = np.frombuffer(b"\n".join(texts[a:b]), np.uint8)
            start, h, shape = _tokens(data)
            ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
            docs.append(a + np.searchsorted(ends, start, side="right"))
            hashes.append(h)
            shapes.append(shape)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return join(docs, np.int64), join(hashes, np.uint64), join(shapes, np.uint64)


def dot_products(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """The linear score of each text, bias included; the bias stands after the hashed weights."""
    out = np.full(len(texts), weights[-1])
    for a, b in steps(map(len, texts)):
        doc, h, shape = documents_tokens(texts[a:b])
        if len(doc):
            new = np.concatenate(([True], doc[1:] != doc[:-1]))
            count = np.bincount(doc, minlength=b - a)
            for at, bucket in _features(h, shape, new):
                out[a:b] += SCALE * np.bincount(doc[at], weights[bucket], b - a) / np.maximum(count, 1)
    return out


def sparse_row(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and their values."""
    doc, h, shape = documents_tokens([text])
    if not len(doc):
        return np.empty(0, np.int32), np.empty(0, np.float32)
    new = np.zeros(len(doc), bool)
    new[0] = True
    bucket, count = np.unique(np.concatenate([b for _, b in _features(h, shape, new)]), return_counts=True)
    return bucket.astype(np.int32), (SCALE * count / len(doc)).astype(np.float32)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Weights after ``PASSES`` passes over sparse rows (buckets, values, label)."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weight(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    rows = [(np.append(i, size - 1), np.append(x, 1.0), y) for i, x, y in rows]
    for _ in range(PASSES):
        for i, x, y in rows:
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weight(np.arange(size))


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves remainder 1 by 3; a null id reads as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights learned from about ``rows`` labelled documents outside the held-out third.

    Null labels and documents with contradicting labels do not teach; with nothing to learn from, all weights are 0.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2").select("doc_id", "y"))
    share = min(1.0, rows / max(1, known.count()))
    # the sample has a fixed size, so it can be sent to every task
    chosen = F.broadcast(known.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))))
    taught = docs.select("doc_id", whole_text(docs, text).alias("t")).join(chosen, "doc_id").select("doc_id", "t", "y")

    def sparse(cols):
        made = [sparse_row(t.encode("utf-8", "surrogatepass")) for t in cols["t"].to_pylist()]
        return {"doc_id": cols["doc_id"], "y": [float(y) for y in cols["y"].to_pylist()], "i": [m[0] for m in made], "x": [m[1] for m in made]}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            lists = [[np.asarray(v.values) for v in batch.column(k)] for k in (2, 3)]
            found += zip(batch.column(0).to_pylist(), *lists, batch.column(1).to_pylist())
        order = sorted(range(len(found)), key=lambda k: (found[k][0] * 0x9E3779B97F4A7C15 % (1 << 64), found[k][3], len(found[k][1]), found[k][1].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([follow_the_leader([found[k][1:] for k in order]).tobytes()], pa.binary())], names=["w"])

    sparse_rows = map_rows(taught, sparse, "doc_id bigint, y double, i array<int>, x array<float>")
    done = sparse_rows.repartition(1).mapInArrow(learn, "w binary").first()  # no row where Spark knows that nothing teaches
    return np.frombuffer(done["w"]) if done else np.zeros((1 << BITS) + 1)


def probabilities(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    found = [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    return 1 / (1 + np.exp(-np.clip(dot_products(found, weights), -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1; a column of that name is replaced.

    Null and empty texts get the score of the bias alone. Rows are scored one by one: repeated rows, ties and null
    ids change nothing, and an empty table stays empty.
    """
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = pa.array(probabilities(batch.column(at), sent.value), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, p], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def good(docs: DataFrame, weights: np.ndarray, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``least``."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(probabilities(batch.column(at), sent.value) >= least))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
