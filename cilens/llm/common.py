"""What the operators of this folder share: table access, work folders, batches and word hashes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cilens.session import cut_lineage, scratch_path  # noqa: F401  re-exported for the operators

#: Bytes of text that one vectorised step takes at a time.
STEP_BYTES = 2 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, folder: str) -> str:
    """A folder as Spark resolves it, in the form that pyarrow's file systems read: with scheme and whole path.

    A path without a scheme is one of the cluster's default file system, not of the machine that a task runs on.
    """
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return re.sub("^file:/+", "file:///", str(path.getFileSystem(hadoop).makeQualified(path).toString()))


def whole_text(df: DataFrame, column: str = "text") -> Column:
    """The text of a row, null read as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a DDL schema; made on the driver, where a session reads it."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def map_rows(df: DataFrame, work: Callable[[dict[str, pa.Array]], dict | Iterable[dict] | None], schema: str) -> DataFrame:
    """Run ``work`` over the columns of each Arrow batch; it returns the columns of the result, or several such sets."""
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                done = work({name: batch.column(k) for k, name in enumerate(batch.schema.names)})
                for out in [done] if isinstance(done, dict) else done or ():
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def steps(sizes: Iterable[int], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows into runs [a, b) of at most ``most`` bytes; a larger row stands alone."""
    a, held, b = 0, 0, 0
    for size in sizes:
        if held and held + size > most:
            yield a, b
            a, held = b, 0
        held += size
        b += 1
    if b > a:
        yield a, b


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, STEP_BYTES + 1024)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _POWERS[name] = np.cumprod(row, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], which depend on the bytes alone; slices lie anywhere in one buffer."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower, kinds = np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    kinds[[0x20, *range(9, 14)]] = 0
    kinds[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    kinds[48:58] = 2
    return lower, kinds


#: Bytes with A-Z lower-cased; kinds of bytes: 0 white space, 1 letters and all beyond ASCII, 2 digits, else the byte itself.
LOWER, KINDS = _tables()


def runs(data: np.ndarray, kinds: np.ndarray = KINDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, kind) of the longest runs of one kind other than 0."""
    kind = kinds[data]
    cut = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(data)])) if len(data) else np.zeros(1, np.int64)
    start, end = cut[:-1], cut[1:]
    held = kind[start] != 0
    return start[held], end[held], kind[start[held]]


def blocks(text: bytes, most: int = STEP_BYTES) -> Iterator[bytes]:
    """A long text in pieces that end at white space where there is any."""
    a = 0
    while len(text) - a > most:
        b = max(text.rfind(b" ", a, a + most), text.rfind(b"\n", a, a + most)) + 1
        b = b if b > a else a + most
        yield text[a:b]
        a = b
    yield text[a:]


#: A key is hot if it holds over one in so many rows; fewer keys than this can be.
HOT_SHARE = 1000
#: Parts that the rows of a hot key are dealt into.
HOT_PARTS = 64


def join_back(rows: DataFrame, values: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``values``, a row per key, null where a key has none.

    ``sizes`` (key, n) counts the rows per key. The fewer than ``HOT_SHARE`` keys that hold over one in ``HOT_SHARE``
    rows are sent to the tasks; their rows are dealt into ``HOT_PARTS`` parts, and their values are copied to each
    part, so that no task reads more than such a part of a key, however many rows it has.
    """
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = cut_lineage(sizes.where(F.col("n") * HOT_SHARE > total).select(F.col(key).alias("_hot")))
    mark = lambda df: df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    left = mark(rows).withColumn("_part", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(HOT_PARTS))).otherwise(F.lit(0)))
    right = mark(values).withColumn("_part", F.explode(F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.drop("_hot").join(right.drop("_hot"), [key, "_part"], "left").drop("_part")
