"""Whitening of embeddings with a covariance weighted by multiplicity.

Entries become whole numbers, floor(256 c), so equal vectors are equal bytes. Rows are grouped by vector; each distinct
vector enters the fit once with a weight, the number of its rows or one. Sums are exact integers. The covariance is a
weighted product of centred blocks, added up over tasks. Its leading unit eigenvectors, each divided by the root of its
eigenvalue, whiten every distinct vector once, and the results are joined back to the rows.

The driver holds one matrix of dimensions x dimensions; vectors themselves never leave the tasks. Vectors of different
lengths cannot share a covariance: each length is fitted on its own, as if it were a table of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cilens.llm.common import arrow_schema, cut_lineage, join_back, map_rows, table

SCALE = 256
COMPONENTS = 4
_LONG = 1 << 63
_WIDTHS = ((1 << 15, np.int16), (1 << 31, np.int32), (_LONG, np.int64))


def _packed(cols: dict) -> dict | None:
    """Vectors without nulls and non-finite entries as the narrowest integers that hold them, after a byte for their width."""
    ids, vectors, keep, out = cols["id"], cols["v"], [], []
    flat = vectors.values.to_numpy(zero_copy_only=False)
    bounds = vectors.offsets.to_numpy()
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(flat * SCALE)
        whole = np.clip(scaled, -float(_LONG), float(_LONG - 1024))  # beyond a long, its ends
        fine = np.isfinite(flat)
    bad = np.concatenate(([0], np.cumsum(~fine)))
    for k, known in enumerate(vectors.is_valid().to_pylist()):
        a, b = int(bounds[k]), int(bounds[k + 1])
        if known and bad[b] == bad[a]:
            x = whole[a:b].astype(np.int64)
            most = max(int(x.max()), -int(x.min()) - 1) if b > a else 0
            kind = next(kind for limit, kind in _WIDTHS if most < limit)
            keep.append(k)
            out.append(bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes())
    return {"id": ids.take(pa.array(keep, pa.int64())), "x": out} if keep else None


def unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<i{x[0]}", offset=1).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(packed, x, weights) of the vectors of one length at a time."""
    for batch in batches:
        packed, weights = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
        by_length: dict[int, list[int]] = {}
        vectors = [unpack(x) for x in packed]
        for k, x in enumerate(vectors):
            by_length.setdefault(len(x), []).append(k)
        for rows in by_length.values():
            yield [packed[k] for k in rows], np.stack([vectors[k] for k in rows]), weights[rows]


def _sums(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, j, s): exact weighted sums of each dimension j, and of the weights under j = -1."""
    held: dict[int, list[int]] = {}
    for _, x, w in _blocks(batches):
        d, most = x.shape[1], int(np.abs(x.astype(float)).max(initial=0)) + 1
        safe = most * int(w.sum()) < _LONG >> 1
        sums = [int(s) for s in (w @ x if safe else w.astype(object) @ x.astype(object))]
        old = held.setdefault(d, [0] * (d + 1))
        held[d] = [a + b for a, b in zip(old, [int(w.sum()), *sums])]
    for d, sums in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1), pa.int32()), pa.array(range(-1, d), pa.int32()), pa.array([str(s) for s in sums])], schema=schema)


def _products(schema: pa.Schema, means: dict[int, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, i, row): rows of the weighted sum of outer products of centred vectors, from the diagonal on."""
    held: dict[int, np.ndarray] = {}
    for _, x, w in _blocks(batches):
        centred = x - means[x.shape[1]]
        held[x.shape[1]] = held.get(x.shape[1], 0) + (centred * w[:, None]).T @ centred
    for d, sums in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([sums[i, i:] for i in range(d)], pa.list_(pa.float64()))], schema=schema)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum over dimensions of (n x - S)^2; null where a long does not hold it."""
    most = n * (int(np.abs(x.astype(float)).max(initial=0)) + 1) + max(map(abs, sums), default=0)
    if most * most * max(1, x.shape[1]) < _LONG:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    off = n * x.astype(object) - np.array(sums, object)
    return [v if v < _LONG else None for v in (off * off).sum(axis=1).tolist()]


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, dict]:
    """For each length: n, sums, mean, values and vectors of the leading components, explained shares.

    ``distinct`` has (x, w). A component whose eigenvalue is zero up to rounding has no direction: its vector is null.
    """
    spark = distinct.sparkSession
    sums = distinct.select("x", "w").mapInArrow(partial(_sums, arrow_schema("d int, j int, s string")), "d int, j int, s string")
    models: dict[int, dict] = {}
    for r in sums.groupBy("d", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("d", "j").collect():
        m = models.setdefault(r["d"], {"sums": []})
        if r["j"] < 0:
            m["n"] = int(r["s"])
        else:
            m["sums"].append(int(r["s"]))
    for m in models.values():
        m["mean"] = np.array([s / m["n"] for s in m["sums"]])
    means = spark.sparkContext.broadcast({d: m["mean"] for d, m in models.items()})
    ddl = "d int, i int, row array<double>"
    schema = arrow_schema(ddl)
    parts = distinct.select("x", "w").mapInArrow(lambda batches: _products(schema, means.value, batches), ddl)
    cells = parts.select("d", "i", F.posexplode("row").alias("j", "v")).groupBy("d", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    d, i, j, v = (cells[c].to_numpy() for c in ("d", "i", "j", "v"))
    for length, m in models.items():
        cov = np.zeros((length, length))
        here = d == length
        cov[i[here], i[here] + j[here]] = v[here] / m["n"]
        cov += np.triu(cov, 1).T
        values, vectors = np.linalg.eigh(cov) if length else (np.empty(0), np.empty((0, 0)))
        first = np.argsort(-values, kind="stable")[:components]
        trace = float(np.trace(cov))
        least = trace * length * np.finfo(float).eps
        m["values"] = [float(e) if e > least else None for e in values[first]]
        m["explained"] = [(e or 0.0) / trace if trace > 0 else None for e in m["values"]]
        m["directions"] = np.column_stack([vectors[:, k] / np.sqrt(e) if e else np.full(length, np.nan) for k, e in zip(first, m["values"])]) if len(first) else np.empty((length, 0))
    return models


_WHITE = "x binary, d int, w bigint, n bigint, deviation bigint, z array<double>"


def _white(schema: pa.Schema, models: dict[int, dict], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for packed, x, w in _blocks(batches):
        m, d = models[x.shape[1]], x.shape[1]
        z = (x - m["mean"]) @ m["directions"]
        columns = [packed, [d] * len(x), w, [m["n"]] * len(x), _deviation(x, m["n"], m["sums"]), [[None if v != v else v for v in row] for row in z.tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _identity_error(white: DataFrame, components: int) -> DataFrame:
    """(d, identity_error): largest absolute entry of the fit list's whitened covariance less the identity."""
    z = [F.get("z", F.lit(k)) for k in range(components)]
    flat = white.select("d", "w", *[c.alias(f"z{k}") for k, c in enumerate(z)])
    share = lambda c: F.sum(c * F.col("w")) / F.sum(F.when(c.isNotNull(), F.col("w")))
    means = flat.groupBy("d").agg(*[share(F.col(f"z{k}")).alias(f"m{k}") for k in range(components)])
    centred = flat.join(F.broadcast(means), "d").select("d", "w", *[(F.col(f"z{k}") - F.col(f"m{k}")).alias(f"c{k}") for k in range(components)])
    entries = [F.abs(share(F.col(f"c{a}") * F.col(f"c{b}")) - (1.0 if a == b else 0.0)) for a in range(components) for b in range(a, components)]
    return centred.groupBy("d").agg(F.greatest(*entries).alias("identity_error"))


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", weights: str = "one", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for every usable row and leading component.

    Rows whose vector is null or holds null or non-finite entries are left out; an empty vector has no component.
    ``weights`` is "one" (each distinct vector once) or "counts" (once per row); n is the sum of weights. Null keys and
    repeated rows are kept, each with its own results. Entries beyond a long count as its ends; a deviation that a long
    does not hold is null. Components without variance have a null ``whitened`` and explain 0; where nothing varies,
    ``explained`` and ``identity_error`` are null too. An empty table gives no rows; further columns are not read.
    """
    kind = rows.schema[key].dataType.simpleString()
    plain = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    packed = cut_lineage(map_rows(plain, _packed, f"id {kind}, x binary"))
    groups = cut_lineage(packed.groupBy("x").agg(F.count(F.lit(1)).alias("n")))
    models = fit(groups.select("x", (F.col("n") if weights == "counts" else F.lit(1)).cast("bigint").alias("w")), components)
    held = rows.sparkSession.sparkContext.broadcast(models)
    schema = arrow_schema(_WHITE)
    white = groups.select("x", (F.col("n") if weights == "counts" else F.lit(1)).cast("bigint").alias("w"))
    white = cut_lineage(white.mapInArrow(lambda batches: _white(schema, held.value, batches), _WHITE))
    told = [(d, float(e) if e is not None else None, k) for d, m in models.items() for k, e in enumerate(m["explained"])]
    shares = rows.sparkSession.createDataFrame(told, "d int, explained double, k int")  # a few rows per length
    errors = F.broadcast(_identity_error(white, components))
    values = white.join(errors, "d").select("x", F.col("d").alias("_d"), F.col("n").alias("_n"), "deviation", "z", "identity_error")
    done = join_back(packed, values, "x", groups)
    done = done.select(F.col("id").alias(key), F.col("_n").alias("n"), "deviation", "identity_error", "_d", F.posexplode("z").alias("k", "whitened"))
    return (done.join(F.broadcast(shares.withColumnRenamed("k", "_k")), (F.col("d") == F.col("_d")) & (F.col("k") == F.col("_k")))
            .select(key, (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "whitened", "explained", "identity_error"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return whitened(table(spark, folder, "embeddings"))
