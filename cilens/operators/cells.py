"""Exact nearest vectors through cells: what the triangle inequality rules out is never compared."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cilens import rules
from cilens.operators.retrieval import ITEM_BLOCK, QUERY_BLOCK, _best_rows, _search
from cilens.session import cut_lineage

CELLS = 64  # centres a part is cut by, a bounded sample of its vectors; every vector is indexed
_SLACK = 1e-9  # what rounding may take from a bound


def _spaces(rows: DataFrame) -> DataFrame:
    """Vectors of one part and length share a space, named as JSON; rows without part or vector are neither asked nor found."""
    return rows.where("vec IS NOT NULL AND part IS NOT NULL").withColumn("part", F.to_json(F.struct("part", F.size("vec").alias("dim")))).withColumn("vec", F.col("vec").cast("array<double>"))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centres], axis=1)


def _with_centres(rows: DataFrame, key: str, size: int, centres: DataFrame, step, out: str) -> DataFrame:
    """Blocks of about ``size`` rows next to the centres of their part, so that a hot part is spread over its blocks."""
    shape = rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    cut = rows.join(shape, "part").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).drop("blocks")
    there = centres.join(shape, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return cut.groupBy("part", "block").cogroup(there.groupBy("part", "block")).applyInPandas(step, out)


def build(items: DataFrame, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """The index of items (item_id, part, vec): every item with its cell and its distance from the centre, and the cells.

    A part's centres are its ``cells`` vectors of least hash, ranked inside tasks before the shuffle; equal vectors give
    one centre. An item belongs to its nearest centre. Both tables are written once.
    """
    rows = _spaces(items)
    place = Window.partitionBy("part").orderBy(F.xxhash64("item_id"), "item_id")
    picked = rows.withColumn("cell", F.row_number().over(place)).where(F.col("cell") <= cells)
    centres = cut_lineage(picked.groupBy("part", "vec").agg(F.min("cell").alias("cell")).withColumnRenamed("vec", "centre"))
    def assign(batch: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        there = there.sort_values("cell")
        apart = _distances(np.stack(batch["vec"]), np.stack(there["centre"]))
        best = apart.argmin(axis=1)
        return pd.DataFrame({"part": batch["part"], "item_id": batch["item_id"], "vec": batch["vec"],
                             "cell": there["cell"].to_numpy()[best], "radius": apart[np.arange(len(batch)), best]})

    indexed = cut_lineage(_with_centres(rows.select("part", "item_id", "vec"), "item_id", ITEM_BLOCK, centres, assign,
                                        "part string, item_id bigint, vec array<double>, cell int, radius double"))
    sizes = indexed.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("least"), F.max("radius").alias("most"))
    return indexed, cut_lineage(centres.join(sizes, ["part", "cell"]))


def search(index: tuple[DataFrame, DataFrame], queries: DataFrame, n: int = rules.CODE_HITS, id_type: str = "bigint",
           block: int = QUERY_BLOCK) -> tuple[DataFrame, DataFrame]:
    """The n nearest items of each query (query_id, part, vec), as a full search gives them, and the cells each query saw.

    A query first searches its nearest cells, as many as hold n items. The distance b of its n-th hit then bounds the rest:
    a cell is searched only if its ring of distances from the centre meets [d - b, d + b], d being the query's own, and if d is at
    most 2 b more than that of the query's nearest centre; inside a cell only items of that ring are compared. A query with fewer
    than n items in its part sees them all.
    """
    indexed, cells = index
    asked = cut_lineage(_spaces(queries).select("part", "query_id", "vec"))

    def look(batch: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(batch) or not len(there):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("part", "query_id", "cell", "d", "nearest", "first")})
        apart = _distances(np.stack(batch["vec"]), np.stack(there["centre"]))
        order = np.argsort(apart, axis=1, kind="stable")
        held = np.cumsum(there["n"].to_numpy()[order], axis=1)
        first = held - there["n"].to_numpy()[order] < n  # the cells before this one hold fewer than n
        row = np.repeat(np.arange(len(batch)), len(there))
        taken = {c: pd.Series(batch[c].to_numpy(dtype=object)[row], dtype=object) for c in ("part", "query_id")}
        return pd.DataFrame({**taken, "cell": there["cell"].to_numpy()[order].ravel(),
                             "d": np.take_along_axis(apart, order, axis=1).ravel(), "nearest": apart.min(axis=1)[row], "first": first.ravel()})

    views = cut_lineage(_with_centres(asked, "query_id", block, cells.select("part", "cell", "centre", "n"), look,
                                      f"part string, query_id {id_type}, cell int, d double, nearest double, first boolean"))

    def cost(batch, some, n):
        for part, rows in batch.groupby("part", sort=False):
            here = some[some["part"] == part]
            if len(here):
                x, r = np.stack(rows["vec"]), rows["radius"].to_numpy()
                gaps = np.full((len(rows), len(here)), np.inf)
                for col, (vec, d, bound) in enumerate(zip(here["vec"], here["d"], here["bound"])):
                    ring = np.abs(r - d) <= bound
                    gaps[ring, col] = ((x[ring] - np.asarray(vec)) ** 2).sum(axis=1)
                yield _best_rows(gaps, rows["item_id"].to_numpy(), here["query_id"].to_numpy(), n)

    in_cell = F.to_json(F.struct("part", "cell")).alias("part")
    items = indexed.select(in_cell, "item_id", "vec", "radius")

    def visit(some: DataFrame) -> DataFrame:
        return _search(items, some.join(asked, ["part", "query_id"]).select(in_cell, "query_id", "vec", "d", "bound"), cost, n, id_type, block)

    first = views.where("first").withColumn("bound", F.lit(float("inf")))
    hits = cut_lineage(visit(first).drop("hit"))
    reached = hits.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= n, F.sqrt(F.max("cost")) * (1 + _SLACK) + _SLACK).otherwise(F.lit(float("inf"))).alias("bound"))
    rest = cut_lineage(views.where("NOT first").join(reached, "query_id").join(cells.select("part", "cell", "least", "most"), ["part", "cell"])
                       .where("d - bound <= most AND d + bound >= least AND d - nearest <= 2 * bound").drop("least", "most"))
    order = Window.partitionBy("query_id").orderBy("cost", "item_id")
    found = hits.unionByName(visit(rest).drop("hit")).withColumn("hit", F.row_number().over(order).cast("bigint")).where(F.col("hit") <= n)
    return found, first.unionByName(rest)


def share_seen(index: tuple[DataFrame, DataFrame], seen: DataFrame) -> DataFrame:
    """Per part, pairs of a query and an item in all and those whose distance was computed, from the items' rings."""
    indexed, _ = index
    pairs = (seen.join(indexed.select("part", "cell", "radius"), ["part", "cell"]).groupBy("part").agg(
        F.count_if(F.abs(F.col("radius") - F.col("d")) <= F.col("bound")).alias("computed")))
    sizes = indexed.groupBy("part").agg(F.count(F.lit(1)).alias("items"))
    asked = seen.groupBy("part").agg(F.count_distinct("query_id").alias("queries"))
    return pairs.join(sizes, "part").join(asked, "part").select("part", (F.col("items") * F.col("queries")).alias("pairs"), "computed")
