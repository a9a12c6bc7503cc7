"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cilens.llm.common import cut_lineage


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: bigint); root is the smallest node of its component.

    Alternates the two star steps: each node hands its larger neighbours to the smallest one, then its smaller
    ones. Links never outnumber the input, no node's neighbours are gathered into a row, and the rounds grow with
    the logarithm of the longest path. Each round is written to the shared folder. Links of a node to itself and
    repeated links are allowed; an empty table gives an empty table. Raises if ``rounds`` do not suffice.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        sizes = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (sizes["n"], sizes["s"]) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select("v", "v").distinct())
        mark = (sizes["n"], sizes["s"])
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut_lineage(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
                            .where("u <> v").distinct())
    raise RuntimeError(f"links still move after {rounds} rounds")
