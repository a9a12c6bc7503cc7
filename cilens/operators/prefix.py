"""Order-dependent results for groups of any size.

A plain window puts a whole group on one task. Here each group is cut into buckets of its
order key; buckets are summed with a map-side combine, the small bucket table is accumulated,
and rows only ever meet their own bucket. Bucket numbers must rise with the order key; ``ranged``
measures buckets where no fixed width suits the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cilens.session import cut_lineage, small


def ranged(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Rows with ``_range``, a bucket measured on the rows: equal ranges of a sampled sort by key and order.

    However many rows share a key, a day or a second, a range holds about the same number of them, as long as the order
    tells them apart. The rows are written, so that the ranges stay as they are when a task is repeated. Without ``parts``
    the runtime decides by size how many ranges there are.
    """
    sort = [F.col(c) for c in (*keys, *order)]
    cut = rows.repartitionByRange(parts, *sort) if parts else rows.repartitionByRange(*sort)
    return cut_lineage(cut.withColumn("_range", F.spark_partition_id()))


def running_totals(rows: DataFrame, keys: list[str], bucket: Column, order: list, values: dict[str, Column]) -> DataFrame:
    """Add ``{name}`` = inclusive running total of each value in the group's order."""
    rows = rows.withColumn("_bucket", bucket)
    for name, value in values.items():
        rows = rows.withColumn(f"_{name}", value)
    sums = rows.groupBy(*keys, "_bucket").agg(*[F.sum(f"_{n}").alias(f"_{n}_sum") for n in values])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_{n}_sum").over(before), F.lit(0)).alias(f"_{n}_start") for n in values])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(starts, [*keys, "_bucket"])
    for n in values:
        out = out.withColumn(n, F.col(f"_{n}_start") + F.sum(f"_{n}").over(inside))
    return out.drop("_bucket", *[f"_{n}" for n in values], *[f"_{n}_start" for n in values])


def positions(rows: DataFrame, keys: list[str], bucket: Column, order: list, name: str = "position") -> DataFrame:
    """Row number of each row in its group's order."""
    return running_totals(rows, keys, bucket, order, {name: F.lit(1).cast("bigint")})


def next_rows(rows: DataFrame, keys: list[str], bucket: Column, order: list[str], carry: list[str]) -> DataFrame:
    """Add ``next_{c}``: the value of each carried column in the following row of the group.

    Inside a bucket this is a lead; the last row of a bucket takes the first row of the next
    bucket that has any, read from the bucket table.
    """
    rows = rows.withColumn("_bucket", bucket)
    first = rows.groupBy(*keys, "_bucket").agg(F.min(F.struct(*order, *[c for c in carry if c not in order])).alias("_first"))
    follow = first.select(*keys, "_bucket", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_follow"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    last = F.row_number().over(inside) == F.count(F.lit(1)).over(Window.partitionBy(*keys, "_bucket"))
    out = rows.join(follow, [*keys, "_bucket"]).withColumn("_last", last)
    for c in carry:
        out = out.withColumn(f"next_{c}", F.when(F.col("_last"), F.col(f"_follow.{c}")).otherwise(F.lead(c).over(inside)))
    return out.drop("_bucket", "_follow", "_last")


def value_at_rank(rows: DataFrame, keys: list[str], value: str, rank: Column, rounds: int = 3, bins: int = 1024) -> DataFrame:
    """Exact value at a 1-based rank of each group's ascending order.

    ``rank`` is an expression over the group's row count ``n``. Every round counts values in
    ``bins`` equal slices of the interval that still holds the rank and keeps one slice, so
    groups shrink by histogram counts instead of being sorted; what remains is counted per
    distinct value.
    """
    live = rows.select(*keys, F.col(value).alias("_v"))
    state = live.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).select(
        *keys, rank.cast("bigint").alias("_rank"), "_lo", "_hi")
    step = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(rounds):
        # one row per group; written, so that rounds do not repeat each other
        state = small(cut_lineage(state))
        width = (F.col("_hi") - F.col("_lo")) / bins
        slot = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
        counts = (live.join(state, keys).where("_v between _lo and _hi").withColumn("_bin", slot)
                  .groupBy(*keys, "_bin", "_rank").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_bl"), F.max("_v").alias("_bh")))
        state = counts.withColumn("_upto", F.sum("_c").over(step)).where("_upto >= _rank and _upto - _c < _rank").select(
            *keys, (F.col("_rank") - (F.col("_upto") - F.col("_c"))).alias("_rank"), F.col("_bl").alias("_lo"), F.col("_bh").alias("_hi"))
    order = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    left = (live.join(small(cut_lineage(state)), keys).where("_v between _lo and _hi").groupBy(*keys, "_v", "_rank").agg(F.count(F.lit(1)).alias("_c")))
    return (left.withColumn("_upto", F.sum("_c").over(order)).where("_upto >= _rank and _upto - _c < _rank")
            .select(*keys, F.col("_v").alias(value)))
