"""Stock reservation in request order, as a table job and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cilens.operators.prefix import positions, ranged, running_totals
from cilens.session import cut_lineage

HOT_ROWS = 1_000_000  # requests of one product that a single task may walk through
ORDER = ["ts", "order_id", "line_no", "l_suppkey", "l_extendedprice"]


def _walk(requests: DataFrame) -> DataFrame:
    """Grant or reject in order. Tasks stream their sorted rows and carry one number per product."""
    fields = [f for f in requests.schema.fields if f.name != "available_qty"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", granted boolean"
    names = [f.name for f in fields]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, left = None, 0
        for rows in batches:
            granted = []
            for sku, qty, stock in zip(rows["sku"].tolist(), rows["qty"].tolist(), rows["available_qty"].tolist()):
                if sku != current:
                    current, left = sku, stock
                granted.append(qty <= left)
                if granted[-1]:
                    left -= qty
            yield rows[names].assign(granted=granted)

    return requests.repartition("sku").sortWithinPartitions("sku", *ORDER).mapInPandas(fold, schema)


def _halve(requests: DataFrame) -> DataFrame:
    """The same result for products with more requests than one task should walk.

    Stock only falls. With ``left`` units, requests above ``left`` are out for good; of the
    rest call those above half of ``left`` big. Small ones are all granted until they pass
    half of ``left`` together or a big one fits, whichever comes first; big ones before that
    point are rejected. That point leaves less than half the stock, so rounds are the
    logarithm of the stock. Each round is one running total through ranges of equal depth, measured once.
    """
    names = [c for c in requests.columns if c != "available_qty"]
    pending = ranged(requests.withColumnRenamed("available_qty", "left"), ["sku"], ORDER)
    decided = []
    while not pending.isEmpty():
        decided.append(pending.where("qty > left").select(*names, F.lit(False).alias("granted")))
        live = pending.where("qty <= left").withColumn("small", F.col("qty") * 2 <= F.col("left"))
        run = running_totals(live, ["sku"], F.col("_range"), ORDER, {"upto": F.when(F.col("small"), F.col("qty")).otherwise(0), "place": F.lit(1).cast("bigint")})
        before = F.col("upto") - F.when(F.col("small"), F.col("qty")).otherwise(0)
        event = F.when(F.col("small"), F.col("upto") * 2 > F.col("left")).otherwise((F.col("qty") <= F.col("left") - before) & (before * 2 <= F.col("left")))
        run = cut_lineage(run.withColumn("event", event).withColumn("before", before))
        first = run.where("event").groupBy("sku").agg(F.min(F.struct("place", (F.col("left") - F.col("before") - F.col("qty")).alias("rest"))).alias("e"))
        run = run.join(first, "sku", "left")
        settled = F.col("e").isNull() | (F.col("place") <= F.col("e.place"))
        decided.append(run.where(settled).select(*names, (F.col("small") | F.col("event")).alias("granted")))
        pending = cut_lineage(run.where(~settled).select(*names, "_range", F.col("e.rest").alias("left")))
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out


def reserve(requests: DataFrame, stock: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every request with ``granted``. In order, a request is granted when enough is left and then
    reduces what is left; a rejected one takes nothing. Unknown products are rejected."""
    joined = requests.join(stock.select("sku", "available_qty"), "sku", "left").withColumn("available_qty", F.coalesce("available_qty", F.lit(-1)))
    counts = requests.groupBy("sku").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot_rows).select("sku")
    hot = cut_lineage(counts)
    if hot.isEmpty():
        return _walk(joined)
    return _walk(joined.join(hot, "sku", "left_anti")).unionByName(_halve(joined.join(hot, "sku", "left_semi")))


def reservation_log(reserved: DataFrame) -> DataFrame:
    """Granted requests with running reservation ids, numbered through ranges of equal depth."""
    order = [*ORDER, "sku"]
    log = positions(ranged(reserved.where("granted"), [], order), [], F.col("_range"), order)
    number = F.col("position").cast("string")
    return log.withColumn("reservation_id", F.concat(F.lit("RES_"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))).drop("_range", "position")


def release(reserved: DataFrame, returns: DataFrame) -> DataFrame:
    """Units given back per product: never more than are reserved. ``returns`` has sku, qty."""
    held = reserved.where("granted").groupBy("sku").agg(F.sum("qty").alias("reserved"))
    asked = returns.groupBy("sku").agg(F.sum("qty").alias("asked"))
    return held.join(asked, "sku").select("sku", "reserved", F.least("reserved", "asked").alias("released"))


def reserve_stream(requests: DataFrame) -> DataFrame:
    """Streaming form: ``requests`` carries available_qty; each product keeps what is left as state."""
    schema = "sku bigint, order_id bigint, line_no int, qty bigint, granted boolean"

    def step(key, batches, state):
        rows = pd.concat(list(batches), ignore_index=True).sort_values(ORDER)
        left = state.get[0] if state.exists else int(rows["available_qty"].iloc[0])
        granted = []
        for qty in rows["qty"].tolist():
            granted.append(qty <= left)
            left -= qty if granted[-1] else 0
        state.update((left,))
        yield rows[["sku", "order_id", "line_no", "qty"]].assign(granted=granted)

    return requests.groupBy("sku").applyInPandasWithState(step, schema, "left bigint", "append", "NoTimeout")
