"""Billing and stock rules. Money is decimal and rounded once, at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cilens import rules
from cilens.operators.prefix import running_totals
from cilens.operators.records import lookup
from cilens.session import cut_lineage

MONEY = "decimal(20,4)"


def money(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast(MONEY)


def tax_rate(state: Column) -> Column:
    return lookup(F.upper(F.trim(F.coalesce(state, F.lit("")))), rules.TAX_RATES, rules.DEFAULT_TAX).cast("decimal(6,5)")


def plan_rate(plan: Column) -> Column:
    return lookup(F.lower(F.trim(plan)), rules.PLAN_RATES, rules.DEFAULT_PLAN).cast("decimal(10,2)")


def warehouse(state: Column) -> Column:
    homes = {s: home for home, states in rules.WAREHOUSES.items() for s in states}
    return lookup(F.upper(F.trim(state)), homes, rules.DEFAULT_WAREHOUSE)


def tier_share(quantity: Column) -> Column:
    """Percentage of the highest tier whose minimum is reached."""
    out = F.lit("0")
    for minimum, share in reversed(rules.TIERS):
        out = F.when(quantity >= minimum, F.lit(share)).otherwise(out)
    return out.cast("decimal(3,2)")


def coupon_discount(code: Column, subtotal: Column) -> Column:
    known = F.upper(F.trim(code))
    out = F.lit(0).cast(MONEY)
    for name, (kind, value) in rules.COUPONS.items():
        amount = F.lit(value).cast("decimal(6,2)")
        part = subtotal * amount if kind == "percentage" else F.least(subtotal, amount.cast(MONEY))
        out = F.when(known == name, F.round(part, 2).cast(MONEY)).otherwise(out)
    return out


def invoices(items: DataFrame, headers: DataFrame) -> DataFrame:
    """Invoice per order. ``items`` has order_id, price, quantity; ``headers`` has order_id,
    state, coupon. Line sums combine before the shuffle; an order without items is all zeros."""
    sums = items.groupBy("order_id").agg(F.sum(money("price") * F.col("quantity").cast("decimal(10,0)")).cast(MONEY).alias("subtotal"),
                                         F.sum("quantity").alias("quantity"))
    df = headers.join(sums, "order_id", "left").withColumn("subtotal", F.coalesce("subtotal", F.lit(0).cast(MONEY))).withColumn("quantity", F.coalesce("quantity", F.lit(0)))
    df = df.withColumn("discount", (F.col("subtotal") * tier_share(F.col("quantity"))).cast("decimal(22,6)") + coupon_discount(F.coalesce("coupon", F.lit("")), F.col("subtotal")))
    df = df.withColumn("taxable", F.greatest(F.lit(0).cast("decimal(24,6)"), (F.col("subtotal") - F.col("discount")).cast("decimal(24,6)")))
    df = df.withColumn("tax", F.round(F.col("taxable") * tax_rate(F.col("state")), 2).cast("decimal(24,2)"))
    out = lambda c: F.round(c, 2).cast("double")
    return df.select("order_id", out(F.col("subtotal")).alias("subtotal"), out(F.col("discount")).alias("discount"), out(F.col("taxable")).alias("taxable_amount"),
                     out(F.col("tax")).alias("tax_amount"), out(F.col("taxable") + F.col("tax")).alias("total"))


def prorated(old_plan: Column, new_plan: Column, days: Column, month: int = 30) -> Column:
    gap = F.greatest(plan_rate(new_plan) - plan_rate(old_plan), F.lit(0).cast("decimal(10,2)"))
    return F.round(gap * days.cast("decimal(10,0)") / F.lit(month).cast("decimal(10,0)"), 2).cast("double")


def available(requests: DataFrame, stock: DataFrame) -> DataFrame:
    """Whether each request could be met from stock on hand; an unknown product never is."""
    return requests.join(stock.select("sku", "available_qty"), "sku", "left").withColumn(
        "available", F.coalesce(F.col("available_qty") >= F.col("qty"), F.lit(False))).drop("available_qty")


def settle(orders: DataFrame, lines: DataFrame, stock: DataFrame) -> DataFrame:
    """Every order with ``granted``: in order of (ts, order_id), an order takes all it asks for or nothing.

    orders: order_id (unique), ts; lines: order_id, sku, qty (not negative, null is none), lines of one product are
    added up; stock: sku, available_qty. An order without lines is granted, one that names an unknown product is not.

    Orders depend on each other through every product they share, so they are settled in rounds between two bounds.
    Before an order, a product has lost at least what granted orders took and at most that and all that open orders
    ask for. An order that fits under the upper bound for each of its products is granted, one that does not fit under
    the lower bound for some product is rejected, and granted orders in front of the first open one leave the table.
    A product that has enough for all who still ask leaves it with all its lines; an order left without lines is granted.
    Bounds are running totals, so no product's orders meet in one task: the range sort that numbers the orders cuts
    them into ranges of equal size, whatever their times, and these are the buckets. The first open order is always
    settled; in practice each round settles a third or more.
    """
    # numbers rise with the sort, and their upper bits name the range
    placed = cut_lineage(orders.select("order_id", "ts").orderBy("ts", "order_id").select("order_id", F.monotonically_increasing_id().alias("place")))
    asked = lines.groupBy("order_id", "sku").agg(F.coalesce(F.sum("qty"), F.lit(0)).cast("bigint").alias("qty"))
    live = cut_lineage(asked.join(placed, "order_id").join(stock.select("sku", "available_qty"), "sku", "left").select(
        "place", "sku", "qty", F.coalesce("available_qty", F.lit(-1)).cast("bigint").alias("rest"), F.lit(False).alias("granted")))
    settled = []
    while not live.where("not granted").isEmpty():
        asked_now = live.groupBy("sku").agg(F.min(F.when(~F.col("granted"), F.col("place"))).alias("first"), F.sum("qty").alias("wanted"), F.min("rest").alias("held"))
        # products without open orders are done, and so are those that have enough for all: their lines refuse nobody
        known = live.join(asked_now.where("first IS NOT NULL AND wanted > held").select("sku", "first"), "sku")
        taken = known.where("place < first").groupBy("sku").agg(F.sum("qty").alias("taken"))
        left = (known.where("place >= first").join(taken, "sku", "left")
                .select("place", "sku", "qty", (F.col("rest") - F.coalesce("taken", F.lit(0))).alias("rest"), "granted"))
        run = running_totals(left, ["sku"], F.shiftright("place", 33), ["place"], {"least": F.when(F.col("granted"), F.col("qty")).otherwise(0), "most": F.col("qty")})
        fits = F.col("most") <= F.col("rest")
        fails = F.col("qty") > F.col("rest") - F.col("least")
        verdicts = run.where("not granted").groupBy("place").agg(F.bool_and(fits).alias("fits"), F.bool_or(fails).alias("fails"))
        step = cut_lineage(left.join(verdicts, "place", "left").select("place", "sku", "qty", "rest", "granted", "fits", "fails"))
        settled.append(step.where("not granted and (fits or fails)").select("place", F.col("fits").alias("granted")))
        live = step.where("granted or not fails").select("place", "sku", "qty", "rest", (F.col("granted") | F.col("fits")).alias("granted"))
    done = placed.select("place").limit(0).withColumn("granted", F.lit(True))
    for part in settled:
        done = done.unionByName(part)
    outcome = done.groupBy("place").agg(F.bool_and("granted").alias("granted"))
    return placed.join(outcome, "place", "left").select("order_id", F.coalesce("granted", F.lit(True)).alias("granted"))
