"""Metric series and request quotas, for series of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cilens import rules
from cilens.operators.prefix import next_rows, ranged, running_totals, value_at_rank
from cilens.session import cut_lineage, small


def latest_average(points: DataFrame, window: int = 5) -> DataFrame:
    """Average of each metric's last values, over as many as there are. Only the last few rows
    per task leave it: the rank limit runs before the shuffle."""
    order = Window.partitionBy("name").orderBy(F.desc("ts"), F.desc("event_id"))
    last = points.withColumn("n", F.row_number().over(order)).where(F.col("n") <= window)
    return last.groupBy("name").agg((F.sum(F.col("value").cast("decimal(20,6)")) / F.count(F.lit(1))).alias("moving_average"))


def percentile_floor(points: DataFrame, percent: int = 95) -> DataFrame:
    """Sorted value at index floor((n - 1) * percent / 100), without interpolation."""
    rank = F.floor((F.col("n") - 1) * F.lit(percent / 100.0)) + 1
    return value_at_rank(points, ["name"], "value", rank)


def summary(points: DataFrame) -> DataFrame:
    avg, p95 = latest_average(points), percentile_floor(points).withColumnRenamed("value", "p95")
    return avg.join(p95, "name").select("name", F.round("moving_average", 2).cast("double").alias("moving_average"),
                                        F.round(F.col("p95").cast("decimal(20,6)"), 2).cast("double").alias("p95"))


def outliers(points: DataFrame, threshold: float = 3.0, at_least: int = 5) -> DataFrame:
    """Points further than ``threshold`` population deviations from their metric's mean.

    Sums are exact decimals, so the moments do not depend on the order of addition. The
    moments are one row per metric, counted before they are broadcast.
    """
    v = F.col("value").cast("decimal(18,4)")
    moments = points.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(v).cast("double").alias("s"), F.sum((v * v).cast("decimal(30,8)")).cast("double").alias("ss"))
    stats = moments.select("name", "n", (F.col("s") / F.col("n")).alias("mean"), F.sqrt(F.greatest(
        F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n")), F.lit(0.0))).alias("std"))
    usable = stats.where((F.col("n") >= at_least) & (F.col("std") > 0))
    return points.join(small(cut_lineage(usable)), "name").withColumn("z", F.abs(F.col("value") - F.col("mean")) / F.col("std")).where(F.col("z") >= threshold)


def quota_usage(requests: DataFrame, quota: dict[str, int] = rules.QUOTA) -> DataFrame:
    """Per request, the load of the minute and the day before it, and the limits it would meet.

    A sliding sum is a difference of two running totals. Every request asks for the total just
    before itself, up to a minute ago and up to a day ago; the questions are placed on the time
    line next to the requests, and running totals are taken through ranges of equal depth, so a
    provider with most of the traffic, or a minute with most of a provider's, is spread over tasks.
    """
    charge = F.least("tokens", F.lit(quota["tpm"]))
    sources = requests.select("provider", F.col("t_sec").alias("at"), F.lit(None).cast("bigint").alias("req_id"), F.lit("r").alias("ask"),
                              F.lit(1).cast("bigint").alias("one"), charge.alias("cost"))
    marks = F.array(*[F.struct((F.col("t_sec") - back).alias("at"), F.lit(ask).alias("ask")) for ask, back in (("now", 1), ("minute", rules.MINUTE), ("day", rules.DAY))])
    asks = requests.select("provider", "req_id", charge.alias("charge"), F.inline(marks)).select(
        "provider", "at", "req_id", "ask", F.lit(0).cast("bigint").alias("one"), F.lit(0).cast("bigint").alias("cost"), "charge")
    # requests sort ahead of questions at the same second, so a question counts up to its second
    line = sources.unionByName(asks, allowMissingColumns=True).withColumn("turn", F.when(F.col("ask") == "r", 0).otherwise(1))
    order = ["at", "turn", "req_id", "ask"]
    totals = running_totals(ranged(line, ["provider"], order), ["provider"], F.col("_range"), order, {"n": F.col("one"), "t": F.col("cost")})
    answers = totals.where("ask <> 'r'").groupBy("provider", "req_id").agg(
        *[F.max(F.when(F.col("ask") == ask, F.col(c))).alias(f"{ask}_{c}") for ask in ("now", "minute", "day") for c in ("n", "t")], F.max("charge").alias("charge"))
    used = answers.select("provider", "req_id", "charge", (F.col("now_n") - F.col("minute_n")).alias("requests_minute"),
                          (F.col("now_t") - F.col("minute_t")).alias("tokens_minute"), (F.col("now_n") - F.col("day_n")).alias("requests_day"))
    return used.select(
        "provider", "req_id", "charge", "requests_minute", "tokens_minute", "requests_day",
        (F.col("requests_minute") >= quota["rpm"]).alias("over_rpm"),
        ((F.col("tokens_minute") > 0) & (F.col("tokens_minute") + F.col("charge") > quota["tpm"])).alias("over_tpm"),
        (F.col("requests_day") >= quota["rpd"]).alias("over_rpd"), (F.col("requests_day") + 1 == int(quota["rpd"] * 0.8)).alias("daily_warning"))


def span_durations(marks: DataFrame) -> DataFrame:
    """Each span lasts until the next mark of its trace; the last one is still open and counts 0."""
    nxt = next_rows(ranged(marks, ["trace_id"], ["us", "span_id"]), ["trace_id"], F.col("_range"), ["us", "span_id"], ["us"])
    return nxt.select("trace_id", "span_id", F.coalesce((F.col("next_us") - F.col("us")) / 1000, F.lit(0.0)).alias("duration_ms"))
