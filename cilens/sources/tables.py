"""Append-only tables: telemetry events, verified fixes, scorecards and audit exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TELEMETRY = "event_id bigint, ts timestamp_ntz, agent string, action string, output_summary string, result string, incident_id string"


#: Folders that telemetry is spread over; a store keeps the number it was begun with.
BUCKETS = 64


def _bucket(incident_id: Column) -> Column:
    return F.pmod(F.xxhash64(incident_id), F.lit(BUCKETS)).cast("int")


def append_telemetry(events: DataFrame, folder: str, batch: int = 0, order: tuple = ("ts", "event_id")) -> None:
    """One append of JSON lines, in the order in which they were written: ``order`` within an append, ``batch`` between appends.

    Appends have rising numbers, such as those of micro-batches; writing a number again replaces that append, so a run
    that failed can be repeated. Every row keeps its place ``seq``: it rises with the sort, and its upper bits name the
    range of equal size that the sort put the row in.

    Rows lie in ``BUCKETS`` folders by hash of the incident, each file sorted by incident. They are rebalanced by folder: a
    quiet one gets one file, and the runtime splits a busy one over several tasks by its measured size. The number of
    folders does not grow with the number of incidents.
    """
    numbered = events.orderBy(*order).withColumn("seq", F.monotonically_increasing_id()).withColumn("bucket", _bucket(F.col("incident_id")))
    (numbered.hint("rebalance", "bucket").sortWithinPartitions("incident_id", "seq")
     .write.mode("overwrite").partitionBy("bucket").json(f"{folder}/batch={batch}"))


def read_telemetry(spark: SparkSession, folder: str, incident_id: str | None = None) -> DataFrame:
    """All stored events with the append ``batch`` and place ``seq`` of each, or those of one incident, for which only its
    folders are opened. Blank lines are skipped."""
    rows = spark.read.schema(f"{TELEMETRY}, seq bigint, batch bigint, bucket int").json(folder)
    if incident_id is not None:
        number = spark.range(1).select(_bucket(F.lit(incident_id)).alias("b")).first()["b"]
        rows = rows.where((F.col("bucket") == number) & (F.col("incident_id") == incident_id))
    return rows.drop("bucket")


def replay(stored: DataFrame) -> DataFrame:
    """Stored events with ``n``, their number within their incident in the order they were written, whatever their times.

    The ranges of the appends are the buckets, so a hot incident is spread over as many tasks as its appends had.
    """
    from cilens.operators.prefix import positions

    numbered_range = F.shiftleft(F.col("batch"), 31) + F.shiftright(F.col("seq"), 33)
    return positions(stored, ["incident_id"], numbered_range, ["batch", "seq"], "n").drop("batch", "seq")


def append_fixes(fixes: DataFrame, folder: str) -> None:
    fixes.write.mode("append").parquet(folder)


def load_fixes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def record_fixes(history: DataFrame, verified: DataFrame) -> DataFrame:
    """Verified fixes numbered after the existing ones, in order of ``ord``.

    Positions come from per-range counts, not from one global window: equal ranges of ``ord`` are
    counted, the counts are accumulated, and rows are numbered inside their range.
    """
    from cilens.operators.prefix import positions, ranged

    stored = history.count()
    numbered = positions(ranged(verified, [], ["ord"]), [], F.col("_range"), ["ord"])
    number = (F.col("position") + stored).cast("string")
    return numbered.withColumn("fix_id", F.concat(F.lit("fix_"), number, F.lit("_"), F.col("exception_type"))).drop("_range", "position")


def save_scorecard(scorecard: DataFrame, folder: str) -> None:
    scorecard.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(folder)


def load_scorecard(spark: SparkSession, folder: str) -> DataFrame:
    """Latest scorecard, or one row saying that none is recorded; never zeros."""
    from pyspark.errors import AnalysisException

    try:
        stored = spark.read.parquet(folder)
    except AnalysisException:
        return spark.range(1).select(F.lit(False).alias("recorded"))
    latest = stored.agg(F.max_by(F.struct(*stored.columns), "recorded_at").alias("s"))
    return latest.select(F.col("s").isNotNull().alias("recorded"), "s.*")


def export_csv(records: DataFrame, folder: str) -> None:
    """Flat columns only; the details map has no place in a CSV row."""
    records.drop("details").write.option("header", "true").mode("overwrite").csv(folder)


def export_json(records: DataFrame, folder: str) -> None:
    records.write.mode("overwrite").json(folder)
