"""Live incident telemetry with Structured Streaming, and the table jobs it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cilens import rules
from cilens.operators.prefix import next_rows
from cilens.session import scratch_path
from cilens.views import VIEWS


def read_stream(spark: SparkSession, folder: str, table: str, files_per_batch: int | None = None) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of part files.

    The path is given as a pattern that only the table itself matches: a stream takes a single file in no other form.
    """
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{table}.parque[t]")


def view_stream(spark: SparkSession, folder: str, view: str, table: str, files_per_batch: int | None = None) -> DataFrame:
    """A derived view over a stream of its base table, with an instant time column ``at``."""
    columns = VIEWS[view].split("FROM " + table)[0].strip().removeprefix("SELECT")
    source = read_stream(spark, folder, table, files_per_batch)
    return spark.sql("SELECT" + columns + " FROM {source}", source=source)


def with_event_time(events: DataFrame, delay: str) -> DataFrame:
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Drain what is available into a table and read it. Progress lives in the shared folder, so a
    restarted run goes on where the last one stopped."""
    spark = stream.sparkSession
    folder = scratch_path(spark, label)
    job = (stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress")
           .trigger(availableNow=True).start())
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_upserts(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Drain an updating aggregate: each micro-batch writes its changed keys, the last write wins.

    A batch that is repeated after a failure overwrites its own folder.
    """
    spark = stream.sparkSession
    folder = scratch_path(spark, label)

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/rows/part={batch}")

    job = (stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/progress")
           .trigger(availableNow=True).start())
    job.awaitTermination()
    write(spark.createDataFrame([], stream.schema), -1)  # so that a stream without rows has a folder too
    stored = spark.read.parquet(f"{folder}/rows").drop("part")
    rest = [c for c in stored.columns if c not in (*keys, "batch")]
    return stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, "v.*")


def ingest(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Telemetry with every event once, however often it is delivered inside the delay."""
    return with_event_time(events, delay).dropDuplicatesWithinWatermark(["event_id"]).drop("at")


def route(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each subscriber sees the events of its own incident; works on a stream or a table."""
    return events.join(subscriptions, "incident_id").select("subscriber_id", "incident_id", "event_id", "action")


def is_terminal():
    moved = (F.col("action") == "STATE_TRANSITION") & F.col("output_summary").isin(*rules.TERMINAL_STATES)
    return F.col("action").isin(*rules.TERMINAL_ACTIONS) | moved


def until_terminal(events: DataFrame) -> DataFrame:
    """Events up to and including each incident's first terminal one.

    The first terminal event is a minimum that combines before the shuffle; no incident is
    ever sorted as a whole.
    """
    at = F.struct("ts", "event_id")
    ends = events.where(is_terminal()).groupBy("incident_id").agg(F.min(at).alias("end"))
    return events.join(ends, "incident_id", "left").where(F.col("end").isNull() | (at <= F.col("end"))).withColumn(
        "terminal", F.coalesce(at == F.col("end"), F.lit(False))).drop("end")


def heartbeats(events: DataFrame, seconds: int = rules.HEARTBEAT_SECONDS) -> DataFrame:
    """Keepalives sent after each delivered event: one per full interval without a successor."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = until_terminal(events).select("incident_id", "event_id", "terminal", us.alias("us"))
    nxt = next_rows(rows, ["incident_id"], F.floor(F.col("us") / 86_400_000_000), ["us", "event_id"], ["us"])
    gap = F.floor((F.col("next_us") - F.col("us")) / (seconds * 1_000_000))
    return nxt.select("incident_id", "event_id", F.when(F.col("terminal"), 0).otherwise(F.coalesce(gap, F.lit(0))).cast("bigint").alias("keepalives"))


def backlog(deliveries: DataFrame, batch, capacity: int = rules.BACKLOG) -> DataFrame:
    """What a subscriber that reads nothing during a batch still gets: the oldest ``capacity``
    events; newer ones are dropped. The rank limit cuts before the shuffle."""
    order = Window.partitionBy("subscriber_id", "incident_id", "batch").orderBy("ts", "event_id")
    ranked = deliveries.withColumn("batch", batch).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= capacity)


def current_state(events: DataFrame) -> DataFrame:
    """Target of the last state transition per incident; the same text serves stream and table."""
    moves = events.where("action = 'STATE_TRANSITION'")
    return moves.groupBy("incident_id").agg(F.max(F.struct("ts", "event_id", "output_summary")).alias("last")).select(
        "incident_id", F.col("last.output_summary").alias("state"), F.col("last.event_id").alias("event_id"))


def feed(events: DataFrame) -> DataFrame:
    return events.groupBy("incident_id").agg(F.count(F.lit(1)).alias("events"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event_id"))


def stage_progress(states: DataFrame) -> DataFrame:
    """Status of the five stages for each incident's current state."""
    stages = F.array(*[F.lit(s) for s in rules.STAGES])
    rows = states.select("incident_id", "state", F.posexplode(stages).alias("i", "stage"))
    at = F.array_position(stages, F.col("state")) - 1
    failed = F.when(F.col("stage") == "VERIFYING", "failed").when(F.col("i") < 3, "completed").otherwise("pending")
    status = (F.when(F.col("state") == "FAILED", failed).when(F.col("state").isin("COMPLETED", "PENDING_APPROVAL"), "completed")
              .when(at < 0, "pending").when(F.col("i") < at, "completed").when(F.col("i") == at, "active").otherwise("pending"))
    return rows.select("incident_id", "stage", status.alias("status"))


def quota_windows(requests: DataFrame, seconds: int = rules.MINUTE) -> DataFrame:
    """Requests and tokens per provider and window; the same text serves stream and table."""
    return requests.groupBy("provider", F.window("at", f"{seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens")).select(
        "provider", F.unix_seconds("w.start").alias("window_start"), "requests", "tokens")
