"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Rows that one task takes of costly per-row work.
TASK_ROWS = 262_144
#: Rows up to which the planner may send a written step to every task by its own estimate.
SENT_ROWS = 65_536


def build_session(app: str = "cilens", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session for local runs; on a cluster the submitted settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("CILENS_DRIVER_MEMORY", "12g"))
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    session = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    ship(session)
    return session


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that they need not share the driver's folders."""
    context, package = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    if getattr(context, "_cilens_shipped", False) or not os.path.isdir(package):
        return
    with tempfile.TemporaryDirectory() as own:
        kept = shutil.copytree(package, f"{own}/tree/cilens", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='cilens-')}/cilens", "zip", os.path.dirname(kept)))
    context._cilens_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster in spark.checkpoint.dir.

    Only where driver and executors are one process (unit tests) may the setting be absent; then a folder of our own
    is chosen.
    """
    context, root = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="cilens-"))
    return root or context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/cilens/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and continue from there.

    Later steps neither repeat the work nor depend on executors that may be gone.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsent(step: DataFrame) -> DataFrame:
    """A written step whose next join is a sorted one if it holds more than ``SENT_ROWS`` rows.

    The planner takes the bytes of the files for the size of the rows. Keys, names and places of one step are alike, so
    their files are a fraction of the rows that the driver would collect, hash and send around. Rows are counted by the files' footers.
    """
    return step if step.count() <= SENT_ROWS else step.hint("merge")


def shared(rows: DataFrame) -> DataFrame:
    """Rows that several parts of one plan read, each with other columns or filters: written, as the planner would work them out for each,
    and never sent around by the size of their files."""
    return unsent(cut_lineage(rows))


def spread(scan: DataFrame, most_rows: int = TASK_ROWS) -> DataFrame:
    """Give a scan enough tasks for costly per-row work.

    A file is split by bytes and a row group is read by one task, so a few splits can hold all rows of a well
    compressed table. The rows of each split are counted, which reads no column; where one has more than ``most_rows``,
    or more than twice an even share of the cores, all rows are dealt out by their number, without a sort.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    held = [row["count"] for row in scan.groupBy(F.spark_partition_id()).count().collect()]
    total, most = sum(held), max(held, default=0)
    if most <= most_rows and most * cores <= 2 * max(total, cores):
        return scan
    tasks = max(min(cores, total), -(-2 * total // most_rows))
    return scan.withColumn("_dealt", F.monotonically_increasing_id()).repartition(tasks, "_dealt").drop("_dealt")


def small(df: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """Mark a table for broadcast if its size is known to be small; otherwise leave it as it is.

    The size is the planner's, which for a written table is that of its files and otherwise an upper estimate.
    Beyond the bound the join is planned as usual: the runtime broadcasts by measured size and splits skewed keys.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most_bytes else df
