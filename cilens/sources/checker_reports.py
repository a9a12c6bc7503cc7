"""Checker output as diagnostic rows: ruff and ESLint JSON, tsc and pyflakes text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cilens.functions import text as X

RUFF = ("array<struct<filename:string,location:struct<row:int>,message:string,code:string,"
        "fix:struct<applicability:string,edits:array<struct<content:string>>>>>")
ESLINT = "array<struct<filePath:string,messages:array<struct<severity:int,line:int,message:string,ruleId:string>>>>"
TSC = r"^(.*?)\((\d+)[^)]*\):\s*(error|warning)\s+(TS\d+)\s*:?\s*(.*)$"


def relative(path: Column, root: str) -> Column:
    flat = X.slashes(F.coalesce(path, F.lit("")))
    return F.when(F.startswith(flat, F.lit(root)), F.substr(flat, F.lit(len(root) + 1))).otherwise(flat)


def ruff(reports: DataFrame, root: str = "/r/") -> DataFrame:
    item = F.explode(F.from_json("report_text", RUFF)).alias("i")
    return reports.select("report_id", item).select(
        "report_id", relative(F.col("i.filename"), root).alias("file_path"),
        F.greatest(F.coalesce(F.when(F.col("i.location.row") != 0, F.col("i.location.row")), F.lit(1)), F.lit(1)).cast("bigint").alias("line"),
        F.coalesce("i.code", F.lit("")).alias("code"), F.coalesce("i.message", F.lit("lint violation")).alias("message"),
        F.lit("error").alias("severity"),
        F.array_join(F.coalesce(F.transform("i.fix.edits", lambda e: F.coalesce(e["content"], F.lit(""))), F.array()), "").alias("suggested_fix"),
        F.coalesce("i.fix.applicability", F.lit("")).alias("fix_applicability"))


def eslint(reports: DataFrame, root: str = "/r/") -> DataFrame:
    files = reports.select("report_id", F.explode(F.from_json("report_text", ESLINT)).alias("f"))
    items = files.select("report_id", F.col("f.filePath").alias("path"), F.explode("f.messages").alias("m")).where("m.severity = 2")
    return items.select(
        "report_id", relative(F.col("path"), root).alias("file_path"),
        F.coalesce(F.when(F.col("m.line") != 0, F.col("m.line")), F.lit(1)).cast("bigint").alias("line"),
        F.when(F.coalesce("m.ruleId", F.lit("")) != "", F.col("m.ruleId")).otherwise("eslint").alias("code"),
        F.coalesce("m.message", F.lit("lint error")).alias("message"), F.lit("error").alias("severity"),
        F.lit("").alias("suggested_fix"), F.lit("").alias("fix_applicability"))


def tsc(reports: DataFrame) -> DataFrame:
    row = reports.select("report_id", F.explode(X.lines(F.col("report_text"))).alias("l")).where(
        F.contains("l", F.lit("): error TS")) | F.contains("l", F.lit("): warning TS"))).where(F.col("l").rlike(TSC))
    part = lambda n: F.regexp_extract("l", TSC, n)
    return row.select(
        "report_id", X.slashes(X.strip(part(1))).alias("file_path"), part(2).cast("bigint").alias("line"), part(4).alias("code"),
        F.when(X.strip(part(5)) != "", X.strip(part(5))).otherwise(part(4)).alias("message"), part(3).alias("severity"),
        F.lit("").alias("suggested_fix"), F.lit("").alias("fix_applicability")).where("severity <> 'warning'")


def pyflakes(reports: DataFrame) -> DataFrame:
    """path:line:column message, cut at the first three colons; the rest of the line is the message."""
    cut = F.split("l", ":", 4)
    row = (reports.select("report_id", F.explode(X.lines(F.col("report_text"))).alias("l")).select("report_id", cut.alias("p"))
           .where(F.size("p") >= 3).withColumn("n", F.col("p")[1].try_cast("bigint")).where("n is not null"))
    return row.select(
        "report_id", X.slashes(F.col("p")[0]).alias("file_path"), F.col("n").alias("line"), F.lit("pyflakes").alias("code"),
        X.strip(F.element_at("p", -1)).alias("message"), F.lit("error").alias("severity"),
        F.lit("").alias("suggested_fix"), F.lit("").alias("fix_applicability"))
