"""Model answers as rows: strip code fences, read the JSON by schema, set bad ones aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RANKINGS = "rankings array<struct<symbol_id:string,rank:bigint,plausibility_reason:string>>"


def unfenced(text: Column) -> Column:
    """Drop the first line when it opens a fence, then the last one when it closes it."""
    body = F.trim(F.regexp_replace(text, r"\A\s+|\s+\z", ""))
    inner = F.regexp_replace(F.regexp_replace(body, r"\A```[^\n]*\n?", ""), r"(?:\A|\n)```[^\n]*\z", "")
    return F.when(F.startswith(body, F.lit("```")), inner).otherwise(body)


def _parsed(answers: DataFrame) -> DataFrame:
    """``answers`` has failure_id and answer; unreadable JSON leaves ``rankings`` null."""
    return answers.withColumn("rankings", F.from_json(unfenced(F.col("answer")), RANKINGS, {"mode": "PERMISSIVE"})["rankings"])


def read_rankings(answers: DataFrame) -> DataFrame:
    return (_parsed(answers).select("failure_id", F.explode("rankings").alias("r"))
            .select("failure_id", "r.symbol_id", "r.rank", F.col("r.plausibility_reason").alias("reason")))


def rejected_answers(answers: DataFrame) -> DataFrame:
    return _parsed(answers).where("rankings is null")
