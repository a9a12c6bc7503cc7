"""Repair attempts, benchmark cases and their scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cilens import rules


def case_metrics(runs: DataFrame) -> DataFrame:
    done = F.col("state") == "COMPLETED"
    return runs.select(
        "case_id", "bug_category", F.coalesce(F.contains("suspect_function", F.col("expected_symbol")), F.lit(False)).alias("localization_correct"),
        ((F.col("attempts") <= 1) & done).alias("first_attempt_passed"),
        (done | (F.col("state") == "PENDING_APPROVAL")).alias("final_verified_passed"), "attempts",
        F.col("elapsed_s"), (F.col("attempts") * F.lit(rules.COST_PER_ATTEMPT).cast("decimal(10,4)")).cast("decimal(18,4)").alias("cost"))


def _scores() -> list[Column]:
    n = F.count(F.lit(1))

    def share(flag: str) -> Column:
        return F.round(F.coalesce(F.count_if(F.col(flag)) * F.lit(100).cast("decimal(5,0)") / F.nullif(n, F.lit(0)), F.lit(0)), 1).cast("double")

    seconds = F.col("elapsed_s").cast("decimal(18,6)")
    return [n.alias("total_cases"), F.count_if(F.col("final_verified_passed")).alias("successful_fixes"),
            share("localization_correct").alias("localization_accuracy_pct"), share("first_attempt_passed").alias("first_attempt_success_pct"),
            share("final_verified_passed").alias("overall_fix_rate_pct"),
            F.round(F.coalesce(F.sum("attempts").cast("decimal(20,0)") / F.nullif(n, F.lit(0)), F.lit(0)), 2).cast("double").alias("average_attempts"),
            F.round(F.coalesce(F.sum(seconds) / F.nullif(n, F.lit(0)), F.lit(0)), 2).cast("double").alias("average_seconds"),
            F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("total_cost")]


def scorecard(metrics: DataFrame) -> DataFrame:
    """One row; all zeros for an empty suite."""
    return metrics.agg(*_scores())


def scorecard_by_category(metrics: DataFrame) -> DataFrame:
    return metrics.rollup("bug_category").agg(F.grouping("bug_category").alias("g"), *_scores()).withColumn(
        "bug_category", F.when(F.col("g") == 1, "(all)").otherwise(F.col("bug_category"))).drop("g")


def bounded_attempts(attempts: DataFrame, limit: int = rules.MAX_ATTEMPTS) -> DataFrame:
    """The attempts an incident is allowed, numbered; the rank limit also cuts before the shuffle."""
    order = Window.partitionBy("incident_id").orderBy("ord")
    return attempts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).withColumn("n", F.col("n").cast("bigint"))


def verdicts(attempts: DataFrame) -> DataFrame:
    """First passing attempt wins; a checker's own fix counts no attempt."""
    tries = bounded_attempts(attempts)
    won = F.min(F.when(F.col("outcome").isin("passed", "autofixed"), F.struct("n", "outcome")))
    return tries.groupBy("incident_id").agg(won.alias("w"), F.count(F.lit(1)).alias("tried")).select(
        "incident_id", F.col("w").isNotNull().alias("success"),
        F.when(F.col("w.outcome") == "autofixed", 0).otherwise(F.coalesce("w.n", "tried")).cast("bigint").alias("total_attempts"))


def recommendations(attempts: DataFrame) -> DataFrame:
    """Advice from the set of outcomes of one incident's attempts."""
    only = F.size("outcomes") == 1
    advice = (F.when(only & F.array_contains("outcomes", "patch_rejected"), "re-check the localization")
              .when(F.array_contains("outcomes", "generation_failed"), "check the model provider")
              .when(only & F.array_contains("outcomes", "check_failed") & F.startswith("oracle_name", F.lit("gate:")), "run the checker directly")
              .when(only & F.array_contains("outcomes", "check_failed"), "human review: defect is elsewhere or external")
              .otherwise("human review: mixed reasons"))
    return (bounded_attempts(attempts).groupBy("incident_id")
            .agg(F.array_sort(F.collect_set("outcome")).alias("outcomes"), F.min("oracle_name").alias("oracle_name"))
            .select("incident_id", F.array_join("outcomes", ",").alias("outcomes"), advice.alias("recommendation")))


def failure_reports(attempts: DataFrame) -> DataFrame:
    """One document per incident from its ordered attempts, each detail cut to a fixed length."""
    part = F.concat(F.lit("### Attempt "), F.col("n").cast("string"), F.lit(" -- "), F.replace("outcome", F.lit("_"), F.lit(" ")),
                    F.when(F.trim("detail") != "", F.concat(F.lit("\n"), F.substring(F.trim("detail"), 1, rules.REPORT_DETAIL_CHARS))).otherwise(""))
    body = F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("p")))), lambda x: x["p"])
    return bounded_attempts(attempts).groupBy("incident_id").agg(F.array_join(body, "\n\n").alias("report"))


def feedback_chain(attempts: DataFrame) -> DataFrame:
    order = Window.partitionBy("incident_id").orderBy("n")
    return bounded_attempts(attempts).withColumn("previous_error", F.lag("detail").over(order))
