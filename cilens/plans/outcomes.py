"""Repair outcome and benchmark queries."""

from pyspark.sql import functions as F

from cilens import rules
from cilens.operators import outcomes as O
from cilens.plans.registry import cte, query

cte("d_cases", """
SELECT case_id, bug_category, coalesce(contains(suspect_function, expected_symbol), false) AS localization_correct, attempts <= 1 AND state = 'COMPLETED' AS first_attempt_passed,
 state IN ('COMPLETED', 'PENDING_APPROVAL') AS final_verified_passed, attempts, elapsed_s, attempts * 0.0015 AS cost FROM case_runs""")
_SCORES = """count(*) AS total_cases, count(*) FILTER (final_verified_passed) AS successful_fixes,
 CAST(round(CAST(count(*) FILTER (localization_correct) * 100 AS DOUBLE) / count(*) + 1e-9, 1) AS DOUBLE) AS localization_accuracy_pct,
 CAST(round(CAST(count(*) FILTER (first_attempt_passed) * 100 AS DOUBLE) / count(*) + 1e-9, 1) AS DOUBLE) AS first_attempt_success_pct,
 CAST(round(CAST(count(*) FILTER (final_verified_passed) * 100 AS DOUBLE) / count(*) + 1e-9, 1) AS DOUBLE) AS overall_fix_rate_pct,
 CAST(round(CAST(sum(attempts) AS DOUBLE) / count(*) + 1e-9, 2) AS DOUBLE) AS average_attempts,
 CAST(round(CAST(sum(CAST(elapsed_s AS DECIMAL(18,6))) AS DOUBLE) / count(*) + 1e-9, 2) AS DOUBLE) AS average_seconds, CAST(sum(CAST(cost AS DECIMAL(18,4))) AS DOUBLE) AS total_cost"""


@query("a2_case_metrics", "SELECT case_id, bug_category, localization_correct, first_attempt_passed, final_verified_passed, attempts, CAST(CAST(cost AS DECIMAL(18,4)) AS DOUBLE) AS cost FROM d_cases")
def case_metrics(t):
    return O.case_metrics(t.case_runs).drop("elapsed_s").withColumn("cost", F.col("cost").cast("double"))


@query("a3_scorecard", f"SELECT {_SCORES} FROM d_cases")
def scorecard(t):
    return O.scorecard(O.case_metrics(t.case_runs))


@query("a4_scorecard_by_category", f"SELECT bug_category, {_SCORES} FROM d_cases GROUP BY bug_category UNION ALL SELECT '(all)', {_SCORES} FROM d_cases")
def scorecard_by_category(t):
    return O.scorecard_by_category(O.case_metrics(t.case_runs))


cte("d_tries", "SELECT *, 'error ' || CAST(ord AS VARCHAR) || ' ' || outcome AS detail, row_number() OVER (PARTITION BY incident_id ORDER BY ord) AS n FROM attempts QUALIFY n <= 3")


def attempts(t):
    return t.attempts.withColumn("detail", F.concat(F.lit("error "), F.col("ord").cast("string"), F.lit(" "), "outcome"))


@query("a8_recommendation", """
WITH o AS (SELECT incident_id, string_agg(DISTINCT outcome, ',' ORDER BY outcome) AS outcomes, min(oracle_name) AS oracle FROM d_tries GROUP BY incident_id)
SELECT incident_id, outcomes, CASE WHEN outcomes = 'patch_rejected' THEN 're-check the localization' WHEN contains(outcomes, 'generation_failed') THEN 'check the model provider'
 WHEN outcomes = 'check_failed' AND starts_with(oracle, 'gate:') THEN 'run the checker directly' WHEN outcomes = 'check_failed' THEN 'human review: defect is elsewhere or external' ELSE 'human review: mixed reasons' END AS recommendation FROM o""")
def recommendation(t):
    return O.recommendations(attempts(t))


@query("a9_failure_report", """
SELECT incident_id, string_agg('### Attempt ' || CAST(n AS VARCHAR) || ' -- ' || replace(outcome, '_', ' ') || chr(10) || left(trim(detail), 1500), chr(10) || chr(10) ORDER BY n) AS report FROM d_tries GROUP BY incident_id""")
def failure_report(t):
    return O.failure_reports(attempts(t))


@query("w9_previous_error", "SELECT incident_id, n, detail, lag(detail) OVER (PARTITION BY incident_id ORDER BY n) AS previous_error FROM d_tries")
def previous_error(t):
    return O.feedback_chain(attempts(t)).select("incident_id", "n", "detail", "previous_error")


@query("w10_attempt_verdict", """
WITH w AS (SELECT incident_id, min(n) FILTER (outcome IN ('passed', 'autofixed')) AS k, count(*) AS tried FROM d_tries GROUP BY incident_id)
SELECT w.incident_id, k IS NOT NULL AS success, CAST(CASE WHEN d.outcome = 'autofixed' THEN 0 ELSE coalesce(k, tried) END AS BIGINT) AS total_attempts FROM w LEFT JOIN d_tries d ON d.incident_id = w.incident_id AND d.n = w.k""")
def attempt_verdict(t):
    return O.verdicts(attempts(t))


@query("w8_latest_fixes", "SELECT exception_type, ord, n FROM (SELECT lower(exception_type) AS exception_type, ord, row_number() OVER (PARTITION BY lower(exception_type) ORDER BY ord DESC) AS n FROM fix_history) WHERE n <= 2")
def latest_fixes(t):
    from cilens.operators.retrieval import newest

    return newest(t.fix_history.select(F.lower("exception_type").alias("exception_type"), "ord"), ["exception_type"], rules.FIX_HITS).withColumn("n", F.col("n").cast("bigint"))
