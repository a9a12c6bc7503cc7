"""Checker diagnostics queries."""

from pyspark.sql import functions as F

from cilens import rules
from cilens.functions import text as X
from cilens.operators import diagnostics as D
from cilens.plans.registry import cte, query
from cilens.plans.source import code_symbols

cte("d_own", """
SELECT *, regexp_extract(file_path, '[^/]*$') || '::' || code || '::' || message AS identity,
 CASE gate WHEN 'python-syntax' THEN 0 WHEN 'js-syntax' THEN 1 WHEN 'tsc' THEN 2 WHEN 'ruff' THEN 3 WHEN 'eslint' THEN 4 ELSE 5 END AS place,
 file_path || ':' || CAST(line AS VARCHAR) || CASE WHEN code <> '' THEN ' [' || code || ']' ELSE '' END || ' ' || message AS text
FROM diagnostics WHERE NOT list_has_any(string_split(regexp_replace(file_path, '^(\\./)+', ''), '/'), ['.git','__pycache__','node_modules','.venv','venv','dist','build','.pytest_cache','.mypy_cache','chroma_db','coverage'])""")
cte("d_gate", "SELECT * FROM d_own QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY place, ord) = 1")
cte("d_base_gate", "SELECT * FROM d_own WHERE phase = 'baseline' QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY place, ord) = 1")


@query("p2_own_source", "SELECT ord, file_path FROM d_own")
def own_source(t):
    return D.own_source(t.diagnostics).select("ord", "file_path")


@query("p5_errors_only", "SELECT ord, severity FROM diagnostics WHERE severity = 'error'")
def errors_only(t):
    return t.diagnostics.where("severity = 'error'").select("ord", "severity")


@query("p6_fixable", "SELECT ord, code FROM diagnostics WHERE code <> '' AND fix_applicability = 'safe'")
def fixable(t):
    return t.diagnostics.where(D.fixable()).select("ord", "code")


@query("f2_diagnostic_identity", """
SELECT ord, regexp_extract(file_path, '[^/]*$') || '::' || code || '::' || message AS identity, file_path || ':' || CAST(line AS VARCHAR) || ' [' || code || '] ' || message AS text FROM diagnostics""")
def identity(t):
    return t.diagnostics.select("ord", D.identity().alias("identity"), D.describe().alias("text"))


# repositories known from the events, including those whose every diagnostic is vendored
@query("w3_gate_selection", "SELECT r.repo_id, coalesce(g.gate, 'clean') AS gate, coalesce(g.ord, -1) AS target_ord FROM (SELECT DISTINCT repo_id FROM diagnostics UNION SELECT repo_id FROM d_repo_langs) r LEFT JOIN d_gate g ON g.repo_id = r.repo_id")
def gate_selection(t):
    from cilens.plans.sources import repo_files

    repos = t.diagnostics.select("repo_id").unionByName(repo_files(t).select("repo_id")).distinct()
    return D.gate_by_repo(t.diagnostics, repos)


@query("w4_gate_failure", """
SELECT g.repo_id, g.gate || ' check' AS test_name, g.file_path AS failing_file, g.line AS failing_line, g.code AS exception_type, g.message AS exception_message, r.raw_traceback
FROM d_gate g JOIN (SELECT o.repo_id, string_agg(o.text, chr(10) ORDER BY o.ord) AS raw_traceback FROM (SELECT o.* FROM d_own o JOIN d_gate g ON g.repo_id = o.repo_id AND g.gate = o.gate QUALIFY row_number() OVER (PARTITION BY o.repo_id ORDER BY o.ord) <= 20) o GROUP BY o.repo_id) r ON r.repo_id = g.repo_id""")
def gate_failure(t):
    return D.gate_failures(t.diagnostics).drop("gate")


@query("j11_diagnostic_suspect", r"""
SELECT g.repo_id, g.file_path || '::<file>' AS symbol_id, regexp_extract(g.file_path, '[^/]*$') AS name, CAST(1 AS BIGINT) AS rank, 'diagnostic' AS ranking_source, g.gate || ' diagnostic at line ' || CAST(g.line AS VARCHAR) AS evidence
FROM d_gate g WHERE NOT EXISTS (SELECT 1 FROM code_symbols s WHERE s.repo_id = g.repo_id AND regexp_extract(s.file_path, '[^/]*$') = regexp_extract(g.file_path, '[^/]*$') AND NOT s.is_test)
 AND EXISTS (SELECT 1 FROM diagnostics d WHERE d.repo_id = g.repo_id AND d.file_path = g.file_path AND d.severity = 'error')
 AND g.repo_id NOT IN (SELECT r.repo_id FROM (SELECT o.repo_id, unnest(regexp_extract_all(o.text, '[\p{L}\p{N}_]+')) AS word FROM (SELECT o.* FROM d_own o JOIN d_gate g ON g.repo_id = o.repo_id AND g.gate = o.gate QUALIFY row_number() OVER (PARTITION BY o.repo_id ORDER BY o.ord) <= 20) o) r
  JOIN code_symbols s ON s.repo_id = r.repo_id AND s.name = r.word AND NOT s.is_test AND length(s.name) >= 3)""")
def diagnostic_suspect(t):
    """Gate failures without any candidate symbol, by file or by name; a file with an error report counts as present."""
    from cilens.operators.localize import named_in_text, path_pairs

    failures = D.gate_failures(t.diagnostics)
    linked = path_pairs(code_symbols(t).where("not is_test"), failures, "failing_file").select("repo_id", F.col("reported_path").alias("failing_file"))
    named = named_in_text(failures.select(F.col("repo_id").alias("failure_id"), "repo_id", F.col("raw_traceback").alias("section")), code_symbols(t))
    alone = (failures.join(linked.distinct(), ["repo_id", "failing_file"], "left_anti")
             .join(named.select(F.col("failure_id").alias("repo_id")).distinct(), "repo_id", "left_anti"))
    return D.diagnostic_suspects(alone, t.diagnostics.where("severity = 'error'"))


@query("j12_gate_verdict", """
SELECT g.repo_id, g.gate, g.identity AS target,
 CAST(count(*) FILTER (o.phase = 'after' AND o.identity NOT IN (SELECT b.identity FROM d_own b WHERE b.repo_id = g.repo_id AND b.gate = g.gate AND b.phase = 'baseline')) AS BIGINT) AS introduced,
 CAST(count(*) FILTER (o.phase = 'after') AS BIGINT) AS remaining,
 count(*) FILTER (o.phase = 'after' AND o.identity = g.identity) = 0 AS resolved, resolved AND introduced = 0 AS passed
FROM d_base_gate g JOIN d_own o ON o.repo_id = g.repo_id AND o.gate = g.gate GROUP BY ALL""".replace(
    "o.identity NOT IN (SELECT b.identity FROM d_own b WHERE b.repo_id = g.repo_id AND b.gate = g.gate AND b.phase = 'baseline')", "b.identity IS NULL").replace(
    "JOIN d_own o ON o.repo_id = g.repo_id AND o.gate = g.gate GROUP", "JOIN d_own o ON o.repo_id = g.repo_id AND o.gate = g.gate LEFT JOIN (SELECT DISTINCT repo_id, gate, identity FROM d_own WHERE phase = 'baseline') b ON b.repo_id = o.repo_id AND b.gate = o.gate AND b.identity = o.identity GROUP"))
def gate_verdict(t):
    return D.compare(t.diagnostics)


_EXIT = "CASE WHEN log_id % 3 = 0 THEN 0 WHEN log_text = 'collected 0 items' THEN 5 ELSE 1 END"


@query("x3_oracle_verdicts", f"""
WITH r AS (SELECT repo_id, CAST({_EXIT} AS BIGINT) AS exit_code FROM run_logs QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, log_id DESC) = 1),
g AS (SELECT o.repo_id, o.gate, o.identity FROM d_own o QUALIFY phase = 'baseline' AND row_number() OVER (PARTITION BY o.repo_id, o.gate, o.phase ORDER BY o.ord) = 1),
a AS (SELECT repo_id, r.exit_code, gate FROM (SELECT repo_id, max(gate) AS gate FROM d_own GROUP BY 1) LEFT JOIN r USING (repo_id)),
v AS (SELECT g.repo_id, g.gate, bool_or(o.phase = 'after' AND (o.identity = g.identity OR o.identity NOT IN (SELECT b.identity FROM d_own b WHERE b.phase = 'baseline' AND b.repo_id = g.repo_id AND b.gate = g.gate))) AS bad
 FROM g JOIN d_own o ON o.repo_id = g.repo_id AND o.gate = g.gate GROUP BY ALL)
SELECT repo_id, CASE WHEN exit_code IS NULL THEN 'gate:' || gate ELSE 'test-suite' END AS oracle_name, coalesce(exit_code, -1) AS exit_code, CASE WHEN exit_code IS NULL THEN coalesce(NOT bad, false) ELSE exit_code = 0 END AS passed FROM a LEFT JOIN v USING (repo_id, gate)""")
def oracle_verdicts(t):
    """Repositories with test runs are judged by these, the others by one of their gates."""
    runs = t.run_logs.select("repo_id", "ts", F.col("log_id").alias("run_no"), F.expr(_EXIT).cast("bigint").alias("exit_code"))
    gates = D.own_source(t.diagnostics).groupBy("repo_id").agg(F.max("gate").alias("gate"))
    tested = runs.select("repo_id", F.lit(rules.TEST_ORACLE).alias("tests")).distinct()
    asked = gates.join(tested, "repo_id", "left").select("repo_id", F.coalesce("tests", F.concat(F.lit(rules.GATE_ORACLE), "gate")).alias("oracle_name"))
    return D.verdicts(asked, runs, t.diagnostics).withColumn("exit_code", F.coalesce("exit_code", F.lit(-1)))


@query("u3_identity_sets", """
SELECT repo_id, gate, identity, CASE WHEN bool_or(phase = 'baseline') AND bool_or(phase = 'after') THEN 'remaining' WHEN bool_or(phase = 'after') THEN 'introduced' ELSE 'resolved' END AS side FROM d_own GROUP BY ALL""")
def identity_sets(t):
    return D.identities(t.diagnostics).select("repo_id", "gate", "identity", F.when(
        (F.col("baseline_rows") > 0) & (F.col("after_rows") > 0), "remaining").when(F.col("after_rows") > 0, "introduced").otherwise("resolved").alias("side"))
