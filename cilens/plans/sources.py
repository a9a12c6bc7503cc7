"""Scans, sources and sinks."""

from pyspark.sql import functions as F

from cilens import rules
from cilens.functions import text as X
from cilens.operators import logs as L
from cilens.plans.logs import COLLECTED_NOTHING
from cilens.plans.registry import cte, query
from cilens.session import scratch_path
from cilens.sources import checker_reports as C, tables as S, trees as T

_SKIP = "['.git','__pycache__','node_modules','.venv','venv','dist','build','.pytest_cache','.mypy_cache','chroma_db','coverage']"


def _language(col: str) -> str:
    return "CASE " + " ".join(f"WHEN " + " OR ".join(f"ends_with(lower({col}), '{e}')" for e in rules.EXTENSIONS[l]) + f" THEN '{l}'" for l in rules.LANGUAGES) + " END"


# page paths as files: some vendored, some unsupported, some with a leading ./
cte("d_files", """
SELECT page_id, 'repo_' || CAST(page_id // 50 AS VARCHAR) AS repo_id,
 CASE WHEN page_id % 7 = 0 THEN './node_modules/' WHEN page_id % 11 = 0 THEN 'distribution/' WHEN page_id % 13 = 0 THEN 'lib/.tool_venv/' ELSE '' END || regexp_replace(regexp_extract(url, '^https?://([^?#]*)', 1), '[^A-Za-z0-9/]', '_', 'g')
 || CASE page_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.TS' WHEN 2 THEN '.hpp' WHEN 3 THEN '.md' WHEN 4 THEN '.mjs' ELSE '.java' END AS path FROM pages""")


def page_files(t):
    n = F.col("page_id")
    folder = F.when(n % 7 == 0, "./node_modules/").when(n % 11 == 0, "distribution/").when(n % 13 == 0, "lib/.tool_venv/").otherwise("")
    ends = F.element_at(F.array(*[F.lit(e) for e in (".py", ".TS", ".hpp", ".md", ".mjs", ".java")]), (n % 6 + 1).cast("int"))
    base = F.regexp_replace(F.regexp_extract("url", r"^https?://([^?#]*)", 1), "[^A-Za-z0-9/]", "_")
    return t.pages.select("page_id", F.concat(F.lit("repo_"), F.floor(n / 50).cast("string")).alias("repo_id"), F.concat(folder, base, ends).alias("path"))


@query("s1_source_files", f"""
SELECT page_id, path FROM d_files WHERE {_language('path')} IS NOT NULL AND NOT list_has_any(string_split(regexp_replace(path, '^(\\./)+', ''), '/'), {_SKIP})""")
def source_files(t):
    return T.own_source(page_files(t), "path").select("page_id", "path")


@query("s2_language_routing", f"""
SELECT 'page' AS kind, path, {_language('path')} AS language FROM d_files UNION ALL SELECT 'symbol', file_path, {_language('file_path')} FROM symbols""")
def language_routing(t):
    pages = page_files(t).select(F.lit("page").alias("kind"), "path")
    code = t.symbols.select(F.lit("symbol").alias("kind"), F.col("file_path").alias("path"))
    return pages.unionByName(code).withColumn("language", X.language_of_path(F.col("path")))


# every third repository also has a manifest at its top
cte("d_repo_files", """
SELECT repo_id, path FROM d_files UNION ALL SELECT repo_id, file_path FROM symbols
UNION ALL SELECT DISTINCT repo_id, CASE CAST(replace(repo_id, 'repo_', '') AS BIGINT) % 6 WHEN 0 THEN 'package.json' ELSE 'CMakeLists.txt' END FROM d_files WHERE CAST(replace(repo_id, 'repo_', '') AS BIGINT) % 3 = 0""")


def repo_files(t):
    files = page_files(t)
    no = F.replace("repo_id", F.lit("repo_"), F.lit("")).cast("bigint")
    manifests = files.where(no % 3 == 0).select("repo_id", F.when(no % 6 == 0, "package.json").otherwise("CMakeLists.txt").alias("path")).distinct()
    return files.select("repo_id", "path").unionByName(t.symbols.select("repo_id", F.col("file_path").alias("path"))).unionByName(manifests)


cte("d_repo_langs", f"""
SELECT repo_id, CASE WHEN count(m) > 0 THEN concat_ws(',', CASE WHEN bool_or(m = 'python') THEN 'python' END, CASE WHEN bool_or(m = 'cpp') THEN 'cpp' END, CASE WHEN bool_or(m = 'javascript') THEN 'javascript' END)
 ELSE concat_ws(',', CASE WHEN bool_or(e = 'python') THEN 'python' END, CASE WHEN bool_or(e = 'cpp') THEN 'cpp' END, CASE WHEN bool_or(e = 'javascript') THEN 'javascript' END) END AS languages
FROM (SELECT repo_id, CASE WHEN path IN ('requirements.txt','pyproject.toml','setup.py','setup.cfg','Pipfile') THEN 'python' WHEN path IN ('CMakeLists.txt','Makefile','makefile') THEN 'cpp' WHEN path = 'package.json' THEN 'javascript' END AS m,
 CASE WHEN NOT list_has_any(string_split(regexp_replace(path, '^(\\./)+', ''), '/'), {_SKIP}) THEN {_language('path')} END AS e FROM d_repo_files) GROUP BY repo_id""")


@query("s3_repo_languages", "SELECT repo_id, languages FROM d_repo_langs")
def repo_languages(t):
    return T.repo_languages(repo_files(t)).select("repo_id", F.array_join("languages", ",").alias("languages"))


@query("l21_run_status", f"""
SELECT log_id, repo_id, l.language, CASE WHEN trim(log_text) = '' THEN 'no_output' WHEN ({COLLECTED_NOTHING.replace('language', 'l.language')}) THEN 'no_tests'
  WHEN r.language IS DISTINCT FROM l.language THEN 'passed' WHEN coalesce(n, 0) > 0 THEN 'failed' ELSE 'unparsed_failure' END AS status,
 CAST(CASE WHEN r.language = l.language THEN coalesce(n, 0) ELSE 0 END AS BIGINT) AS failure_count, left(raw_text, 1200) AS log_excerpt
FROM d_lang r JOIN (SELECT repo_id AS own, unnest(string_split(languages, ',')) AS language FROM d_repo_langs) l ON l.own = r.repo_id LEFT JOIN (SELECT log_id, count(*) AS n FROM d_run_failures GROUP BY log_id) USING (log_id)""")
def run_status(t):
    """Each run as the runners of its repository's languages see it."""
    return L.scan_status(t.run_logs, T.repo_languages(repo_files(t)))


@query("l3_toolchain", f"""
SELECT log_id, coalesce(language, {_language('file_path')}, nullif(split_part(languages, ',', 1), '')) AS toolchain
FROM d_lang l LEFT JOIN (SELECT ord, file_path FROM symbols WHERE ord % 2 = 0) s ON s.ord = log_id LEFT JOIN d_repo_langs r ON r.repo_id = l.repo_id""")
def toolchain(t):
    """Log first, then the suspect file's extension, then the repository's first language."""
    suspect = t.symbols.where("ord % 2 = 0").select(F.col("ord").alias("log_id"), "file_path")
    langs = T.repo_languages(repo_files(t))
    return (t.run_logs.withColumn("language", L.runner_language(F.col("log_text"))).join(suspect, "log_id", "left").join(langs, "repo_id", "left")
            .select("log_id", F.coalesce("language", X.language_of_path(F.col("file_path")), F.try_element_at("languages", F.lit(1))).alias("toolchain")))


_TEL = "SELECT event_id, incident_id, agent, action, output_summary, result FROM telemetry"


@query("s4_telemetry_sink", _TEL)
def telemetry_sink(t):
    """Written as JSON lines in folders by hash of the incident, and read back."""
    folder = scratch_path(t.spark, "telemetry")
    S.append_telemetry(t.telemetry, folder)
    return S.read_telemetry(t.spark, folder).select("event_id", "incident_id", "agent", "action", "output_summary", "result")


@query("s5_telemetry_replay", "SELECT incident_id, event_id, action, row_number() OVER (PARTITION BY incident_id ORDER BY event_id % 2 = 0, CASE WHEN event_id % 2 = 0 THEN event_id ELSE -event_id END) AS n FROM telemetry")
def telemetry_replay(t):
    """Two appends, the first against the order of time: the stored lines of every incident in write order, and those of
    one that was never written: none."""
    folder = scratch_path(t.spark, "telemetry")
    S.append_telemetry(t.telemetry.where("event_id % 2 <> 0"), folder, 0, (F.desc("event_id"),))
    S.append_telemetry(t.telemetry.where("event_id % 2 = 0"), folder, 1, ("event_id",))
    stored = S.read_telemetry(t.spark, folder).unionByName(S.read_telemetry(t.spark, folder, "inc_unknown"))
    return S.replay(stored.select("incident_id", "event_id", "action", "batch", "seq"))


@query("s6_fix_history_append", """
WITH base AS (SELECT count(*) AS n0 FROM fix_history), v AS (SELECT a.ord, f.exception_type FROM attempts a JOIN fix_history f USING (ord) WHERE a.outcome = 'passed')
SELECT ord, 'fix_' || CAST(n0 + row_number() OVER (ORDER BY ord) AS VARCHAR) || '_' || exception_type AS fix_id, exception_type FROM v, base""")
def fix_history_append(t):
    """Verified attempts appended to a stored history, with ids that continue it, and loaded again."""
    folder = scratch_path(t.spark, "fixes")
    S.append_fixes(t.fix_history.withColumn("fix_id", F.lit(None).cast("string")), folder)
    verified = t.attempts.where("outcome = 'passed'").select("ord").join(t.fix_history, "ord")
    S.append_fixes(S.record_fixes(S.load_fixes(t.spark, folder), verified), folder)
    return S.load_fixes(t.spark, folder).where("fix_id is not null").select("ord", "fix_id", "exception_type")


@query("s7_scorecard_store", """
SELECT true AS recorded, count(*) AS total_cases, count(*) FILTER (state IN ('COMPLETED', 'PENDING_APPROVAL')) AS successful_fixes FROM case_runs UNION ALL SELECT false, 0, 0""")
def scorecard_store(t):
    """Saved twice and loaded: the latest wins; a folder nobody wrote reads as not recorded."""
    from cilens.operators.outcomes import case_metrics, scorecard

    folder = scratch_path(t.spark, "scorecard")
    card = scorecard(case_metrics(t.case_runs))
    S.save_scorecard(scorecard(case_metrics(t.case_runs.where("case_id % 2 = 0"))), folder)
    S.save_scorecard(card, folder)
    found = S.load_scorecard(t.spark, folder).select("recorded", "total_cases", "successful_fixes")
    missing = S.load_scorecard(t.spark, scratch_path(t.spark, "scorecard"))
    return found.unionByName(missing.select("recorded", F.lit(0).cast("bigint").alias("total_cases"), F.lit(0).cast("bigint").alias("successful_fixes")))


@query("s8_ruff_reports", """
SELECT report_id, replace(i->>'filename', '/r/', '') AS file_path, CASE WHEN CAST(i->'location'->>'row' AS BIGINT) = 0 THEN 1 ELSE CAST(i->'location'->>'row' AS BIGINT) END AS line, i->>'code' AS code, i->>'message' AS message,
 coalesce(array_to_string(list_transform(CAST(i->'fix'->'edits' AS JSON[]), lambda e: e->>'content'), ''), '') AS suggested_fix, coalesce(i->'fix'->>'applicability', '') AS fix_applicability
FROM (SELECT report_id, unnest(CAST(report_text AS JSON[])) AS i FROM lint_reports WHERE kind = 'error')""")
def ruff_reports(t):
    return C.ruff(t.lint_reports.where("kind = 'error'")).drop("severity")


@query("s9_eslint_reports", """
SELECT report_id, replace(path, '/r/', '') AS file_path, CASE WHEN CAST(m->>'line' AS BIGINT) = 0 THEN 1 ELSE CAST(m->>'line' AS BIGINT) END AS line, m->>'ruleId' AS code, m->>'message' AS message
FROM (SELECT report_id, f->>'filePath' AS path, unnest(CAST(f->'messages' AS JSON[])) AS m FROM (SELECT report_id, unnest(CAST(report_text AS JSON[])) AS f FROM lint_reports WHERE kind = 'click')) WHERE CAST(m->>'severity' AS INT) = 2""")
def eslint_reports(t):
    return C.eslint(t.lint_reports.where("kind = 'click'")).select("report_id", "file_path", "line", "code", "message")


@query("s10_tsc_reports", """
SELECT report_id, trim(split_part(split_part(l, '):', 1), '(', 1)) AS file_path, CAST(split_part(split_part(split_part(l, '):', 1), '(', 2), ',', 1) AS BIGINT) AS line,
 regexp_extract(l, '(TS[0-9]+)', 1) AS code, trim(regexp_extract(l, 'TS[0-9]+:(.*)$', 1)) AS message
FROM (SELECT report_id, unnest(string_split(report_text, chr(10))) AS l FROM lint_reports WHERE kind = 'view') WHERE contains(l, '): error TS')""")
def tsc_reports(t):
    return C.tsc(t.lint_reports.where("kind = 'view'")).select("report_id", "file_path", "line", "code", "message")


@query("s11_pyflakes_reports", """
SELECT report_id, split_part(l, ':', 1) AS file_path, CAST(split_part(l, ':', 2) AS BIGINT) AS line, trim(substr(l, length(split_part(l, ':', 1)) + length(split_part(l, ':', 2)) + length(split_part(l, ':', 3)) + 4)) AS message
FROM (SELECT report_id, unnest(string_split(report_text, chr(10))) AS l FROM lint_reports WHERE kind IN ('purchase', 'signup')) WHERE TRY_CAST(split_part(l, ':', 2) AS BIGINT) IS NOT NULL""")
def pyflakes_reports(t):
    return C.pyflakes(t.lint_reports.where("kind in ('purchase', 'signup')")).select("report_id", "file_path", "line", "message")


@query("s12_audit_export", """
SELECT 'csv' AS kind, CAST(event_id AS VARCHAR) AS record_id, event_type AS action_type, CAST(user_id AS VARCHAR) AS actor_id, '' AS detail FROM events
UNION ALL SELECT 'json', CAST(event_id AS VARCHAR), event_type, CAST(user_id AS VARCHAR), json_extract_string(props, '$.k') FROM events""")
def audit_export(t):
    """CSV leaves the details map out, JSON keeps it; both are read back from storage."""
    rows = t.events.select(F.col("event_id").cast("string").alias("record_id"), F.col("event_type").alias("action_type"), F.col("user_id").cast("string").alias("actor_id"),
                           F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("details"))
    csv, js = scratch_path(t.spark, "audit-csv"), scratch_path(t.spark, "audit-json")
    S.export_csv(rows, csv)
    S.export_json(rows, js)
    back = t.spark.read.schema("record_id string, action_type string, actor_id string").option("header", "true").csv(csv)
    full = t.spark.read.schema(rows.schema).json(js)
    return (back.select(F.lit("csv").alias("kind"), "record_id", "action_type", "actor_id", F.lit("").alias("detail"))
            .unionByName(full.select(F.lit("json").alias("kind"), "record_id", "action_type", "actor_id", F.col("details")["k"].alias("detail"))))


@query("s13_file_integrity", """
SELECT CAST(doc_id AS VARCHAR) AS name, 'FILE_' || substr(sha256(text), 1, 12) AS file_id, doc_id % 9 <> 0 AND doc_id % 10 <> 0 AS intact FROM documents""")
def file_integrity(t):
    """Every tenth file was changed after indexing and every ninth is missing from storage."""
    named = t.documents.select(F.col("doc_id").cast("string").alias("name"), "doc_id", F.col("text").alias("content"))
    stored = named.where("doc_id % 9 <> 0").withColumn("content", F.when(F.col("doc_id") % 10 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return T.verify_integrity(stored, T.file_index(named))
