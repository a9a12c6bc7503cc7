"""Log-to-row queries."""

from pyspark.sql import functions as F

from cilens import rules
from cilens.functions import text as X
from cilens.operators import logs as L
from cilens.plans.registry import cte, query


def _words(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TRIM = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"

# One SQL reading of the dialects over a line table: banner flags and running sums instead
# of the row-wise arrays the Spark side uses, so the two do not share their method.
cte("d_logs", f"""
SELECT * REPLACE (regexp_replace(log_text, '\\r\\n?', chr(10), 'g') AS log_text), log_text AS raw_text, regexp_replace(regexp_replace(log_text, '\\r\\n?', chr(10), 'g'), {_q(rules.ANSI)}, '', 'g') AS clean FROM run_logs""")
cte("d_lang", f"""
SELECT *, CASE WHEN trim(regexp_replace(log_text, '\\s', '', 'g')) = '' THEN NULL
  WHEN {_words('log_text', rules.PY_MARKERS)} OR (contains(log_text, 'FAILED ') AND contains(log_text, '.py::')) THEN 'python'
  WHEN regexp_matches(log_text, {_q(rules.CPP_DIAG)}) OR regexp_matches(log_text, {_q(rules.GTEST)}) OR regexp_matches(log_text, {_q(rules.CTEST)}) THEN 'cpp'
  WHEN {_words('clean', rules.JS_MARKERS)} OR (regexp_matches(clean, '^\\s*●\\s+.+?\\s*$') AND regexp_matches(clean, {_q(rules.JS_FILE_REF)})) THEN 'javascript' END AS language
FROM d_logs""")
cte("d_lines", """
SELECT log_id, language, unnest(arr) AS line, generate_subscripts(arr, 1) AS pos
FROM (SELECT log_id, language, string_split(log_text, chr(10)) AS arr FROM d_lang WHERE language IS NOT NULL)""")
cte("d_marked", f"""
SELECT *, trim(line, {_TRIM}) AS t,
 CASE language WHEN 'python' THEN regexp_matches(trim(line, {_TRIM}), {_q(rules.PY_BANNER)})
  WHEN 'javascript' THEN regexp_matches(line, {_q(rules.JS_FAIL)}) OR (regexp_matches(line, {_q(rules.JS_BULLET)}) AND lower(regexp_extract(line, {_q(rules.JS_BULLET)}, 1)) NOT IN ('console','deprecation warning','validation error'))
  ELSE false END AS head FROM d_lines""")
cte("d_numbered", """
SELECT *, CAST(sum(CAST(head AS INT)) OVER (PARTITION BY log_id ORDER BY pos) AS BIGINT) AS sec,
 max(CAST(head AS INT)) OVER (PARTITION BY log_id) AS any_head FROM d_marked""")
# lines of every block (uncoloured logs have headings; coloured script logs stay whole)
cte("d_sections", """
SELECT log_id, language, CASE WHEN any_head = 1 THEN sec ELSE 1 END AS section_no, pos, line, t FROM d_numbered
WHERE any_head = 0 OR sec >= 1""")
cte("d_section_text", """
SELECT log_id, language, section_no, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '\\n$', '') AS section_text
FROM d_sections GROUP BY ALL""")


def _python_steps(prefix: str, unit: str, wide: str) -> None:
    """SQL parse of one text unit; ``wide`` holds the lines searched as a fallback."""
    def exc(source: str) -> str:
        return f"""SELECT log_id, section_no,
 coalesce(arg_max({{'a': regexp_extract(t, {_q(rules.PY_MARKED_EXC)}, 1), 'm': trim(regexp_extract(t, {_q(rules.PY_MARKED_EXC)}, 2), {_TRIM})}}, pos) FILTER (regexp_matches(t, {_q(rules.PY_MARKED_EXC)})),
  arg_max({{'a': regexp_extract(t, {_q(rules.PY_BARE_EXC)}, 1), 'm': trim(regexp_extract(t, {_q(rules.PY_BARE_EXC)}, 2), {_TRIM})}}, pos) FILTER (regexp_matches(t, {_q(rules.PY_BARE_EXC)}))) AS e
 FROM {source} WHERE NOT starts_with(t, 'FAILED') AND NOT starts_with(t, 'ERROR') GROUP BY ALL"""

    cte(f"{prefix}_frames", f"""
SELECT log_id, section_no, row_number() OVER (PARTITION BY log_id, section_no ORDER BY pos) AS frame_no,
 CASE WHEN regexp_matches(t, {_q(rules.PY_FRAME)}) THEN regexp_extract(t, {_q(rules.PY_FRAME)}, 1) ELSE regexp_extract(t, {_q(rules.PY_NATIVE_FRAME)}, 1) END AS file_path,
 CAST(CASE WHEN regexp_matches(t, {_q(rules.PY_FRAME)}) THEN regexp_extract(t, {_q(rules.PY_FRAME)}, 2) ELSE regexp_extract(t, {_q(rules.PY_NATIVE_FRAME)}, 2) END AS BIGINT) AS line_number,
 CASE WHEN regexp_matches(t, {_q(rules.PY_FRAME)}) THEN regexp_extract(t, {_q(rules.PY_FRAME)}, 3) ELSE regexp_extract(t, {_q(rules.PY_NATIVE_FRAME)}, 3) END AS function_name
FROM {unit} WHERE language = 'python' AND (regexp_matches(t, {_q(rules.PY_FRAME)}) OR regexp_matches(t, {_q(rules.PY_NATIVE_FRAME)}))""")
    cte(f"{prefix}_exc", exc(f"(SELECT * FROM {unit} WHERE language = 'python')"))
    cte(f"{prefix}_wide_exc", exc(f"(SELECT * FROM {wide} WHERE language = 'python')"))
    cte(f"{prefix}_sites", f"""
SELECT log_id, section_no, arg_max({{'f': regexp_extract(t, {_q(rules.PY_ERROR_SITE)}, 1), 'l': CAST(regexp_extract(t, {_q(rules.PY_ERROR_SITE)}, 2) AS BIGINT), 'x': regexp_extract(t, {_q(rules.PY_ERROR_SITE)}, 3)}}, pos) AS s
FROM {unit} WHERE language = 'python' AND regexp_matches(t, {_q(rules.PY_ERROR_SITE)}) GROUP BY ALL""")
    cte(f"{prefix}_summary", f"""
SELECT log_id, section_no, arg_min({{'f': regexp_extract(t, {_q(rules.PY_SUMMARY)}, 1), 't': regexp_extract(t, {_q(rules.PY_SUMMARY)}, 2), 'x': nullif(regexp_extract(t, {_q(rules.PY_SUMMARY)}, 3), ''), 'm': trim(regexp_extract(t, {_q(rules.PY_SUMMARY)}, 4), {_TRIM})}}, pos) AS y
FROM {wide} WHERE language = 'python' AND regexp_matches(t, {_q(rules.PY_SUMMARY)}) GROUP BY ALL""")
    cte(f"{prefix}_deep", f"""
SELECT log_id, section_no, count(*) AS n_frames, arg_max({{'f': file_path, 'l': line_number}}, frame_no) AS deepest,
 arg_max({{'f': file_path, 'l': line_number}}, frame_no) FILTER (NOT (starts_with(regexp_extract(lower(file_path), '[^/]*$'), 'test_') OR ends_with(lower(file_path), '_test.py') OR contains(lower(file_path), '/tests/') OR starts_with(lower(file_path), 'tests/'))) AS code
FROM {prefix}_frames GROUP BY ALL""")
    cte(f"{prefix}_heads", f"""
SELECT log_id, section_no, any_value(nullif(regexp_extract(t, {_q(rules.PY_BANNER)}, 1), '')) FILTER (regexp_matches(t, {_q(rules.PY_BANNER)})) AS test
FROM {unit} WHERE language = 'python' GROUP BY ALL""")
    cte(f"{prefix}_python", f"""
SELECT h.log_id, h.section_no, 'python' AS language, coalesce(h.test, y.t, 'unknown_test') AS test_name,
 coalesce(s.f, d.code.f, d.deepest.f, y.f, '') AS failing_file, CAST(coalesce(s.l, d.code.l, d.deepest.l, 0) AS BIGINT) AS failing_line,
 coalesce(e.a, w.a, y.x, s.x, 'UnknownError') AS exception_type,
 CASE WHEN e IS NOT NULL THEN e.m WHEN w IS NOT NULL THEN w.m WHEN y.x IS NOT NULL THEN y.m ELSE '' END AS exception_message,
 CAST(coalesce(d.n_frames, 0) AS BIGINT) AS n_frames,
 h.test IS NULL AND y.t IS NULL AND e IS NULL AND w IS NULL AND s IS NULL AND d.n_frames IS NULL AND y.f IS NULL AS rejected
FROM {prefix}_heads h LEFT JOIN {prefix}_exc USING (log_id, section_no) LEFT JOIN (SELECT log_id, section_no, e AS w FROM {prefix}_wide_exc) USING (log_id, section_no)
 LEFT JOIN {prefix}_sites USING (log_id, section_no) LEFT JOIN {prefix}_summary USING (log_id, section_no) LEFT JOIN {prefix}_deep d USING (log_id, section_no)""")


def _js_steps(prefix: str, unit: str) -> None:
    name = (f"CASE WHEN regexp_matches(line, {_q(rules.JS_FAIL)}) THEN regexp_extract(line, {_q(rules.JS_FAIL)}, 2) "
            f"WHEN regexp_matches(line, {_q(rules.JS_BULLET)}) AND lower(regexp_extract(line, {_q(rules.JS_BULLET)}, 1)) NOT IN ('console','deprecation warning','validation error') THEN regexp_extract(line, {_q(rules.JS_BULLET)}, 1) END")
    cte(f"{prefix}_js_frames", f"""
SELECT log_id, section_no, row_number() OVER (PARTITION BY log_id, section_no ORDER BY pos) AS frame_no,
 CASE WHEN regexp_matches(line, {_q(rules.JS_FRAME)}) THEN regexp_extract(line, {_q(rules.JS_FRAME)}, 2) ELSE regexp_extract(line, {_q(rules.JS_ARROW_FRAME)}, 1) END AS file_path,
 CAST(CASE WHEN regexp_matches(line, {_q(rules.JS_FRAME)}) THEN regexp_extract(line, {_q(rules.JS_FRAME)}, 3) ELSE regexp_extract(line, {_q(rules.JS_ARROW_FRAME)}, 2) END AS BIGINT) AS line_number,
 CASE WHEN regexp_matches(line, {_q(rules.JS_FRAME)}) AND regexp_extract(line, {_q(rules.JS_FRAME)}, 1) <> '' THEN regexp_extract(line, {_q(rules.JS_FRAME)}, 1) ELSE 'unknown' END AS function_name
FROM {unit} WHERE regexp_matches(line, {_q(rules.JS_FRAME)}) OR regexp_matches(line, {_q(rules.JS_ARROW_FRAME)})""")
    cte(f"{prefix}_js_site", f"""
SELECT log_id, section_no, count(*) AS n_frames, coalesce(arg_min({{'f': file_path, 'l': line_number}}, frame_no) FILTER (NOT (contains(regexp_extract(lower(file_path), '[^/]*$'), '.test.') OR contains(regexp_extract(lower(file_path), '[^/]*$'), '.spec.') OR contains(lower(file_path), '__tests__/'))),
  arg_min({{'f': file_path, 'l': line_number}}, frame_no)) AS s FROM {prefix}_js_frames GROUP BY ALL""")
    cte(f"{prefix}_js_parts", f"""
SELECT log_id, section_no, arg_min({name}, pos) AS header,
 arg_min({{'a': regexp_extract(t, {_q(rules.JS_ERROR)}, 1), 'm': trim(regexp_extract(t, {_q(rules.JS_ERROR)}, 2), {_TRIM})}}, pos) FILTER (regexp_matches(t, {_q(rules.JS_ERROR)})) AS named,
 arg_max(trim(substr(t, 10), {_TRIM}), pos) FILTER (starts_with(t, 'Expected:')) AS want,
 arg_max(trim(substr(t, 10), {_TRIM}), pos) FILTER (starts_with(t, 'Received:')) AS got,
 bool_or({_words('line', rules.JS_ASSERTION_MARKERS)}) AS asserted FROM {unit} GROUP BY ALL""")
    cte(f"{prefix}_js", f"""
SELECT p.log_id, p.section_no, 'javascript' AS language,
 coalesce(nullif(trim(list_extract(string_split_regex(trim(header, {_TRIM}), {_q(rules.JS_SPLIT_NAME)}), -1), {_TRIM}), ''), 'unknown_test') AS test_name,
 coalesce(s.f, '') AS failing_file, CAST(coalesce(s.l, 0) AS BIGINT) AS failing_line, coalesce(named.a, 'AssertionError') AS exception_type,
 CASE WHEN named IS NOT NULL THEN named.m WHEN want IS NOT NULL OR got IS NOT NULL THEN 'expected ' || coalesce(want, 'None') || ', received ' || coalesce(got, 'None') WHEN asserted THEN 'Assertion failed' ELSE '' END AS exception_message,
 CAST(coalesce(n_frames, 0) AS BIGINT) AS n_frames,
 header IS NULL AND n_frames IS NULL AND named IS NULL AND want IS NULL AND got IS NULL AND NOT asserted AS rejected
FROM {prefix}_js_parts p LEFT JOIN {prefix}_js_site USING (log_id, section_no)""")


# whole-log parse: first block, falling back to the whole log
cte("d_first_lines", "SELECT log_id, language, section_no, pos, line, t FROM d_sections WHERE section_no = 1")
cte("d_wide_lines", "SELECT log_id, language, CAST(1 AS BIGINT) AS section_no, pos, line, t FROM d_marked")
_python_steps("f", "d_first_lines", "d_wide_lines")
cte("d_js_clean", """
SELECT log_id, unnest(arr) AS line, generate_subscripts(arr, 1) AS pos FROM (SELECT log_id, string_split(clean, chr(10)) AS arr FROM d_lang WHERE language = 'javascript')""")
_JS_HEAD_SQL = (f"(regexp_matches(line, {_q(rules.JS_FAIL)}) OR (regexp_matches(line, {_q(rules.JS_BULLET)}) AND "
                f"lower(regexp_extract(line, {_q(rules.JS_BULLET)}, 1)) NOT IN ('console','deprecation warning','validation error')))")
cte("d_js_bounds", f"""
SELECT log_id, min(pos) FILTER ({_JS_HEAD_SQL}) AS start_pos FROM d_js_clean GROUP BY log_id""")
cte("d_js_ends", f"""
SELECT c.log_id, min(pos) AS end_pos FROM d_js_clean c JOIN d_js_bounds b ON c.log_id = b.log_id AND pos > start_pos
WHERE {_JS_HEAD_SQL} OR starts_with(line, 'Test Suites:') OR starts_with(line, 'Tests:') OR starts_with(line, ' Test Files ') GROUP BY c.log_id""")
cte("d_js_first", f"""
SELECT c.log_id, CAST(1 AS BIGINT) AS section_no, pos, line, trim(line, {_TRIM}) AS t FROM d_js_clean c JOIN d_js_bounds b ON c.log_id = b.log_id LEFT JOIN d_js_ends e ON c.log_id = e.log_id
WHERE start_pos IS NULL OR (pos >= start_pos AND (end_pos IS NULL OR pos < end_pos))""")
_js_steps("f", "d_js_first")
cte("f_cpp", f"""
SELECT log_id, CAST(1 AS BIGINT) AS section_no, 'cpp' AS language,
 CASE WHEN built THEN 'c++ build' ELSE coalesce(g, nullif(regexp_extract(log_text, {_q(rules.CTEST)}, 1), ''), 'c++ test') END AS test_name,
 CASE WHEN built THEN regexp_extract(log_text, {_q(rules.CPP_DIAG)}, 1) ELSE '' END AS failing_file,
 CASE WHEN built THEN CAST(regexp_extract(log_text, {_q(rules.CPP_DIAG)}, 2) AS BIGINT) ELSE 0 END AS failing_line,
 CASE WHEN built THEN 'CompilerError' ELSE 'AssertionError' END AS exception_type,
 CASE WHEN built THEN trim(regexp_extract(log_text, {_q(rules.CPP_DIAG)}, 5)) ELSE 'C++ test failed' END AS exception_message,
 CAST(CASE WHEN built THEN 1 ELSE 0 END AS BIGINT) AS n_frames, false AS rejected
FROM (SELECT l.*, regexp_matches(log_text, {_q(rules.CPP_DIAG)}) AS built, g FROM d_lang l LEFT JOIN
  (SELECT log_id, arg_min(regexp_extract(t, {_q(rules.GTEST)}, 1), pos) AS g FROM d_marked WHERE regexp_matches(t, {_q(rules.GTEST)}) GROUP BY log_id) USING (log_id) WHERE language = 'cpp')""")
cte("d_first_all", """
SELECT * FROM f_python UNION ALL BY NAME SELECT * FROM f_js UNION ALL BY NAME SELECT * FROM f_cpp""")
cte("d_failures", "SELECT f.*, r.repo_id FROM d_first_all f JOIN run_logs r USING (log_id) WHERE NOT rejected")
# per-block parse
cte("d_block_py", "SELECT * FROM d_sections WHERE language = 'python'")
_python_steps("b", "d_block_py", "d_block_py")
cte("d_block_clean", f"""
SELECT log_id, section_no, pos, regexp_replace(line, {_q(rules.ANSI)}, '', 'g') AS line FROM d_sections WHERE language = 'javascript'""")
# inside a block, parsing starts at its own header and stops at the run totals
cte("d_block_starts", f"""
SELECT log_id, section_no, min(pos) FILTER ({_JS_HEAD_SQL}) AS start_pos FROM d_block_clean GROUP BY ALL""")
cte("d_block_ends", f"""
SELECT c.log_id, c.section_no, min(pos) AS end_pos FROM d_block_clean c JOIN d_block_starts b ON c.log_id = b.log_id AND c.section_no = b.section_no AND pos > start_pos
WHERE {_JS_HEAD_SQL} OR starts_with(line, 'Test Suites:') OR starts_with(line, 'Tests:') OR starts_with(line, ' Test Files ') GROUP BY ALL""")
cte("d_block_js", f"""
SELECT c.log_id, c.section_no, pos, line, trim(line, {_TRIM}) AS t FROM d_block_clean c JOIN d_block_starts b ON c.log_id = b.log_id AND c.section_no = b.section_no
 LEFT JOIN d_block_ends e ON c.log_id = e.log_id AND c.section_no = e.section_no
WHERE start_pos IS NULL OR (pos >= start_pos AND (end_pos IS NULL OR pos < end_pos))""")
_js_steps("b", "d_block_js")
cte("d_blocks_all", """
SELECT * FROM b_python UNION ALL BY NAME SELECT * FROM b_js UNION ALL BY NAME SELECT * FROM f_cpp""")
cte("d_run_failures", """
SELECT *, language || '-' || CAST(row_number() OVER (PARTITION BY log_id, language ORDER BY section_no) AS VARCHAR) AS failure_id
FROM d_blocks_all WHERE NOT rejected""")

PARSED = ["log_id", "language", "test_name", "failing_file", "failing_line", "exception_type", "exception_message"]


@query("failures_by_type", """
SELECT language, exception_type, failing_file, count(*) AS n, count(DISTINCT repo_id) AS repos FROM d_run_failures JOIN run_logs USING (log_id) GROUP BY ALL""")
def failures_by_type(t):
    # repo counting first collapses to one row per repository, so the hot file stays spread
    return (L.run_failures(t.run_logs).groupBy("language", "exception_type", "failing_file", "repo_id").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("language", "exception_type", "failing_file")
            .agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("repos")))


@query("l1_ansi_strip", f"SELECT log_id, regexp_replace(log_text, {_q(rules.ANSI)}, '', 'g') AS clean_text FROM run_logs")
def ansi_strip(t):
    return t.run_logs.select("log_id", X.ansi_free(F.col("log_text")).alias("clean_text"))


@query("l2_runner_classification", "SELECT log_id, language FROM d_lang")
def runner_classification(t):
    return t.run_logs.select("log_id", L.runner_language(F.col("log_text")).alias("language"))


@query("l4_log_lines", """
SELECT log_id, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS pos, unnest(arr) AS line FROM (SELECT log_id, string_split_regex(log_text, '\\r\\n|\\r|\\n') AS arr FROM run_logs)""")
def log_lines(t):
    return t.run_logs.select("log_id", F.posexplode(X.lines(F.col("log_text"))).alias("p", "line")).select(
        "log_id", F.col("p").cast("bigint").alias("pos"), "line")


@query("l5_pytest_sections", f"""
SELECT log_id, section_no, section_text, coalesce(regexp_extract(trim(string_split(section_text, chr(10))[1], {_TRIM}), {_q(rules.PY_BANNER)}, 1), '') AS test_name
FROM d_section_text WHERE language = 'python'""")
def pytest_sections(t):
    return (L.failure_sections(t.run_logs).where("language = 'python'")
            .select("log_id", "section_no", "section_text",
                    F.coalesce(L.banner_name(F.col("section_text")), F.lit("")).alias("test_name")))


@query("l6_script_sections", "SELECT log_id, section_no, section_text FROM d_section_text WHERE language = 'javascript'")
def script_sections(t):
    return L.failure_sections(t.run_logs).where("language = 'javascript'").select("log_id", "section_no", "section_text")


def _frames(t, language):
    parsed = L.parse(L.failure_sections(t.run_logs).where(F.col("language") == language), text="section_text")
    return parsed.select("log_id", "section_no", F.posexplode("frames").alias("p", "f")).select(
        "log_id", "section_no", (F.col("p") + 1).cast("bigint").alias("frame_no"), "f.file_path", "f.line_number", "f.function_name")


@query("l7_python_frames", "SELECT * FROM b_frames")
def python_frames(t):
    return _frames(t, "python")


@query("l8_script_frames", "SELECT * FROM b_js_frames")
def script_frames(t):
    return _frames(t, "javascript")


def _python_logs(t):
    logs = L.first_owned(t.run_logs).where("language = 'python'").withColumn("log_text", X.unix_lines(F.col("log_text")))
    return logs.withColumn(
        "section", F.element_at(L.python_sections(F.col("log_text")), 1))


@query("l9_error_site", "SELECT log_id, s.f AS file, s.l AS line, s.x AS type FROM f_sites")
def error_site(t):
    return (_python_logs(t).select("log_id", L.python_error_site(F.col("section")).alias("s"))
            .where("s is not null").select("log_id", "s.file", "s.line", "s.type"))


@query("l10_exception_line", """
SELECT log_id, coalesce(e.a, w.a) AS type, CASE WHEN e IS NOT NULL THEN e.m ELSE w.m END AS message
FROM (SELECT log_id, e AS w FROM f_wide_exc) LEFT JOIN f_exc USING (log_id) WHERE e IS NOT NULL OR w IS NOT NULL""")
def exception_line(t):
    e = F.coalesce(L.python_exception(F.col("section")), L.python_exception(F.col("log_text")))
    return _python_logs(t).select("log_id", e.alias("e")).where("e is not null").select("log_id", "e.type", "e.message")


@query("l11_summary_line", "SELECT log_id, y.f AS file, y.t AS test, y.x AS type, y.m AS message FROM f_summary")
def summary_line(t):
    return (_python_logs(t).select("log_id", L.python_summary(F.col("log_text")).alias("s"))
            .where("s is not null").select("log_id", "s.file", "s.test", "s.type", "s.message"))


@query("l12_exception_resolution", "SELECT log_id, exception_type, exception_message FROM f_python WHERE NOT rejected")
def exception_resolution(t):
    return L.first_failures(t.run_logs).where("language = 'python'").select("log_id", "exception_type", "exception_message")


@query("l13_failure_site", "SELECT log_id, test_name, failing_file, failing_line FROM f_python WHERE NOT rejected")
def failure_site(t):
    return L.first_failures(t.run_logs).where("language = 'python'").select("log_id", "test_name", "failing_file", "failing_line")


@query("l14_script_site", "SELECT log_id, failing_file, failing_line, n_frames FROM f_js WHERE NOT rejected")
def script_site(t):
    return L.first_failures(t.run_logs).where("language = 'javascript'").select(
        "log_id", "failing_file", "failing_line", F.size("frames").cast("bigint").alias("n_frames"))


@query("l15_script_error", "SELECT log_id, exception_type, exception_message FROM f_js WHERE NOT rejected")
def script_error(t):
    return L.first_failures(t.run_logs).where("language = 'javascript'").select("log_id", "exception_type", "exception_message")


@query("l16_leaf_test_name", "SELECT log_id, test_name FROM f_js WHERE NOT rejected")
def leaf_test_name(t):
    return L.first_failures(t.run_logs).where("language = 'javascript'").select("log_id", "test_name")


@query("l17_compiler_failure", "SELECT log_id, test_name, failing_file, failing_line, exception_type, exception_message, n_frames FROM f_cpp")
def compiler_failure(t):
    return L.first_failures(t.run_logs).where("language = 'cpp'").select(
        "log_id", "test_name", "failing_file", "failing_line", "exception_type", "exception_message",
        F.size("frames").cast("bigint").alias("n_frames"))


@query("l18_parse_or_reject", """
SELECT log_id, language, 'no failure identified' AS reject_reason, 'check that the log holds a failure section' AS remedy FROM d_first_all WHERE rejected
UNION ALL SELECT log_id, language, CASE WHEN trim(log_text) = '' THEN 'empty log' ELSE 'no runner recognised' END,
 CASE WHEN trim(log_text) = '' THEN 'run the suite and pass its combined output' ELSE 'check that the log holds a failure section' END FROM d_lang WHERE language IS NULL""")
def parse_or_reject(t):
    return L.rejects(t.run_logs)


COLLECTED_NOTHING = " OR ".join(f"(language = '{lang}' AND {_words('lower(log_text)', words)})" for lang, words in rules.COLLECTED_NOTHING.items())


@query("l19_ran_nothing", f"""
SELECT log_id, language, exit_code, ({COLLECTED_NOTHING}) AS collected_nothing,
 (language = 'python' AND exit_code IN (4, 5)) OR (language = 'cpp' AND {_words('lower(log_text)', rules.RAN_NOTHING_TEXT['cpp'])}) OR (language = 'javascript' AND {_words('lower(log_text)', rules.RAN_NOTHING_TEXT['javascript'])}) AS ran_nothing
FROM (SELECT log_id, coalesce(language, 'python') AS language, log_id % 6 AS exit_code, log_text FROM d_lang)""")
def ran_nothing(t):
    logs = t.run_logs.select("log_id", F.coalesce(L.runner_language(F.col("log_text")), F.lit("python")).alias("language"),
                             (F.col("log_id") % 6).alias("exit_code"), "log_text")
    return logs.select("log_id", "language", "exit_code",
                       L.collected_nothing(F.col("log_text"), F.col("language")).alias("collected_nothing"),
                       L.ran_nothing(F.col("exit_code"), F.col("log_text"), F.col("language")).alias("ran_nothing"))


@query("l20_run_failures", f"SELECT {', '.join(PARSED)}, failure_id FROM d_run_failures")
def run_failures(t):
    return L.run_failures(t.run_logs).select(*PARSED, "failure_id")


@query("l22_feedback_truncation", """
SELECT doc_id, CASE WHEN length(text) <= 4000 THEN text ELSE left(text, 2000) || chr(10) || '...' || chr(10) || '[truncated]' || chr(10) || '...' || chr(10) || right(text, 2000) END AS feedback FROM documents""")
def feedback_truncation(t):
    return t.documents.select("doc_id", L.feedback(F.col("text")).alias("feedback"))


@query("a5_failures_per_language", """
SELECT 'language' AS kind, language AS label, count(*) AS n FROM d_run_failures GROUP BY ALL UNION ALL SELECT 'gate', gate, count(*) FROM diagnostics GROUP BY ALL""")
def failures_per_language(t):
    a = L.run_failures(t.run_logs).groupBy(F.col("language").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("language"))
    b = t.diagnostics.groupBy(F.col("gate").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("gate"))
    return a.unionByName(b)


@query("p16_missing_module", f"""
SELECT log_id, nullif(regexp_extract(body, {_q(rules.MISSING_MODULE)}, 1), '') AS missing_module, regexp_matches(body, {_q(rules.MISSING_MODULE)}) AS environment_fault
FROM (SELECT log_id, CASE WHEN log_id % 3 = 0 THEN log_text || chr(10) || 'ModuleNotFoundError: No module named ' || chr(39) || 'pkg_' || CAST(log_id % 50 AS VARCHAR) || chr(39) ELSE log_text END AS body FROM run_logs)""")
def missing_module(t):
    body = F.when(F.col("log_id") % 3 == 0, F.concat("log_text", F.lit("\nModuleNotFoundError: No module named 'pkg_"), (F.col("log_id") % 50).cast("string"), F.lit("'"))).otherwise(F.col("log_text"))
    return t.run_logs.withColumn("body", body).select(
        "log_id", X.blank_to_null(F.regexp_extract("body", rules.MISSING_MODULE, 1)).alias("missing_module"),
        F.col("body").rlike(rules.MISSING_MODULE).alias("environment_fault"))
