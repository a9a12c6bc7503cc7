"""CI-shaped views over the raw tables, as SQL both Spark and DuckDB accept.

Every view is sized by its base table: repositories hold a fixed number of symbols and
users, so more data means more repositories, not denser ones.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_EXC = ("CASE WHEN user_id % 3 = 0 THEN 'ZeroDivisionError: division by zero' "
        "WHEN user_id % 3 = 1 THEN 'KeyError: missing key' ELSE 'AssertionError: assert 1 == 2' END")
_EXC_TYPE = ("CASE WHEN user_id % 3 = 0 THEN 'ZeroDivisionError' "
             "WHEN user_id % 3 = 1 THEN 'KeyError' ELSE 'AssertionError' END")
_NL = "chr(10)"
_DOC = '"""'
# every third of these logs is coloured on each line
_RED = "CASE WHEN event_id % 3 = 0 THEN concat(chr(27), '[31m') ELSE '' END"
_PLAIN = "CASE WHEN event_id % 3 = 0 THEN concat(chr(27), '[39m') ELSE '' END"

VIEWS: dict[str, str] = {
    # one row per code symbol; 400 symbols per repository, names repeat inside one
    "symbols": """
SELECT concat('repo_', CAST(CAST(floor(p_partkey / 400) AS BIGINT) AS STRING)) AS repo_id,
 concat('src/mod_', CAST(p_partkey % 40 AS STRING), '.py::Svc', CAST(p_partkey % 3 AS STRING), '.fn_', CAST(p_partkey AS STRING)) AS symbol_id,
 concat('fn_', CAST(p_partkey % 200 AS STRING)) AS name,
 CASE WHEN p_partkey % 7 = 0 THEN 'test' WHEN p_partkey % 5 = 0 THEN 'class' WHEN p_partkey % 2 = 0 THEN 'method' ELSE 'function' END AS symbol_type,
 concat(CASE WHEN p_partkey % 7 = 0 THEN 'tests/test_mod_' ELSE 'src/mod_' END, CAST(p_partkey % 40 AS STRING), '.py') AS file_path,
 CAST(floor(p_partkey % 400 / 40) * 12 + 1 AS BIGINT) AS start_line,
 CAST(floor(p_partkey % 400 / 40) * 12 + 1 + p_size % 12 AS BIGINT) AS end_line,
 p_partkey % 7 = 0 AS is_test, p_partkey AS ord FROM part""",
    "call_refs": """
SELECT DISTINCT l_partkey AS ord, concat('fn_', CAST((l_partkey * 7 + l_linenumber * 13) % 200 AS STRING)) AS callee_name FROM lineitem""",
    "run_logs": f"""
SELECT event_id AS log_id, concat('repo_', CAST(CAST(floor(user_id / 30) AS BIGINT) AS STRING)) AS repo_id, ts, event_type,
 CASE event_type WHEN 'error' THEN concat('=== FAILURES ===', {_NL}, '______________ test_fn_', CAST(user_id AS STRING), ' ______________', {_NL},
   'tests/test_mod_', CAST(user_id % 40 AS STRING), '.py:5: in test_fn_', CAST(user_id AS STRING), {_NL},
   CASE WHEN event_id % 4 = 0 THEN concat('  File "src/mod_', CAST(event_id % 40 AS STRING), '.py", line ', CAST(1 + event_id % 120 AS STRING), ', in fn_', CAST(event_id % 200 AS STRING)) ELSE concat('src/mod_', CAST(event_id % 40 AS STRING), '.py:', CAST(1 + event_id % 120 AS STRING), ': in fn_', CAST(event_id % 200 AS STRING)) END, {_NL},
   'E       ', {_EXC}, CASE WHEN event_id % 10 = 7 THEN concat(chr(13), 'progress 10%') ELSE '' END, {_NL},
   CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('src/mod_', CAST(event_id % 40 AS STRING), '.py:', CAST(1 + event_id % 120 AS STRING), ': ', {_EXC_TYPE}, {_NL}) END,
   CASE WHEN event_id % 6 = 0 THEN concat('______________ test_second_', CAST(user_id AS STRING), ' ______________', {_NL}, 'src/mod_', CAST(event_id % 40 AS STRING), '.py:7: in helper', {_NL}, 'ValueError: bad input', {_NL}) ELSE '' END,
   CASE WHEN event_id % 2 = 0 THEN concat('FAILED tests/test_mod_', CAST(user_id % 40 AS STRING), '.py::test_fn_', CAST(user_id AS STRING), ' - ', {_EXC}) ELSE '' END)
 WHEN 'click' THEN concat(' FAIL  web/parcel.test.ts', {_NL}, '  ', '●', ' parcel ', '›', ' case ', CAST(user_id AS STRING), {_NL}, '    Expected: ', CAST(user_id AS STRING), {_NL}, '    Received: ', CAST(event_id % 100 AS STRING), {_NL}, '      at quotePostage (web/parcel_', CAST(event_id % 20 AS STRING), '.ts:', CAST(1 + event_id % 90 AS STRING), ':10)', {_NL}, 'Test Suites: 1 failed, 1 total')
 WHEN 'view' THEN concat(chr(27), '[31m FAIL  src/v', CAST(event_id % 9 AS STRING), '.test.ts > parcel > case ', CAST(user_id AS STRING), chr(27), '[0m', {_NL}, {_RED}, 'TypeError: x is not a function', {_PLAIN}, {_NL}, {_RED}, ' ', '❯', ' src/v', CAST(event_id % 9 AS STRING), '.ts:', CAST(1 + event_id % 90 AS STRING), ':3', {_PLAIN}, {_NL}, ' RUN  v1.2.0')
 WHEN 'purchase' THEN concat('src/m', CAST(event_id % 30 AS STRING), '.cpp:', CAST(1 + event_id % 200 AS STRING), ':5: error: use of undeclared identifier ', chr(39), 'v', CAST(user_id AS STRING), chr(39))
 ELSE 'collected 0 items' END AS log_text FROM events""",
    "telemetry": """
SELECT event_id, ts, concat('inc_', CAST(user_id AS STRING)) AS incident_id,
 CASE event_type WHEN 'error' THEN 'VerificationAgent' WHEN 'purchase' THEN 'HumanApprovalChecker' ELSE 'Orchestrator' END AS agent,
 CASE WHEN event_id % 53 = 0 THEN 'PIPELINE_HALTED' WHEN event_type = 'error' THEN 'VERIFY_PATCH_SANDBOX' WHEN event_type = 'purchase' THEN 'AUTO_APPLY_APPROVED' ELSE 'STATE_TRANSITION' END AS action,
 CASE event_id % 9 WHEN 0 THEN 'IDLE' WHEN 1 THEN 'LOCALIZING' WHEN 2 THEN 'RETRIEVING' WHEN 3 THEN 'PATCHING' WHEN 4 THEN 'VERIFYING' WHEN 5 THEN 'CHECKING_SAFETY' WHEN 6 THEN 'PENDING_APPROVAL' WHEN 7 THEN 'COMPLETED' ELSE 'FAILED' END AS output_summary,
 CASE event_id % 4 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'FAILURE' WHEN 2 THEN 'IN_PROGRESS' ELSE 'REQUIRES_APPROVAL' END AS result FROM events""",
    "diagnostics": """
SELECT event_id AS ord, concat('repo_', CAST(CAST(floor(user_id / 6) AS BIGINT) AS STRING)) AS repo_id, CASE WHEN event_id % 2 = 0 THEN 'baseline' ELSE 'after' END AS phase,
 CASE event_type WHEN 'error' THEN 'python-syntax' WHEN 'click' THEN 'ruff' WHEN 'view' THEN 'tsc' WHEN 'purchase' THEN 'eslint' ELSE 'pyflakes' END AS gate,
 concat(CASE WHEN event_id % 11 = 0 THEN 'node_modules/x/' WHEN event_id % 13 = 0 THEN './.venv/lib/' ELSE 'src/' END, 'm', CAST(event_id % 6 AS STRING), '.py') AS file_path,
 event_id % 300 + 1 AS line, concat('E', CAST(event_id % 4 AS STRING)) AS code, concat('problem ', CAST(user_id % 3 AS STRING), CASE WHEN event_id % 17 = 0 THEN concat(' in fn_', CAST(event_id % 200 AS STRING)) ELSE '' END) AS message,
 CASE WHEN event_id % 5 = 0 THEN 'warning' ELSE 'error' END AS severity, CASE WHEN event_id % 3 = 0 THEN 'safe' WHEN event_id % 3 = 1 THEN 'unsafe' ELSE '' END AS fix_applicability FROM events""",
    "attempts": """
SELECT o_orderkey AS ord, concat('inc_', CAST(o_custkey AS STRING)) AS incident_id,
 CASE WHEN o_custkey % 4 = 0 THEN 'patch_rejected' WHEN o_custkey % 4 = 1 THEN 'check_failed' WHEN o_orderkey % 5 = 0 THEN 'generation_failed' WHEN o_orderkey % 5 = 1 THEN 'passed' WHEN o_orderkey % 5 = 2 THEN 'autofixed' ELSE 'check_failed' END AS outcome,
 CASE WHEN o_custkey % 3 = 0 THEN 'gate:ruff' ELSE 'test-suite' END AS oracle_name, o_totalprice AS detail_num FROM orders""",
    "patches": f"""
SELECT p_partkey AS patch_id, concat(CASE p_partkey % 5 WHEN 0 THEN 'auth/' WHEN 1 THEN 'services/' ELSE 'src/' END, 'mod_', CAST(p_partkey % 40 AS STRING), '.py') AS target_file,
 concat(CASE p_partkey % 6 WHEN 0 THEN 'login_user_' WHEN 1 THEN 'discard_' ELSE 'compute_' END, CAST(p_partkey AS STRING)) AS function_name,
 CASE WHEN p_partkey % 17 = 0 THEN '' ELSE concat('--- a/x.py', {_NL}, '+++ b/x.py', {_NL}, '@@ -', CAST(1 + p_partkey % 90 AS STRING), ',2 +', CAST(1 + p_partkey % 90 AS STRING), ',2 @@', {_NL}, ' context_', CAST(p_partkey % 9 AS STRING), {_NL}, '-rate = 0', {_NL}, '+', CASE p_partkey % 8 WHEN 0 THEN 'os.remove(p)' WHEN 1 THEN 'q = "DELETE FROM t"' WHEN 2 THEN 'eval(x)' ELSE concat('rate = ', CAST(p_size AS STRING)) END) END AS unified_diff FROM part""",
    "fix_history": f"""
SELECT o_orderkey AS ord, CASE o_orderkey % 3 WHEN 0 THEN 'ZeroDivisionError' WHEN 1 THEN 'TypeError' ELSE 'ValueError' END AS exception_type,
 CASE o_orderkey % 4 WHEN 0 THEN 'division by zero' WHEN 1 THEN 'x is not a function' WHEN 2 THEN 'missing value here' ELSE 'bad input' END AS exception_message,
 concat('src/mod_', CAST(o_orderkey % 40 AS STRING), '.py::fn_', CAST(o_orderkey % 200 AS STRING)) AS failing_symbol,
 concat('--- a/mod_', CAST(o_orderkey % 40 AS STRING), '.py', {_NL}, '+rate = ', CAST(o_custkey AS STRING)) AS applied_diff FROM orders""",
    "api_requests": """
SELECT event_id AS req_id, event_type AS provider, event_id * 2 AS t_sec, event_id * 37 % 4000 AS tokens FROM events""",
    "case_runs": """
SELECT o_orderkey AS case_id, o_orderpriority AS bug_category, concat('fn_', CAST(o_custkey % 50 AS STRING)) AS expected_symbol,
 CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'other' ELSE concat('Svc.fn_', CAST(o_custkey % 50 AS STRING)) END AS suspect_function,
 CASE o_orderkey % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PENDING_APPROVAL' ELSE 'COMPLETED' END AS state, o_orderkey % 4 AS attempts, o_totalprice / 10000 AS elapsed_s FROM orders""",
    "chunk_old": """
SELECT source AS repo_id, concat('doc_', CAST(doc_id AS STRING)) AS chunk_id, text AS code FROM documents WHERE doc_id % 10 <> 0""",
    "chunk_new": """
SELECT source AS repo_id, concat('doc_', CAST(doc_id AS STRING)) AS chunk_id, CASE WHEN doc_id % 5 = 0 THEN concat(text, ' x') ELSE text END AS code FROM documents WHERE doc_id % 7 <> 0""",
    "secrets": """
SELECT conv_id, 'KEY_A' AS key, substr(text, 1, 4) AS value, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 3 END AS place FROM conversations WHERE turn = 0
UNION ALL SELECT conv_id, 'KEY_B' AS key, substr(text, 1, 9) AS value, 2 AS place FROM conversations WHERE turn = 0""",
    "lint_reports": f"""
SELECT event_id AS report_id, event_type AS kind,
 CASE event_type WHEN 'error' THEN concat('[{{"filename":"/r/src/m', CAST(event_id % 6 AS STRING), '.py","location":{{"row":', CAST(event_id % 300 AS STRING), '}},"message":"problem ', CAST(user_id % 3 AS STRING), '","code":"E', CAST(event_id % 4 AS STRING), '","fix":', CASE WHEN event_id % 2 = 0 THEN '{{"applicability":"safe","edits":[{{"content":"a"}},{{"content":"b"}}]}}' ELSE 'null' END, '}}]')
 WHEN 'click' THEN concat('[{{"filePath":"/r/src/a', CAST(event_id % 6 AS STRING), '.js","messages":[{{"severity":2,"line":', CAST(event_id % 90 AS STRING), ',"message":"bad","ruleId":"no-x"}},{{"severity":1,"line":1,"message":"meh","ruleId":"no-y"}}]}}]')
 WHEN 'view' THEN concat('web/parcel', CAST(event_id % 6 AS STRING), '.ts(', CAST(event_id % 90 AS STRING), ',3): ', CASE WHEN event_id % 4 = 0 THEN 'warning' ELSE 'error' END, ' TS2345: Argument ', CAST(user_id AS STRING), {_NL}, 'noise line')
 ELSE concat('src/m', CAST(event_id % 6 AS STRING), '.py:', CAST(event_id % 90 AS STRING), ':5: undefined name x', CAST(user_id AS STRING), {_NL}, 'no colons here') END AS report_text FROM events""",
    "env_blocks": f"""
SELECT c_custkey AS req_id, concat('# comment', {_NL}, 'API_KEY="k', CAST(c_custkey AS STRING), '"', {_NL}, {_NL}, CASE WHEN c_custkey % 10 = 0 THEN '9BAD=1' ELSE 'REGION = eu=west' END) AS env_text FROM customer""",
    "stock": """
SELECT p_partkey AS sku, CAST(p_size * 20 AS BIGINT) AS available_qty, p_retailprice AS unit_cost FROM part""",
    "stock_requests": """
SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey + CASE WHEN l_orderkey % 50 = 0 THEN 1000000 ELSE 0 END AS sku, CAST(l_quantity AS BIGINT) AS qty, l_shipdate AS ts, l_suppkey, l_extendedprice FROM lineitem""",
    "change_log": """
SELECT o_orderkey AS ord, o_custkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'insert' ELSE 'update' END AS op,
 CASE WHEN o_orderkey % 5 <> 3 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 5 <> 4 THEN o_totalprice END AS amount, o_orderdate AS ts FROM orders""",
    # pieces of source files in three languages, one per symbol; files are joined in ord order
    "source_parts": f"""
SELECT repo_id, file_path, ord, name, is_test, symbol_id,
 CASE WHEN symbol_type = 'class' THEN concat('class C_', CAST(ord AS STRING), ':', {_NL}, '    {_DOC}Text that holds', {_NL}, '    def ghost(x):', {_NL}, {_NL}, 'and more', {_NL}, '    {_DOC}', {_NL}, '    def m_', CAST(ord AS STRING), '(self):', {_NL}, '        return self.fn_', CAST(ord * 3 % 200 AS STRING), '(', {_NL}, 'helper(x))', {_NL}, {_NL}, '    def n(self):', {_NL}, '        pass')
  ELSE concat(CASE WHEN ord % 3 = 0 THEN 'async def ' ELSE 'def ' END, name, '(x):', {_NL}, '    y = fn_', CAST((ord * 7 + 13) % 200 AS STRING), '(run(x))  # def late(', {_NL}, '    def inner_', CAST(ord % 4 AS STRING), '():', {_NL}, '        return deep(y)', {_NL}, {_NL}, '    return wrap (y)') END AS py_text,
 concat('import os, json as j; import sys', {_NL}, 'from pkg_', CAST(ord % 5 AS STRING), ' import alpha, ', chr(92), {_NL}, '    beta as b', {_NL}, 'from wide_', CAST(ord % 5 AS STRING), ' import (  # see f()', {_NL}, '    gamma,  # one, two', {_NL}, '    delta as d,', {_NL}, ')') AS py_head,
 CASE WHEN is_test THEN concat('it(', CASE WHEN ord % 3 = 0 THEN concat({_NL}, '  ') ELSE '' END, chr(39), 'case ', CAST(ord AS STRING), chr(39), ', () => {{', {_NL}, '  expect(run(1));', {_NL}, '}});')
  WHEN ord % 2 = 0 THEN concat('export const ', name, ' = async (', CASE WHEN ord % 4 = 0 THEN concat({_NL}, '  x,', {_NL}, '  y', {_NL}) ELSE 'x' END, ') => {{', {_NL}, '  return helper_', CAST(ord % 9 AS STRING), '(run(x));', {_NL}, '}};', {_NL})
  ELSE concat('export async function ', name, '(x) {{', {_NL}, '  if (x) {{ run(x); }}', {_NL}, '  return helper_', CAST(ord % 9 AS STRING), '(x);', {_NL}, '}}') END AS js_text,
 concat('import a from ', chr(39), './a_', CAST(ord % 5 AS STRING), chr(39), ';', {_NL}, 'import {{', {_NL}, '  first,', {_NL}, '  second', {_NL}, '}} from ', chr(39), './wide_', CAST(ord % 5 AS STRING), chr(39), ';', {_NL}, 'const b = require("lib_', CAST(ord % 3 AS STRING), '");') AS js_head,
 CASE WHEN is_test THEN concat('TEST(Suite', CAST(ord % 3 AS STRING), ', Case', CAST(ord AS STRING), ')', {_NL}, '{{', {_NL}, '  run(1);', {_NL}, '}}')
  ELSE concat('static int Svc::', name, '(int x) {{', {_NL}, '  if (x) {{', {_NL}, '    run(x);', {_NL}, '  }}', {_NL}, '  return helper_', CAST(ord % 9 AS STRING), '(x);', {_NL}, '}}', {_NL}) END AS cpp_text FROM symbols""",
}


class Tables:
    """Reads base tables and derived views of one data folder; nothing is registered globally."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.steps: dict[str, DataFrame] = {}  # written steps that several parts of a query read

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return self.spark.sql(self._expand(VIEWS[name]))

    def _expand(self, text: str) -> str:
        def source(match: re.Match) -> str:
            name = match.group(1)
            if name in VIEWS:
                return f"FROM ({self._expand(VIEWS[name])})"
            if name not in TABLES:
                return match.group(0)
            return f"FROM parquet.`{self.folder}/{name}.parquet`"

        return re.sub(r"\bFROM ([a-z_]+)\b", source, text)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)
