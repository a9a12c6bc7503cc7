"""Source text queries."""

from pyspark.sql import functions as F

from cilens import rules
from cilens.operators import graph as G, source as S
from cilens.plans.registry import cte, query
from cilens.session import shared, spread

#: Lines that a file may have before two files' symbols would share a number.
FILE_LINES = 1_000_000


def files(t, kind):
    """Whole files put together from their parts, with a head line block; a file has few parts. ``file_no`` numbers them.

    They are written once per query, as a tree of files would be there already, and read by enough tasks.
    """
    if f"{kind}_files" in t.steps:
        return t.steps[f"{kind}_files"]
    suffix = {"py": ".py", "js": ".ts", "cpp": ".cpp"}[kind]
    head = "''" if kind == "cpp" else f"min_by({kind}_head, ord)"
    whole = t.source_parts.groupBy("repo_id", F.concat(F.regexp_replace("file_path", r"\.py$", ""), F.lit(suffix)).alias("file_path")).agg(
        F.min("ord").alias("file_no"),
        F.concat(F.expr(head), F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", f"{kind}_text"))), lambda x: x[f"{kind}_text"]), "\n")).alias("content"))
    t.steps[f"{kind}_files"] = spread(shared(whole))
    return t.steps[f"{kind}_files"]


def code_symbols(t):
    """The symbols found in the source files, the first of each id, numbered by file and line; read once per query."""
    if "code" not in t.steps:
        source = files(t, "py")
        found = S.python_symbols(source).join(source.select("repo_id", "file_path", "file_no"), ["repo_id", "file_path"])
        found = found.withColumn("ord", F.col("file_no") * FILE_LINES + F.col("start_line"))
        columns = ["name", "symbol_type", "file_path", "start_line", "end_line", "is_test", "calls", "code"]
        t.steps["code"] = shared(G.keep_first(found.select("repo_id", "symbol_id", "ord", *columns), ["repo_id", "symbol_id"]))
    return t.steps["code"]


def code_refs(t):
    """(ord, callee_name): the names that each symbol's source calls."""
    return code_symbols(t).select("ord", F.explode("calls").alias("callee_name"))


def _q(text):
    return "'" + text.replace("'", "''") + "'"


for _kind, _suffix in (("py", ".py"), ("js", ".ts"), ("cpp", ".cpp")):
    _head = "''" if _kind == "cpp" else f"arg_min({_kind}_head, ord)"
    cte(f"d_{_kind}_files", f"SELECT repo_id, regexp_replace(file_path, '\\.py$', '') || '{_suffix}' AS file_path, min(ord) AS file_no, {_head} || chr(10) || string_agg({_kind}_text, chr(10) ORDER BY ord) AS content FROM source_parts GROUP BY repo_id, file_path")
    cte(f"d_{_kind}_lines", f"SELECT repo_id, file_path, unnest(arr) AS line, generate_subscripts(arr, 1) AS pos FROM (SELECT *, string_split(content, chr(10)) AS arr FROM d_{_kind}_files)")

# python: strings and comments are cut out of the whole file, ends of lines inside them become chr(31); lines that start
# inside brackets go on; block ends and scopes come from joining definition lines with lines
_LEX = r"""(?s)#[^\n]*|\\\n|\"\"\"(?:[^"\\]|\\.|"[^"\\]|""[^"\\])*\"\"\"|'''(?:[^'\\]|\\.|'[^'\\]|''[^'\\])*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""".replace(r'\"', '"')
cte("d_py_pieces", f"SELECT repo_id, file_path, file_no, regexp_split_to_array(content, {_q(_LEX)}) AS ps, regexp_extract_all(content, {_q(_LEX)}) AS ts FROM d_py_files")
cte("d_py_code", """
SELECT repo_id, file_path, file_no, string_agg(p || k, '' ORDER BY i) AS code FROM (SELECT repo_id, file_path, file_no, unnest(ps) AS p, generate_subscripts(ps, 1) AS i,
  unnest(list_concat(list_transform(ts, lambda x: CASE WHEN x[1] = '#' THEN '' WHEN x[1] = chr(92) THEN chr(31) ELSE '"' || repeat(chr(31), length(x) - length(replace(x, chr(10), ''))) || '"' END), [''])) AS k FROM d_py_pieces) GROUP BY ALL""")
cte("d_py_parts", "SELECT repo_id, file_path, file_no, replace(l, chr(31), ' ') AS line, length(l) - length(replace(l, chr(31), '')) AS more, i, length(regexp_replace(l, '[^(\\[{]', '', 'g')) - length(regexp_replace(l, '[^)\\]}]', '', 'g')) AS up FROM (SELECT repo_id, file_path, file_no, unnest(string_split(code, chr(10))) AS l, generate_subscripts(string_split(code, chr(10)), 1) AS i FROM d_py_code)")
cte("d_py_text", f"""
SELECT *, length(regexp_extract(line, '^(\\s*)', 1)) AS indent, CASE WHEN starts THEN regexp_extract(line, {_q(rules.PY_DEF)}, 2) ELSE '' END AS kind, regexp_extract(line, {_q(rules.PY_DEF)}, 3) AS name FROM (
 SELECT repo_id, file_path, file_no, line, i + coalesce(sum(more) OVER before, 0) AS pos, i + coalesce(sum(more) OVER before, 0) + more AS last, coalesce(sum(up) OVER before, 0) = 0 AS starts
 FROM d_py_parts WINDOW before AS (PARTITION BY repo_id, file_path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE trim(line) <> ''""")
cte("d_py_stops", """
SELECT d.repo_id, d.file_path, d.file_no, d.pos, d.indent, d.kind, d.name, min(n.pos) AS stop FROM d_py_text d LEFT JOIN d_py_text n ON n.repo_id = d.repo_id AND n.file_path = d.file_path AND n.pos > d.pos AND n.starts AND n.indent <= d.indent WHERE d.kind <> '' GROUP BY ALL""")
cte("d_py_blocks", """
SELECT s.repo_id, s.file_path, s.file_no, s.pos, s.indent, s.kind, s.name, max(n.last) AS end_pos FROM d_py_stops s JOIN d_py_text n ON n.repo_id = s.repo_id AND n.file_path = s.file_path AND n.pos >= s.pos AND (s.stop IS NULL OR n.pos < s.stop) GROUP BY ALL""")
cte("d_py_called", f"""
SELECT repo_id, file_path, pos, list_sort(list(DISTINCT c)) AS calls FROM (
 SELECT b.repo_id, b.file_path, b.pos, unnest(regexp_extract_all(CASE WHEN l.pos = b.pos THEN regexp_replace(l.line, {_q(rules.PY_DEF)}, '') ELSE l.line END, {_q(rules.CPP_CALL)}, 1)) AS c
 FROM d_py_blocks b JOIN d_py_text l ON l.repo_id = b.repo_id AND l.file_path = b.file_path AND l.pos >= b.pos AND l.pos <= b.end_pos
 WHERE b.kind <> 'class' AND NOT EXISTS (SELECT 1 FROM d_py_blocks o WHERE o.repo_id = b.repo_id AND o.file_path = b.file_path AND o.pos > b.pos AND o.pos <= b.end_pos AND l.pos BETWEEN o.pos AND o.end_pos))
WHERE c NOT IN ({', '.join(_q(w) for w in rules.PY_CALL_SKIP)}) GROUP BY ALL""")
cte("d_py_scopes", """
SELECT b.repo_id, b.file_path, b.pos, string_agg(o.name, '.' ORDER BY o.pos) AS scope FROM d_py_blocks b JOIN d_py_blocks o ON o.repo_id = b.repo_id AND o.file_path = b.file_path AND o.pos < b.pos AND o.end_pos >= b.pos AND o.indent < b.indent GROUP BY ALL""")
_PY_TEST = "(starts_with(regexp_extract(file_path, '[^/]*$'), 'test_') OR ends_with(file_path, '_test.py') OR starts_with(name, 'test_') OR starts_with(name, 'Test'))"
cte("d_py_symbols", f"""
SELECT repo_id, file_path || '::' || CASE WHEN scope IS NULL THEN '' ELSE scope || '.' END || name AS symbol_id, CASE WHEN {_PY_TEST} THEN 'test' WHEN kind = 'class' THEN 'class' WHEN scope IS NOT NULL THEN 'method' ELSE 'function' END AS symbol_type,
 pos AS start_line, end_pos AS end_line, calls, {_PY_TEST} AS is_test, file_path, name, CAST(file_no * {FILE_LINES} + pos AS BIGINT) AS ord FROM d_py_blocks LEFT JOIN d_py_scopes USING (repo_id, file_path, pos) LEFT JOIN d_py_called USING (repo_id, file_path, pos)""")
cte("d_py_source", """
SELECT s.repo_id, s.ord, string_agg(l.line, chr(10) ORDER BY l.pos) AS code FROM d_py_symbols s JOIN d_py_lines l ON l.repo_id = s.repo_id AND l.file_path = s.file_path AND l.pos BETWEEN s.start_line AND s.end_line GROUP BY ALL""")
cte("code_symbols", "SELECT * FROM d_py_symbols QUALIFY row_number() OVER (PARTITION BY repo_id, symbol_id ORDER BY ord) = 1")
cte("code_refs", "SELECT ord, unnest(calls) AS callee_name FROM code_symbols")


def _flat(df):
    return df.select("repo_id", "symbol_id", "symbol_type", "start_line", "end_line", F.array_join("calls", ",").alias("calls"), "is_test")


@query("l23_python_symbols", "SELECT repo_id, symbol_id, symbol_type, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, coalesce(array_to_string(calls, ','), '') AS calls, is_test FROM d_py_symbols")
def python_symbols(t):
    return _flat(S.python_symbols(files(t, "py")))


@query("r1_chunk_table", "SELECT repo_id, symbol_id AS chunk_id, file_path, name, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, code FROM d_py_symbols JOIN d_py_source USING (repo_id, ord)")
def chunk_table(t):
    """One chunk per symbol found in the source, its text being the symbol's own lines."""
    return S.python_symbols(files(t, "py")).select("repo_id", F.col("symbol_id").alias("chunk_id"), "file_path", "name", "start_line", "end_line", "code")


cte("d_js_next", "SELECT *, lead(line) OVER w AS n1, lead(line, 2) OVER w AS n2, lead(line, 3) OVER w AS n3 FROM d_js_lines WINDOW w AS (PARTITION BY repo_id, file_path ORDER BY pos)")
# a head left open at its line's end is judged with the next lines put behind it
cte("d_js_whole", "SELECT repo_id, file_path, pos, CASE WHEN regexp_matches(line, '\\($') THEN concat_ws(' ', line, n1, n2, n3) ELSE line END AS line FROM d_js_next")
cte("d_js_heads", f"""
SELECT repo_id, file_path, pos, CASE WHEN regexp_matches(line, {_q(rules.JS_FUNCTION)}) THEN regexp_extract(line, {_q(rules.JS_FUNCTION)}, 1) WHEN regexp_matches(line, {_q(rules.JS_ARROW)}) THEN regexp_extract(line, {_q(rules.JS_ARROW)}, 1) ELSE regexp_extract(line, {_q(rules.JS_TEST_CALL)}, 1) END AS name,
 NOT regexp_matches(line, {_q(rules.JS_FUNCTION)}) AND NOT regexp_matches(line, {_q(rules.JS_ARROW)}) AS test FROM d_js_whole WHERE regexp_matches(line, {_q(rules.JS_FUNCTION)}) OR regexp_matches(line, {_q(rules.JS_ARROW)}) OR regexp_matches(line, {_q(rules.JS_TEST_CALL)})""")
cte("d_js_spans", """
SELECT h.repo_id, h.file_path, h.pos, h.name, h.test, max(l.pos) AS end_pos FROM (SELECT *, lead(pos) OVER (PARTITION BY repo_id, file_path ORDER BY pos) AS nxt FROM d_js_heads) h
JOIN d_js_lines l ON l.repo_id = h.repo_id AND l.file_path = h.file_path AND l.pos >= h.pos AND (nxt IS NULL OR l.pos < nxt) AND trim(l.line) <> '' GROUP BY ALL""")


def _call_sql(lines, spans, pattern, skip):
    return f"""SELECT s.repo_id, s.file_path, s.pos, string_agg(DISTINCT c, ',' ORDER BY c) FILTER (c NOT IN ({', '.join(_q(w) for w in skip)})) AS calls FROM (
 SELECT s.*, unnest(regexp_extract_all(l.line, {_q(pattern)}, 1)) AS c FROM {spans} s JOIN {lines} l ON l.repo_id = s.repo_id AND l.file_path = s.file_path AND l.pos BETWEEN s.pos AND s.end_pos) s GROUP BY ALL"""


@query("l23_script_symbols", f"""
SELECT repo_id, file_path || '::' || name AS symbol_id, CASE WHEN test THEN 'test' ELSE 'function' END AS symbol_type, pos AS start_line, end_pos AS end_line, coalesce(calls, '') AS calls, test AS is_test
FROM d_js_spans LEFT JOIN ({_call_sql('d_js_lines', 'd_js_spans', rules.JS_CALL, rules.JS_CALL_SKIP)}) USING (repo_id, file_path, pos)""")
def script_symbols(t):
    return _flat(S.script_symbols(files(t, "js")))


cte("d_cpp_depth", """
SELECT *, sum(length(line) - length(replace(line, '{', '')) - length(line) + length(replace(line, '}', ''))) OVER (PARTITION BY repo_id, file_path ORDER BY pos) AS depth, contains(line, '{') AS opener FROM d_cpp_lines""")
cte("d_cpp_heads", f"""
SELECT d.*, regexp_matches(line, {_q(rules.CPP_TEST_MACRO)}) AS test, depth - (length(line) - length(replace(line, '{{', '')) - length(line) + length(replace(line, '}}', ''))) AS base,
 CASE WHEN regexp_matches(line, {_q(rules.CPP_TEST_MACRO)}) THEN regexp_replace(regexp_extract(line, '\\((.*)\\)', 1), '\\s*,\\s*', '.') ELSE regexp_extract(regexp_extract(line, {_q(rules.CPP_FUNCTION)}, 1), '[^:]*$') END AS name
FROM d_cpp_depth d WHERE regexp_matches(line, {_q(rules.CPP_TEST_MACRO)}) OR regexp_matches(line, {_q(rules.CPP_FUNCTION)})""")
cte("d_cpp_opens", "SELECT h.repo_id, h.file_path, h.pos, h.name, h.test, h.base, min(l.pos) AS first_open FROM d_cpp_heads h LEFT JOIN d_cpp_depth l ON l.repo_id = h.repo_id AND l.file_path = h.file_path AND l.pos >= h.pos AND l.opener GROUP BY ALL")
cte("d_cpp_spans", "SELECT h.repo_id, h.file_path, h.pos, h.name, h.test, coalesce(min(l.pos), h.pos) AS end_pos FROM d_cpp_opens h LEFT JOIN d_cpp_depth l ON l.repo_id = h.repo_id AND l.file_path = h.file_path AND l.pos >= h.first_open AND l.depth <= h.base GROUP BY h.repo_id, h.file_path, h.pos, h.name, h.test")


@query("l23_cpp_symbols", f"""
SELECT repo_id, file_path || '::' || name AS symbol_id, CASE WHEN test OR starts_with(lower(name), 'test') THEN 'test' ELSE 'function' END AS symbol_type, pos AS start_line, end_pos AS end_line, coalesce(calls, '') AS calls, test OR starts_with(lower(name), 'test') AS is_test
FROM d_cpp_spans LEFT JOIN ({_call_sql('d_cpp_lines', 'd_cpp_spans', rules.CPP_CALL, rules.CPP_CALL_SKIP)}) USING (repo_id, file_path, pos)""")
def cpp_symbols(t):
    return _flat(S.cpp_symbols(files(t, "cpp")))


# a statement is a line of code and those that go on from it; its parts between semicolons are looked at one by one
cte("d_py_statements", """
SELECT repo_id, file_path, k, any_value(indent) FILTER (starts) AS indent, string_agg(line, ' ' ORDER BY pos) AS s
FROM (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY repo_id, file_path ORDER BY pos) AS k FROM d_py_text) GROUP BY repo_id, file_path, k""")
cte("d_py_imported", r"""
SELECT repo_id, file_path, regexp_extract(p, '^\s*from\s*\.*([\w.]*)', 1) AS module, unnest(string_split(regexp_replace(regexp_extract(p, '\bimport\b(.*)$', 1), '[()]', ' ', 'g'), ',')) AS n
FROM (SELECT repo_id, file_path, unnest(string_split(s, ';')) AS p FROM d_py_statements WHERE indent = 0) WHERE regexp_matches(p, '^\s*(import\s|from[\s.].*\bimport\b)')""")


@query("l24_imports", r"""
WITH p AS (SELECT repo_id, file_path, CASE WHEN module = '' THEN '' ELSE module || '.' END || regexp_extract(trim(n), '^\S+') AS m FROM d_py_imported WHERE trim(n) <> ''
 UNION ALL SELECT repo_id, file_path, regexp_extract(line, 'from ''([^'']+)''', 1) FROM d_js_lines WHERE regexp_matches(line, '^(import .*|\}) from ') UNION ALL SELECT repo_id, file_path, regexp_extract(line, 'require\("([^"]+)"', 1) FROM d_js_lines WHERE contains(line, 'require('))
SELECT repo_id, file_path, string_agg(DISTINCT m, ',' ORDER BY m) AS imports FROM p GROUP BY ALL""")
def imports(t):
    py = files(t, "py").select("repo_id", "file_path", S.python_imports(F.col("content")).alias("i"))
    js = files(t, "js").select("repo_id", "file_path", S.script_imports(F.col("content")).alias("i"))
    return py.unionByName(js).select("repo_id", "file_path", F.array_join("i", ",").alias("imports"))


# whole strings, then a quote that none of them ends, line ends and brackets, in order; brackets carry their line
_STRING = r"""'(?:[^'\\]|\\\n*[^\n])*'|"(?:[^"\\]|\\\n*[^\n])*"|`(?:[^`\\]|\\\n*[^\n])*`"""
cte("d_marks", f"""
SELECT page_id, i, x, 1 + coalesce(sum(length(x) - length(replace(x, chr(10), ''))) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line
FROM (SELECT page_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, {_q('(?s)' + _STRING + '|[' + chr(39) + '"`].*|[' + chr(92) + 'n()' + chr(92) + '[' + chr(92) + ']{}]')}) AS xs FROM pages))""")


@query("l25_bracket_balance", f"""
WITH RECURSIVE m AS (SELECT page_id, coalesce(string_agg(x || CAST(line AS VARCHAR) || ';', '' ORDER BY i) FILTER (x IN ('(', ')', '[', ']', '{{', '}}')), '') AS s,
  bool_or(regexp_matches(x, '^[''"`]') AND NOT regexp_full_match(x, {_q('(?s)' + _STRING)})) AS unended FROM d_marks GROUP BY page_id),
r AS (SELECT page_id, s, 0 AS k FROM m UNION ALL SELECT page_id, t, k + 1 FROM (SELECT page_id, k, s, regexp_replace(s, '\\([0-9]+;\\)[0-9]+;|\\[[0-9]+;\\][0-9]+;|\\{{[0-9]+;\\}}[0-9]+;', '', 'g') AS t FROM r) WHERE t <> s),
e AS (SELECT page_id, arg_max(s, k) AS s, regexp_extract(arg_max(s, k), '[)\\]}}][0-9]+') AS c FROM r GROUP BY page_id)
SELECT p.page_id, CASE WHEN c <> '' THEN 'unexpected ''' || c[1] || '''' WHEN unended THEN 'unterminated string' WHEN s <> '' THEN 'missing ''' || translate(regexp_extract(s, '([(\\[{{])[0-9]+;$', 1), '([{{', ')]}}') || '''' END AS message,
 CASE WHEN c <> '' THEN CAST(substr(c, 2) AS BIGINT) WHEN unended THEN CAST(length(rtrim(html, chr(10))) - length(replace(rtrim(html, chr(10)), chr(10), '')) + 1 AS BIGINT) WHEN s <> '' THEN CAST(regexp_extract(s, '([0-9]+);$', 1) AS BIGINT) END AS line
FROM pages p LEFT JOIN e USING (page_id) LEFT JOIN (SELECT page_id, unended FROM m) u USING (page_id)""")
def bracket_balance(t):
    """The first bracket fault of every page, read as a script, and its line."""
    rows = spread(t.pages.select("page_id", "html")).select("page_id", S.bracket_fault(F.col("html")).alias("b"))
    return rows.select("page_id", "b.message", "b.line")
