"""Symbol graph queries."""

from pyspark.sql import functions as F

from cilens import rules
from cilens.functions import text as X
from cilens.operators import graph as G
from cilens.plans.registry import cte, query
from cilens.plans.source import code_refs, code_symbols

cte("d_edges", """
SELECT DISTINCT c.repo_id, c.ord AS src, t.ord AS dst, c.is_test AS src_test, t.is_test AS dst_test, c.symbol_id AS src_id, t.symbol_id AS dst_id,
 CASE WHEN c.is_test THEN 'tests' ELSE 'calls' END AS relation
FROM code_refs r JOIN code_symbols c ON r.ord = c.ord JOIN code_symbols t ON t.repo_id = c.repo_id AND t.name = r.callee_name AND t.ord <> c.ord""")
cte("d_links", """
SELECT src AS node, dst AS other, dst_id AS other_id, dst_test AS other_test, 'callee' AS side FROM d_edges
UNION ALL SELECT dst, src, src_id, src_test, 'caller' FROM d_edges""")


def edges(t):
    return G.call_edges(code_symbols(t), code_refs(t))


def _ids(t, name):
    return code_symbols(t).select(F.col("ord").alias(name), F.col("symbol_id").alias(f"{name}_id"))


@query("w1_keep_first_symbol", """
SELECT repo_id, key, min(ord) AS ord, arg_min(symbol_id, ord) AS symbol_id, count(*) AS definitions FROM (SELECT *, file_path || '::' || name AS key FROM code_symbols) GROUP BY repo_id, key""")
def keep_first_symbol(t):
    keyed = code_symbols(t).withColumn("key", F.concat("file_path", F.lit("::"), "name"))
    first = G.keep_first(keyed.select("repo_id", "key", "ord", "symbol_id"), ["repo_id", "key"])
    counts = keyed.groupBy("repo_id", "key").agg(F.count(F.lit(1)).alias("definitions"))
    return first.join(counts, ["repo_id", "key"]).select("repo_id", "key", "ord", "symbol_id", "definitions")


@query("j1_call_edges", "SELECT repo_id, src_id, dst_id, relation FROM d_edges")
def call_edges(t):
    return edges(t).join(_ids(t, "src"), "src").join(_ids(t, "dst"), "dst").select("repo_id", "src_id", "dst_id", "relation")


@query("j2_callers_and_callees", "SELECT node, side, other FROM d_links")
def callers_and_callees(t):
    return G.neighbours(edges(t)).select("node", "side", "other")


@query("j3_tests_of_symbol", "SELECT dst_id AS symbol_id, src_id AS test_id FROM d_edges WHERE src_test")
def tests_of_symbol(t):
    return (edges(t).where("src_test").join(_ids(t, "src"), "src").join(_ids(t, "dst"), "dst")
            .select(F.col("dst_id").alias("symbol_id"), F.col("src_id").alias("test_id")))


@query("j4_targeted_tests", """
WITH p AS (SELECT patch_id, 'repo_' || CAST(CAST(floor(patch_id / 400) AS BIGINT) AS VARCHAR) AS repo_id, regexp_extract(target_file, '[^/]*$') AS base, 'fn_' || CAST(patch_id % 200 AS VARCHAR) AS failing_test FROM patches),
hits AS (SELECT p.patch_id, s2.name AS test_name, min({'a': e.dst, 'b': e.src}) AS place FROM p JOIN code_symbols s ON s.repo_id = p.repo_id AND NOT s.is_test AND regexp_extract(s.file_path, '[^/]*$') = p.base
  JOIN d_edges e ON e.dst = s.ord AND e.src_test JOIN code_symbols s2 ON s2.ord = e.src WHERE s2.name <> p.failing_test GROUP BY ALL)
SELECT patch_id, test_name, CAST(1 + row_number() OVER (PARTITION BY patch_id ORDER BY place) AS BIGINT) AS position FROM hits
UNION ALL SELECT patch_id, failing_test, 1 FROM p""")
def targeted_tests(t):
    patches = t.patches.select(
        "patch_id", F.concat(F.lit("repo_"), F.floor(F.col("patch_id") / 400).cast("string")).alias("repo_id"), "target_file",
        F.concat(F.lit("fn_"), (F.col("patch_id") % 200).cast("string")).alias("failing_test"))
    return G.targeted_tests(patches, code_symbols(t), edges(t))


@query("p1_graph_export", """
SELECT 'node' AS kind, symbol_id AS a, coalesce(name, symbol_id) AS b, coalesce(symbol_type, 'function') AS c, coalesce(file_path, '') AS d, coalesce(is_test, false) AS is_test FROM code_symbols
UNION ALL SELECT 'edge', src_id, dst_id, coalesce(relation, 'calls'), '', false FROM d_edges""")
def graph_export(t):
    nodes = code_symbols(t).select(F.lit("node").alias("kind"), F.col("symbol_id").alias("a"), F.coalesce("name", "symbol_id").alias("b"),
                             F.coalesce("symbol_type", F.lit("function")).alias("c"), F.coalesce("file_path", F.lit("")).alias("d"),
                             F.coalesce("is_test", F.lit(False)).alias("is_test"))
    links = call_edges(t).select(F.lit("edge").alias("kind"), F.col("src_id").alias("a"), F.col("dst_id").alias("b"),
                                 F.coalesce("relation", F.lit("calls")).alias("c"), F.lit("").alias("d"), F.lit(False).alias("is_test"))
    return nodes.unionByName(links)


@query("p8_graph_view", """
WITH v AS (SELECT * FROM code_symbols WHERE NOT is_test AND (contains(lower(name), 'mod_1') OR contains(lower(file_path), 'mod_1')))
SELECT 'node' AS kind, symbol_id AS a, '' AS b FROM v UNION ALL
SELECT 'edge', src_id, dst_id FROM d_edges WHERE src IN (SELECT ord FROM v) AND dst IN (SELECT ord FROM v)""")
def graph_view(t):
    shown = G.view_nodes(code_symbols(t), "functions", "MOD_1")
    links = G.induced(edges(t), shown).join(_ids(t, "src"), "src").join(_ids(t, "dst"), "dst")
    return (shown.select(F.lit("node").alias("kind"), F.col("symbol_id").alias("a"), F.lit("").alias("b"))
            .unionByName(links.select(F.lit("edge").alias("kind"), F.col("src_id").alias("a"), F.col("dst_id").alias("b"))))


@query("p17_repo_kind", r"""
SELECT repo_id, CASE WHEN bool_or(regexp_matches(lower(file_path), '\.(tsx?|jsx?)\b')) THEN 'TypeScript / JavaScript' WHEN bool_or(regexp_matches(lower(file_path), '\.(cpp|cc|cxx|hpp|h)\b')) THEN 'C++'
 WHEN bool_or(regexp_matches(lower(file_path), '\.py\b')) THEN 'Python' ELSE 'Mixed codebase' END AS label FROM code_symbols GROUP BY repo_id""")
def repo_kind(t):
    return G.repo_kind(code_symbols(t))


@query("a6_degree", """
SELECT symbol_id, count(*) FILTER (side = 'caller') AS incoming, count(*) FILTER (side = 'callee') AS outgoing FROM code_symbols LEFT JOIN d_links ON node = ord GROUP BY symbol_id, ord""")
def degree(t):
    return G.degrees(code_symbols(t), edges(t))


@query("a7_graph_size", "SELECT (SELECT count(*) FROM code_symbols) AS nodes, (SELECT count(*) FROM d_edges) AS edges")
def graph_size(t):
    nodes = code_symbols(t).agg(F.count(F.lit(1)).alias("nodes"), F.lit(0).cast("bigint").alias("edges"))
    links = edges(t).agg(F.lit(0).cast("bigint").alias("nodes"), F.count(F.lit(1)).alias("edges"))
    return nodes.unionByName(links).agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"))


@query("g1_bounded_reach", """
WITH RECURSIVE walk AS (SELECT ord AS start, ord AS node, 0 AS hop FROM code_symbols WHERE is_test
  UNION SELECT w.start, l.other, w.hop + 1 FROM walk w JOIN (SELECT DISTINCT node AS at, other FROM d_links) l ON l.at = w.node WHERE w.hop < 3)
SELECT start, node, CAST(min(hop) AS BIGINT) AS distance FROM walk JOIN code_symbols s ON s.ord = node WHERE NOT s.is_test GROUP BY start, node""")
def bounded_reach(t):
    """Starts are the test symbols, where every failure enters the graph."""
    found = G.reach(edges(t), code_symbols(t).where("is_test"))
    return found.join(code_symbols(t).where("not is_test").select(F.col("ord").alias("node")), "node", "left_semi")


@query("g2_neighbourhood", """
SELECT DISTINCT other AS ord FROM d_links JOIN code_symbols s ON s.ord = node AND s.is_test WHERE NOT other_test""")
def neighbourhood(t):
    """One hop around the set of all test symbols."""
    members = code_symbols(t).where("is_test").select(F.col("ord").alias("node"))
    return (G.neighbours(edges(t)).join(members, "node", "left_semi").where("not other_test")
            .select(F.col("other").alias("ord")).distinct())


@query("g3_induced_subgraph", """
SELECT src, dst FROM d_edges e JOIN code_symbols a ON a.ord = src AND a.symbol_type IN ('function','method') JOIN code_symbols b ON b.ord = dst AND b.symbol_type IN ('function','method')""")
def induced_subgraph(t):
    return G.induced(edges(t), code_symbols(t).where("symbol_type in ('function', 'method')")).select("src", "dst")


@query("f1_paths", r"""
SELECT ord, lower(replace(raw, chr(92), '/')) AS normalized, regexp_extract(lower(replace(raw, chr(92), '/')), '[^/]*$') AS base,
 CASE WHEN starts_with(replace(raw, chr(92), '/'), '/work/repo/') THEN substr(replace(raw, chr(92), '/'), 12) ELSE replace(raw, chr(92), '/') END AS relative
FROM (SELECT ord, CASE WHEN ord % 3 = 0 THEN '/work/repo/' || file_path WHEN ord % 3 = 1 THEN replace(file_path, '/', chr(92)) ELSE upper(file_path) END AS raw FROM code_symbols)""")
def paths(t):
    raw = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("/work/repo/"), "file_path")).when(
        F.col("ord") % 3 == 1, F.replace("file_path", F.lit("/"), F.lit("\\"))).otherwise(F.upper("file_path"))
    root = F.lit("/work/repo/")
    flat = X.slashes(F.col("raw"))
    return code_symbols(t).select("ord", raw.alias("raw")).select(
        "ord", X.norm_path(F.col("raw")).alias("normalized"), X.basename(X.norm_path(F.col("raw"))).alias("base"),
        F.when(F.startswith(flat, root), F.substr(flat, F.length(root) + 1)).otherwise(flat).alias("relative"))


@query("f3_qualified_id", "SELECT ord, file_path || '::Svc' || CAST(ord % 3 AS VARCHAR) || '.' || name AS qualified FROM code_symbols")
def qualified_id(t):
    return code_symbols(t).select("ord", F.concat("file_path", F.lit("::Svc"), (F.col("ord") % 3).cast("string"), F.lit("."), "name").alias("qualified"))


@query("p4_test_path", """
SELECT ord, path, starts_with(b, 'test_') OR ends_with(b, '_test.py') OR contains(lower(path), '/tests/') OR starts_with(lower(path), 'tests/') AS python_test,
 contains(b, '.test.') OR contains(b, '.spec.') OR contains(lower(path), '__tests__/') AS script_test,
 starts_with(b, 'test_') OR ends_with(b, '_test.py') OR contains(b, '.test.') OR contains(b, '.spec.') OR contains(lower(path), '/tests/') OR contains(lower(path), '/__tests__/') AS any_test
FROM (SELECT *, regexp_extract(lower(path), '[^/]*$') AS b FROM (SELECT ord, CASE ord % 4 WHEN 0 THEN file_path WHEN 1 THEN replace(file_path, '.py', '.spec.ts') WHEN 2 THEN 'pkg/__tests__/' || file_path ELSE replace(file_path, '.py', '_test.py') END AS path FROM code_symbols))""")
def test_path(t):
    n = F.col("ord") % 4
    path = (F.when(n == 0, F.col("file_path")).when(n == 1, F.replace("file_path", F.lit(".py"), F.lit(".spec.ts")))
            .when(n == 2, F.concat(F.lit("pkg/__tests__/"), "file_path")).otherwise(F.replace("file_path", F.lit(".py"), F.lit("_test.py"))))
    p = F.col("path")
    return code_symbols(t).select("ord", path.alias("path")).select(
        "ord", "path", X.python_test_path(p).alias("python_test"), X.js_test_path(p).alias("script_test"), X.any_test_path(p).alias("any_test"))


