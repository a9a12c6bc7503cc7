"""Root-cause localization queries."""

from pyspark.sql import functions as F

from cilens import rules
from cilens.functions import text as X
from cilens.operators import graph as G, localize as Z, logs as L
from cilens.plans.graph import edges
from cilens.plans.registry import cte, query
from cilens.plans.source import code_symbols
from cilens.session import cut_lineage, shared

cte("d_frames", """
SELECT log_id, frame_no, file_path, line_number FROM f_frames UNION ALL SELECT log_id, frame_no, file_path, line_number FROM f_js_frames
UNION ALL SELECT log_id, 1, failing_file, failing_line FROM f_cpp WHERE failing_file <> ''""")
cte("d_frames_repo", "SELECT f.*, r.repo_id, count(*) OVER (PARTITION BY log_id) AS n FROM d_frames f JOIN run_logs r USING (log_id)")
cte("d_reported", """
SELECT DISTINCT repo_id, file_path AS path FROM d_frames_repo UNION SELECT DISTINCT repo_id, failing_file FROM d_failures WHERE failing_file <> ''""")
cte("d_path_pairs", """
SELECT s.repo_id, s.file_path AS symbol_path, r.path AS reported_path
FROM (SELECT DISTINCT repo_id, file_path FROM code_symbols) s JOIN d_reported r ON s.repo_id = r.repo_id
 AND (ends_with(lower(s.file_path), lower(r.path)) OR ends_with(lower(r.path), lower(s.file_path)) OR regexp_extract(lower(s.file_path), '[^/]*$') = regexp_extract(lower(r.path), '[^/]*$'))""")
cte("d_sites", """
SELECT DISTINCT repo_id, failing_file AS path, failing_line AS line FROM d_failures WHERE failing_file <> '' AND failing_line > 0
UNION SELECT DISTINCT repo_id, file_path, line_number FROM d_frames_repo""")
cte("d_at", """
SELECT repo_id, path, line, arg_min(ord, {'a': end_line - start_line, 'b': ord}) AS ord FROM d_sites x JOIN d_path_pairs p USING (repo_id) JOIN code_symbols s USING (repo_id)
WHERE p.reported_path = x.path AND s.file_path = p.symbol_path AND line BETWEEN start_line AND end_line GROUP BY ALL""")
cte("d_words", r"""
SELECT DISTINCT log_id, repo_id, w AS word FROM (SELECT log_id, unnest(regexp_extract_all(line, '[\p{L}\p{N}_]+')) AS w FROM d_first_lines WHERE language = 'python'
 UNION ALL SELECT log_id, unnest(regexp_extract_all(line, '[\p{L}\p{N}_]+')) FROM d_js_first
 UNION ALL SELECT log_id, unnest(regexp_extract_all(log_text, '[\p{L}\p{N}_]+')) FROM d_lang WHERE language = 'cpp') JOIN run_logs USING (log_id)""")
cte("d_direct", """
SELECT f.log_id, a.ord, 100 AS points, 0 AS g, 0 AS k, 'encloses the error site ' || failing_file || ':' || CAST(failing_line AS VARCHAR) AS reason
 FROM d_failures f JOIN d_at a ON a.repo_id = f.repo_id AND a.path = failing_file AND a.line = failing_line AND failing_line > 0
UNION ALL SELECT f.log_id, a.ord, 30 + CAST(floor(20 * ((frame_no - 1) / greatest(n - 1, 1))) AS INT), 1, frame_no - 1, 'appears in the traceback at ' || f.file_path || ':' || CAST(line_number AS VARCHAR)
 FROM d_frames_repo f JOIN d_failures d ON d.log_id = f.log_id JOIN d_at a ON a.repo_id = f.repo_id AND a.path = f.file_path AND a.line = line_number JOIN code_symbols s ON s.ord = a.ord AND NOT s.is_test
UNION ALL SELECT w.log_id, s.ord, 25, 2, s.ord, 'named in the traceback' FROM d_words w JOIN code_symbols s ON s.repo_id = w.repo_id AND s.name = w.word AND NOT s.is_test AND length(s.name) >= 3 WHERE w.log_id IN (SELECT log_id FROM d_failures)
UNION ALL SELECT f.log_id, s.ord, 15, 3, s.ord, 'defined in the failing file' FROM d_failures f JOIN d_path_pairs p ON p.repo_id = f.repo_id AND p.reported_path = failing_file JOIN code_symbols s ON s.repo_id = f.repo_id AND s.file_path = p.symbol_path AND NOT s.is_test""")
cte("d_seeds", """
SELECT log_id, ord, sum(points) AS points, min({'g': g, 'k': k}) AS place, string_agg(reason, '; ' ORDER BY g, k, reason) AS reasons FROM d_direct GROUP BY log_id, ord""")
cte("d_spread", """
SELECT s.log_id, l.other AS ord, arg_min(y.name, s.place) AS via FROM d_seeds s JOIN (SELECT DISTINCT node, other FROM d_links WHERE NOT other_test) l ON l.node = s.ord JOIN code_symbols y ON y.ord = s.ord
WHERE NOT EXISTS (SELECT 1 FROM d_seeds z WHERE z.log_id = s.log_id AND z.ord = l.other) GROUP BY ALL""")
cte("d_scored", """
SELECT log_id AS failure_id, ord, symbol_id, name, file_path, CAST(points + CASE WHEN symbol_type IN ('function', 'method') THEN 5 ELSE 0 END AS BIGINT) AS score,
 reasons || CASE WHEN symbol_type IN ('function', 'method') THEN '; is an executable function or method' ELSE '' END AS evidence
FROM (SELECT log_id, ord, points, reasons FROM d_seeds UNION ALL SELECT log_id, ord, 10, 'adjacent in the call graph to ' || via FROM d_spread) JOIN code_symbols USING (ord) WHERE NOT is_test""")
cte("d_pool", """
SELECT *, row_number() OVER (PARTITION BY failure_id ORDER BY score DESC, file_path, name, symbol_id) AS rank FROM d_scored QUALIFY rank <= 15""")
# model answers: the pool reversed for even failures plus one unknown id; one in five of those is cut off
cte("d_rankings", """
SELECT failure_id, symbol_id, row_number() OVER (PARTITION BY failure_id ORDER BY rank DESC) AS rank FROM d_pool WHERE failure_id % 2 = 0 AND failure_id % 10 <> 4
UNION ALL SELECT DISTINCT failure_id, 'unknown::symbol', 0 FROM d_pool WHERE failure_id % 2 = 0 AND failure_id % 10 <> 4""")


def failures(t):
    """Parsed once and written: everything below reads these rows several times."""
    found = L.first_failures(t.run_logs.drop("ts", "event_type")).withColumnRenamed("log_id", "failure_id")
    return shared(found.drop("log_text", "reject_reason"))


def scored(t, found=None, top=None, explain=False):
    return Z.score(failures(t) if found is None else found, code_symbols(t), edges(t), top, explain)


def ranked(t, size, found=None):
    """The best candidates by number; no evidence is put together for those that are not kept."""
    return Z.pool(scored(t, found, size), size)


def reported(f):
    return Z.sites_of(f).select("repo_id", "path").unionByName(
        f.where("failing_file <> ''").select("repo_id", F.col("failing_file").alias("path"))).distinct()


@query("p3_failure_in_repo", """
WITH c AS (SELECT log_id AS failure_id, failing_file AS p FROM d_failures UNION ALL SELECT log_id, file_path FROM d_frames JOIN d_failures USING (log_id)),
ok AS (SELECT failure_id, p, list_has_any(string_split(regexp_replace(split_part(p, ':', 1), '^(\\./)+', ''), '/'), ['.git','__pycache__','node_modules','.venv','venv','dist','build','.pytest_cache','.mypy_cache','chroma_db','coverage']) AS skip FROM c WHERE p <> '')
SELECT d.log_id AS failure_id, coalesce(bool_or(NOT skip AND (NOT starts_with(p, '/') OR starts_with(p, '/work/repo/'))), false) AS in_repo FROM d_failures d LEFT JOIN ok ON ok.failure_id = d.log_id GROUP BY ALL""")
def failure_in_repo(t):
    paths = F.concat(F.array("failing_file"), F.transform("frames", lambda f: f["file_path"]))

    def own(path):
        absolute = F.startswith(path, F.lit("/"))
        seen = F.when(absolute, path).otherwise(F.substring_index(path, ":", 1))
        return (path != "") & ~X.vendored(seen) & (~absolute | F.startswith(path, F.lit("/work/repo/")))

    return failures(t).select("failure_id", F.exists(paths, own).alias("in_repo"))


@query("j5_path_match", "SELECT * FROM d_path_pairs")
def path_match(t):
    return Z.path_pairs(code_symbols(t), reported(failures(t)))


@query("j6_innermost_symbol", "SELECT repo_id, path, line, symbol_id FROM d_at JOIN code_symbols USING (repo_id, ord)")
def innermost_symbol(t):
    f = failures(t)
    return Z.innermost(Z.symbols_by_path(code_symbols(t), reported(f)), Z.sites_of(f)).select("repo_id", "path", "line", "symbol_id")


@query("g1_failure_reach", """
WITH RECURSIVE walk AS (SELECT ord AS start, ord AS node, 0 AS hop FROM (SELECT DISTINCT a.ord FROM d_failures f JOIN d_at a ON a.repo_id = f.repo_id AND a.path = failing_file AND a.line = failing_line AND failing_line > 0)
  UNION SELECT w.start, l.other, w.hop + 1 FROM walk w JOIN (SELECT DISTINCT node AS at, other FROM d_links) l ON l.at = w.node WHERE w.hop < 3)
SELECT node, distance, count(*) AS starts FROM (SELECT start, node, CAST(min(hop) AS BIGINT) AS distance FROM walk GROUP BY start, node) GROUP BY node, distance""")
def failure_reach(t):
    """How many failing symbols lie at each distance of a symbol; the innermost symbol at a failing line is a failing one."""
    f = failures(t)
    at = f.where("failing_file <> '' AND failing_line > 0").select("repo_id", F.col("failing_file").alias("path"), F.col("failing_line").alias("line"))
    failing = Z.innermost(Z.symbols_by_path(code_symbols(t), at.select("repo_id", "path").distinct()), at)
    sets = G.reach_sets(edges(t), cut_lineage(G.number_starts(failing)))
    return sets.groupBy("node", "distance").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("starts"))


@query("j7_first_symbol", """
SELECT repo_id, path, line, arg_min(symbol_id, {'a': CASE WHEN ends_with(lower(symbol_path), lower(path)) OR ends_with(lower(path), lower(symbol_path)) THEN 0 ELSE 1 END, 'b': ord}) AS symbol_id
FROM d_sites x JOIN d_path_pairs p USING (repo_id) JOIN code_symbols s USING (repo_id)
WHERE p.reported_path = x.path AND s.file_path = p.symbol_path AND line BETWEEN start_line AND end_line GROUP BY ALL""")
def first_symbol(t):
    f = failures(t)
    return Z.first_enclosing(Z.symbols_by_path(code_symbols(t), reported(f)), Z.sites_of(f)).select("repo_id", "path", "line", "symbol_id")


@query("j8_named_in_traceback", """
SELECT log_id AS failure_id, s.ord FROM d_words w JOIN d_failures d USING (log_id) JOIN code_symbols s ON s.repo_id = w.repo_id AND s.name = w.word AND NOT s.is_test AND length(s.name) >= 3""")
def named_in_traceback(t):
    return Z.named_in_text(failures(t), code_symbols(t))


@query("a1_evidence_score", "SELECT failure_id, symbol_id, score, evidence FROM d_scored")
def evidence_score(t):
    return scored(t, explain=True).select("failure_id", "symbol_id", "score", F.array_join("evidence", "; ").alias("evidence"))


@query("w2_candidate_pool", "SELECT failure_id, symbol_id, score, rank FROM d_pool")
def candidate_pool(t):
    return ranked(t, rules.RANKING_POOL).select("failure_id", "symbol_id", "score", "rank")


def model_answers(pool):
    """Fenced JSON as a model would return it: the pool reversed, plus one id that does not exist."""
    items = F.array_sort(F.collect_list(F.struct((rules.RANKING_POOL - F.col("rank")).cast("int").alias("rank"), "symbol_id")))
    rows = pool.where("failure_id % 2 = 0").groupBy("failure_id").agg(items.alias("items"))
    ranked = F.transform("items", lambda x, i: F.struct(x["symbol_id"].alias("symbol_id"), (i + 1).alias("rank"), F.lit("seen in the traceback").alias("plausibility_reason")))
    unknown = F.array(F.struct(F.lit("unknown::symbol").alias("symbol_id"), F.lit(0).alias("rank"), F.lit("guess").alias("plausibility_reason")))
    body = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.concat(unknown, ranked).alias("rankings"))), F.lit("\n```"))
    return rows.select("failure_id", F.when(F.col("failure_id") % 10 == 4, F.left(body, F.lit(30))).otherwise(body).alias("answer"))


@query("w2_suspects", "SELECT failure_id, symbol_id, rank FROM d_pool WHERE rank <= 5")
def carried_suspects(t):
    """The suspects carried forward when no model ranks them."""
    return ranked(t, rules.MAX_SUSPECTS).select("failure_id", "symbol_id", "rank")


@query("s14_model_answers", """
SELECT failure_id, symbol_id, rank, false AS rejected FROM d_rankings
UNION ALL SELECT DISTINCT failure_id, CAST(NULL AS VARCHAR), -1, true FROM d_pool WHERE failure_id % 10 = 4""")
def answers(t):
    from cilens.sources.responses import read_rankings, rejected_answers

    texts = cut_lineage(model_answers(ranked(t, rules.RANKING_POOL)))
    return (read_rankings(texts).select("failure_id", "symbol_id", "rank", F.lit(False).alias("rejected"))
            .unionByName(rejected_answers(texts).select(
                "failure_id", F.lit(None).cast("string").alias("symbol_id"), F.lit(-1).cast("bigint").alias("rank"), F.lit(True).alias("rejected"))))


@query("j9_merge_model_ranking", """
WITH k AS (SELECT r.failure_id, r.symbol_id, row_number() OVER (PARTITION BY r.failure_id ORDER BY r.rank, r.symbol_id) AS rank FROM d_rankings r JOIN d_pool p USING (failure_id, symbol_id))
SELECT failure_id, symbol_id, rank, 'llm' AS ranking_source FROM k WHERE rank <= 5
UNION ALL SELECT failure_id, symbol_id, rank, 'static' FROM d_pool WHERE rank <= 5 AND failure_id NOT IN (SELECT failure_id FROM k)""")
def merge_model_ranking(t):
    from cilens.sources.responses import read_rankings

    pool = shared(ranked(t, rules.RANKING_POOL))
    return Z.merge_rankings(pool, read_rankings(model_answers(pool))).select("failure_id", "symbol_id", "rank", "ranking_source")


@query("j10_unlocalized", """
SELECT log_id AS failure_id, 'no application symbol could be linked to the failure' AS reason FROM d_failures WHERE log_id NOT IN (SELECT failure_id FROM d_scored)""")
def unlocalized(t):
    f = failures(t)
    return Z.unlocalized(f, scored(t, f, top=1)).select(
        "failure_id", F.lit("no application symbol could be linked to the failure").alias("reason"))
