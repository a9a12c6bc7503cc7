"""Retrieval queries."""

from pyspark.sql import Window, functions as F

from cilens import rules
from cilens.functions import text as X
from cilens.operators import cells, retrieval as V
from cilens.plans.localize import failures, scored
from cilens.operators.localize import pool
from cilens.plans.registry import cte, query
from cilens.plans.source import code_symbols
from cilens.session import cut_lineage, shared

cte("d_old", "SELECT repo_id, chunk_id, code, substr(sha256(coalesce(code, '')), 1, 16) AS h FROM chunk_old")
cte("d_new", "SELECT repo_id, chunk_id, code, substr(sha256(coalesce(code, '')), 1, 16) AS h FROM chunk_new")
cte("d_diff", """
SELECT coalesce(o.repo_id, n.repo_id) AS repo_id, coalesce(o.chunk_id, n.chunk_id) AS chunk_id, n.h AS new_hash,
 CASE WHEN n.h IS NULL THEN 'stale' WHEN o.h IS NULL THEN 'new' WHEN o.h <> n.h THEN 'changed' ELSE 'unchanged' END AS status
FROM d_old o FULL JOIN d_new n ON o.repo_id = n.repo_id AND o.chunk_id = n.chunk_id""")


@query("j13_index_diff", "SELECT * FROM d_diff")
def index_diff(t):
    return V.index_diff(t.chunk_old, t.chunk_new)


@query("r2_index_refresh", "SELECT n.repo_id, n.chunk_id, n.h AS hash, d.status FROM d_new n JOIN d_diff d USING (repo_id, chunk_id)")
def index_refresh(t):
    return V.refresh(t.chunk_old, t.chunk_new).select("repo_id", "chunk_id", X.content_hash(F.col("code")).alias("hash"), "status")


@query("u2_upsert_by_id", "SELECT repo_id, chunk_id, h AS hash FROM d_new UNION ALL SELECT repo_id, chunk_id, h FROM d_old o WHERE NOT EXISTS (SELECT 1 FROM d_new n WHERE n.repo_id = o.repo_id AND n.chunk_id = o.chunk_id)")
def upsert_by_id(t):
    return V.upsert(t.chunk_old, t.chunk_new).select("repo_id", "chunk_id", X.content_hash(F.col("code")).alias("hash"))


@query("f4_content_hash", "SELECT doc_id, substr(sha256(coalesce(CASE WHEN doc_id % 50 = 0 THEN NULL ELSE text END, '')), 1, 16) AS hash FROM documents")
def content_hash(t):
    return t.documents.select("doc_id", X.content_hash(F.when(F.col("doc_id") % 50 != 0, F.col("text"))).alias("hash"))


@query("f5_repository_id", r"""
SELECT page_id, CASE WHEN page_id % 4 = 3 THEN coalesce(nullif(regexp_extract(path, '[^/]*$'), ''), 'repo') || '_' || substr(sha1(path), 1, 8)
 ELSE regexp_replace(regexp_replace(regexp_extract(origin, '[^/]*$'), '\.git$', ''), '[^A-Za-z0-9]+', '_', 'g') || '_' || substr(sha1(origin), 1, 8) END AS repo_id
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '.git' ELSE url END AS origin, '/srv/' || CAST(page_id AS VARCHAR) AS path FROM pages)""")
def repository_id(t):
    origin = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit(".git"))).otherwise(F.col("url"))
    path = F.concat(F.lit("/srv/"), F.col("page_id").cast("string"))
    rows = t.pages.select("page_id", F.when(F.col("page_id") % 4 != 3, origin).alias("origin"), path.alias("path"))
    slug = F.regexp_replace(F.regexp_replace(X.basename(F.col("origin")), r"\.git$", ""), "[^A-Za-z0-9]+", "_")
    local = F.coalesce(X.blank_to_null(X.basename(F.col("path"))), F.lit("repo"))
    return rows.select("page_id", F.coalesce(F.concat(slug, F.lit("_"), F.left(F.sha1("origin"), F.lit(8))),
                                             F.concat(local, F.lit("_"), F.left(F.sha1("path"), F.lit(8)))).alias("repo_id"))


@query("f6_scoped_id", "SELECT doc_id, source || '::doc_' || CAST(doc_id AS VARCHAR) AS scoped_id FROM documents")
def scoped_id(t):
    return t.documents.select("doc_id", F.concat("source", F.lit("::doc_"), F.col("doc_id").cast("string")).alias("scoped_id"))


_SLUG_URL = "CASE page_id % 5 WHEN 0 THEN 'https://github.com/own' || CAST(page_id AS VARCHAR) || '/lib.git' WHEN 1 THEN 'git@github.com:own/lib_' || CAST(page_id AS VARCHAR) WHEN 2 THEN 'own' || CAST(page_id AS VARCHAR) || '/short' WHEN 3 THEN url ELSE 'nosplit' END"


@query("f7_repository_slug", rf"""
SELECT page_id, CASE WHEN m THEN regexp_extract(u, 'github\.com[:/]([^/]+)/([^/]+)$', 1) WHEN short THEN split_part(u, '/', 1) END AS owner,
 CASE WHEN m THEN regexp_extract(u, 'github\.com[:/]([^/]+)/([^/]+)$', 2) WHEN short THEN substr(u, instr(u, '/') + 1) END AS repo, NOT m AND NOT short AS rejected
FROM (SELECT page_id, u, regexp_matches(u, 'github\.com[:/]([^/]+)/([^/]+)$') AS m, contains(u, '/') AND NOT starts_with(u, 'http') AS short FROM (SELECT page_id, regexp_replace(trim({_SLUG_URL}), '\.git$', '') AS u FROM pages))""")
def repository_slug(t):
    n, no = F.col("page_id") % 5, F.col("page_id").cast("string")
    url = (F.when(n == 0, F.concat(F.lit("https://github.com/own"), no, F.lit("/lib.git"))).when(n == 1, F.concat(F.lit("git@github.com:own/lib_"), no))
           .when(n == 2, F.concat(F.lit("own"), no, F.lit("/short"))).when(n == 3, F.col("url")).otherwise("nosplit"))
    pattern = r"github\.com[:/]([^/]+)/([^/]+)$"
    u = F.col("u")
    hosted, short = u.rlike(pattern), F.contains(u, F.lit("/")) & ~F.startswith(u, F.lit("http"))
    return t.pages.select("page_id", F.regexp_replace(F.trim(url), r"\.git$", "").alias("u")).select(
        "page_id", F.when(hosted, F.regexp_extract(u, pattern, 1)).when(short, F.substring_index(u, "/", 1)).alias("owner"),
        F.when(hosted, F.regexp_extract(u, pattern, 2)).when(short, F.substr(u, F.instr(u, "/") + 1)).alias("repo"), (~hosted & ~short).alias("rejected"))


@query("f8_token_estimate", "SELECT doc_id, CAST(greatest(1, floor(length(text) / 4 * 1.15::DOUBLE)) AS BIGINT) AS tokens FROM documents")
def token_estimate(t):
    return t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("f9_token_truncation", "SELECT doc_id, CASE WHEN greatest(1, floor(length(text) / 4 * 1.15::DOUBLE)) <= 4000 THEN text ELSE left(text, 13913) END AS text FROM documents")
def token_truncation(t):
    return t.documents.select("doc_id", X.cut_to_budget(F.col("text")).alias("text"))


@query("f10_fit_dimension", """
SELECT vec_id, dim, pos, CAST(coalesce(embedding[pos], 0) AS DOUBLE) AS value FROM embeddings, (VALUES (48), (80)) d(dim), LATERAL (SELECT unnest(range(1, dim + 1)) AS pos)""")
def fit_dimension(t):
    cut = None
    for dim in (48, 80):
        part = t.embeddings.select("vec_id", F.lit(dim).alias("dim"), F.posexplode(V.fit_dimension(F.col("embedding"), dim)).alias("p", "v"))
        cut = part if cut is None else cut.unionByName(part)
    return cut.select("vec_id", "dim", (F.col("p") + 1).cast("bigint").alias("pos"), F.col("v").cast("double").alias("value"))


cte("d_doc_chars", "SELECT doc_id, unicode(c) AS cp, i - 1 AS idx FROM (SELECT doc_id, unnest(string_split(left(text, 2000), '')) AS c, generate_subscripts(string_split(left(text, 2000), ''), 1) AS i FROM documents) WHERE c <> ''")


@query("f11_hash_embedding", """
WITH k AS (SELECT doc_id, (cp + idx) % 3072 AS bucket, count(*) AS n FROM d_doc_chars GROUP BY ALL)
SELECT doc_id, CAST(bucket AS BIGINT) AS bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS weight FROM k""")
def hash_embedding(t):
    counted = t.documents.select("doc_id", V.hash_counts(F.col("text")).alias("counts"))
    return counted.select("doc_id", F.inline(V.unit(F.col("counts")))).select("doc_id", F.col("slot").cast("bigint").alias("bucket"), "weight")


_NEAREST = """
WITH q AS (SELECT vec_id AS query_id, label, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT query_id, vec_id AS item_id, list_sum(list_transform(list_zip(embedding, qv), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) AS cost FROM embeddings e JOIN q ON q.label = e.label)
SELECT query_id, item_id, round(cost, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY cost, item_id) AS hit FROM d QUALIFY hit <= 5"""


def _vectors(t):
    """Every vector, and every twentieth as a query; a label stands for a repository."""
    part = F.concat(F.lit("table|"), F.col("label").cast("string")).alias("part")
    items = t.embeddings.select(F.col("vec_id").alias("item_id"), part, F.col("embedding").alias("vec"))
    return items, t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), part, F.col("embedding").alias("vec"))


@query("r3_nearest_vectors", _NEAREST)
def nearest_vectors(t):
    """Five nearest vectors to every twentieth vector, among all of its repository."""
    return V.nearest(*_vectors(t), rules.CODE_HITS).select("query_id", "item_id", F.round("cost", 6).alias("distance"), "hit")


@query("r3_nearest_in_cells", _NEAREST)
def nearest_in_cells(t):
    """The same through the index of cells, which compares only what its bounds leave."""
    items, queries = _vectors(t)
    found, _ = cells.search(cells.build(items), queries, rules.CODE_HITS)
    return found.select("query_id", "item_id", F.round("cost", 6).alias("distance"), "hit")


@query("r4_keyword_fallback", r"""
WITH r AS (SELECT repo_id, row_number() OVER (ORDER BY repo_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT coalesce(source, '') AS repo_id FROM documents)),
w AS (SELECT DISTINCT item_id AS query_id, repo_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM benchmark JOIN r ON item_id % n = k),
s AS (SELECT query_id, doc_id AS item_id, count(*) AS score FROM w JOIN documents ON coalesce(source, '') = repo_id AND (contains(lower(text), word) OR contains('doc_' || CAST(doc_id AS VARCHAR), word)) WHERE word <> '' GROUP BY ALL)
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS hit FROM s QUALIFY hit <= 3""")
def keyword_fallback(t):
    """Each benchmark item asks one source, as a repository, and finds nothing elsewhere; sources are taken in turn."""
    repo = F.coalesce("source", F.lit("")).alias("repo_id")
    items = t.documents.select(F.col("doc_id").alias("item_id"), repo, F.col("text").alias("code"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"))
    sources = cut_lineage(t.documents.select(repo).distinct().withColumn("turn", F.row_number().over(Window.orderBy("repo_id")) - 1))  # a row per source
    asked = t.benchmark.withColumn("turn", F.pmod("item_id", F.lit(max(sources.count(), 1)))).join(F.broadcast(sources), "turn")
    return V.keyword_hits(items, asked.select(F.col("item_id").alias("query_id"), "repo_id", "text"))


# --- the chain from top suspects to their context ----------------------------------------

cte("d_top", """
SELECT p.failure_id, p.symbol_id, p.name, p.ord, p.file_path, f.repo_id, f.exception_type, f.exception_message FROM d_pool p JOIN d_failures f ON f.log_id = p.failure_id WHERE p.rank = 1""")
cte("d_framings", """
SELECT failure_id, repo_id, 1 AS framing, trim(name || ' ' || exception_type || ' ' || exception_message) AS text FROM d_top
UNION ALL SELECT failure_id, repo_id, 2, trim(exception_type || ' ' || exception_message) FROM d_top UNION ALL SELECT failure_id, repo_id, 3, name FROM d_top""")
cte("d_query_counts", """
SELECT repo_id, text, (unicode(c) + i - 1) % 3072 AS b, count(*) AS n FROM (SELECT repo_id, text, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM (SELECT DISTINCT repo_id, text FROM d_framings)) GROUP BY ALL""")
cte("d_chunks", "SELECT repo_id, ord, code FROM code_symbols JOIN d_py_source USING (repo_id, ord)")
cte("d_chunk_counts", """
SELECT repo_id, ord, (unicode(c) + i - 1) % 3072 AS b, count(*) AS n FROM (SELECT repo_id, ord, unnest(string_split(left(code, 2000), '')) AS c, generate_subscripts(string_split(left(code, 2000), ''), 1) AS i FROM d_chunks) WHERE c <> '' GROUP BY ALL""")
cte("d_query_hits", """
SELECT repo_id, text, ord, row_number() OVER (PARTITION BY repo_id, text ORDER BY cost, ord) AS hit FROM (
 SELECT q.repo_id, q.text, c.ord, CASE WHEN any_value(c.s) > 0 THEN 2 ELSE 1 END - 2 * (sum(coalesce(k.n, 0) * q.n) / sqrt(CAST(greatest(any_value(c.s) * any_value(q.s), 1) AS DOUBLE))) AS cost
 FROM (SELECT *, sum(n * n) OVER (PARTITION BY repo_id, text) AS s FROM d_query_counts) q JOIN (SELECT d.repo_id, d.ord, coalesce(sum(n * n), 0) AS s FROM d_chunks d LEFT JOIN d_chunk_counts USING (repo_id, ord) GROUP BY ALL) c ON c.repo_id = q.repo_id
  LEFT JOIN d_chunk_counts k ON k.ord = c.ord AND k.b = q.b GROUP BY q.repo_id, q.text, c.ord) QUALIFY hit <= 5""")
cte("d_merged", """
SELECT f.failure_id, h.ord, min({'a': framing, 'b': hit}) AS place FROM d_framings f JOIN d_query_hits h ON h.repo_id = f.repo_id AND h.text = f.text GROUP BY ALL""")
cte("d_context", """
SELECT m.failure_id, s.symbol_id AS chunk_id, s.is_test, row_number() OVER (PARTITION BY m.failure_id, s.is_test ORDER BY place) AS n FROM d_merged m JOIN code_symbols s ON s.ord = m.ord JOIN d_top t ON t.failure_id = m.failure_id
WHERE s.symbol_id <> t.symbol_id QUALIFY n <= CASE WHEN s.is_test THEN 3 ELSE 5 END""")
cte("d_fixes", r"""
WITH by_type AS (SELECT ord, lower(exception_type) AS kind, row_number() OVER (PARTITION BY lower(exception_type) ORDER BY ord DESC) AS n FROM fix_history QUALIFY n <= 2),
signs AS (SELECT DISTINCT exception_type, exception_message FROM d_failures),
loose AS (SELECT s.exception_type, s.exception_message, h.ord, row_number() OVER (PARTITION BY s.exception_type, s.exception_message ORDER BY h.ord DESC) AS n FROM signs s JOIN fix_history h
  ON len(list_filter(regexp_split_to_array(lower(s.exception_message), '\s+'), lambda w: length(w) > 3 AND contains(lower(h.exception_message), w))) > 0
  WHERE lower(s.exception_type) NOT IN (SELECT kind FROM by_type) QUALIFY n <= 2)
SELECT f.log_id AS failure_id, x.ord AS fix_ord, x.n FROM d_failures f JOIN (SELECT s.exception_type, s.exception_message, b.ord, b.n FROM signs s JOIN by_type b ON b.kind = lower(s.exception_type) UNION ALL SELECT * FROM loose) x
 ON x.exception_type = f.exception_type AND x.exception_message = f.exception_message""")


def top_suspects(t, found=None):
    found = failures(t) if found is None else found
    best = pool(scored(t, found, top=1), 1).drop("rank", "score")
    return shared(best.join(found.select("failure_id", "repo_id", "exception_type", "exception_message"), "failure_id"))


def chunks(t):
    """The source of every symbol."""
    return code_symbols(t).select("repo_id", "ord", F.col("symbol_id").alias("chunk_id"), "name", "code", "is_test")


@query("r5_query_framings", "SELECT failure_id, framing::BIGINT AS framing, text FROM d_framings WHERE text <> ''")
def query_framings(t):
    return V.framings(top_suspects(t)).select("failure_id", "framing", "text")


@query("u1_merged_hits", "SELECT failure_id, symbol_id AS chunk_id, CAST(place.a AS BIGINT) AS framing, CAST(place.b AS BIGINT) AS hit FROM d_merged JOIN code_symbols USING (ord)")
def merged_hits(t):
    return V.retrieve(top_suspects(t), chunks(t)).select("failure_id", "chunk_id", "place.framing", "place.hit")


# repositories with numbers in threes have no vectors, as after an outage
_EMBEDDED = "CAST(substr(repo_id, 6) AS BIGINT) % 3 <> 0"


@query("r4_fallback_chain", f"""
WITH w AS (SELECT DISTINCT repo_id, text, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM d_framings WHERE NOT ({_EMBEDDED})),
s AS (SELECT w.repo_id, w.text, c.ord, count(*) AS score FROM w JOIN (SELECT repo_id, ord, name, d.code FROM code_symbols JOIN d_chunks d USING (repo_id, ord)) c ON c.repo_id = w.repo_id AND (contains(lower(c.code), word) OR contains(lower(c.name), word)) WHERE word <> '' GROUP BY ALL),
h AS (SELECT repo_id, text, ord, hit FROM d_query_hits WHERE {_EMBEDDED} UNION ALL SELECT repo_id, text, ord, row_number() OVER (PARTITION BY repo_id, text ORDER BY score DESC, ord) AS hit FROM s QUALIFY hit <= 5),
m AS (SELECT f.failure_id, h.ord, min({{'a': framing, 'b': hit}}) AS place FROM d_framings f JOIN h ON h.repo_id = f.repo_id AND h.text = f.text GROUP BY ALL)
SELECT failure_id, symbol_id AS chunk_id, CAST(place.a AS BIGINT) AS framing, CAST(place.b AS BIGINT) AS hit FROM m JOIN code_symbols USING (ord)""")
def fallback_chain(t):
    """Merged hits where some repositories have no vectors: their suspects are answered by keywords, the others by vectors."""
    held = chunks(t).withColumn("embedded", F.expr(_EMBEDDED))
    return V.retrieve(top_suspects(t), held).select("failure_id", "chunk_id", "place.framing", "place.hit")


@query("r6_context_caps", "SELECT * FROM d_context")
def context_caps(t):
    top = top_suspects(t)
    return V.context(V.retrieve(top, chunks(t)), top)


@query("r7_similar_fixes", "SELECT failure_id, fix_ord, n FROM d_fixes")
def similar_fixes(t):
    return V.similar_fixes(failures(t), t.fix_history)


@query("p7_history_for_file", "SELECT f.failure_id, f.fix_ord FROM d_fixes f JOIN d_top t USING (failure_id) JOIN fix_history h ON h.ord = f.fix_ord WHERE contains(h.applied_diff, regexp_extract(t.file_path, '[^/]*$'))")
def history_for_file(t):
    """Of the fixes found for a failure, those whose diff names the suspect's file."""
    found = failures(t)
    fixes = V.similar_fixes(found, t.fix_history)
    return (fixes.join(top_suspects(t, found).select("failure_id", "file_path"), "failure_id")
            .join(t.fix_history.select(F.col("ord").alias("fix_ord"), "applied_diff"), "fix_ord")
            .where(F.contains("applied_diff", X.basename(F.col("file_path")))).select("failure_id", "fix_ord"))


@query("r9_context_bundle", """
SELECT failure_id, coalesce(c.code, 0) AS code_chunks, coalesce(c.tests, 0) AS test_chunks, coalesce(f.n, 0) AS past_fixes, coalesce(c.code, 0) + coalesce(c.tests, 0) + coalesce(f.n, 0) = 0 AS is_empty
FROM d_top LEFT JOIN (SELECT failure_id, count(*) FILTER (NOT is_test) AS code, count(*) FILTER (is_test) AS tests FROM d_context GROUP BY 1) c USING (failure_id) LEFT JOIN (SELECT failure_id, count(*) AS n FROM d_fixes GROUP BY 1) f USING (failure_id)""")
def context_bundle(t):
    found = failures(t)
    top = top_suspects(t, found)
    parts = V.context(V.retrieve(top, chunks(t)), top).groupBy("failure_id").agg(
        F.count_if(~F.col("is_test")).alias("code_chunks"), F.count_if(F.col("is_test")).alias("test_chunks"))
    fixes = V.similar_fixes(found, t.fix_history).groupBy("failure_id").agg(F.count(F.lit(1)).alias("past_fixes"))
    names = ("code_chunks", "test_chunks", "past_fixes")
    return (top.select("failure_id").join(parts, "failure_id", "left").join(fixes, "failure_id", "left").na.fill(0, list(names))
            .withColumn("is_empty", F.expr(" + ".join(names)) == 0))


@query("r8_batch_packing", """
WITH RECURSIVE d AS (SELECT source AS repo_id, doc_id AS ord, greatest(1, floor(length(tx) / 4 * 1.15::DOUBLE)) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p
  FROM (SELECT *, CASE WHEN greatest(1, floor(length(text) / 4 * 1.15::DOUBLE)) <= 4000 THEN text ELSE left(text, 13913) END AS tx FROM documents)),
w AS (SELECT repo_id, ord, tokens, p, 1 AS batch, 1 AS cnt, tokens AS tot FROM d WHERE p = 1
 UNION ALL SELECT d.repo_id, d.ord, d.tokens, d.p, CASE WHEN w.tot + d.tokens > 8000 OR w.cnt >= 100 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.tot + d.tokens > 8000 OR w.cnt >= 100 THEN 1 ELSE w.cnt + 1 END, CASE WHEN w.tot + d.tokens > 8000 OR w.cnt >= 100 THEN d.tokens ELSE w.tot + d.tokens END
 FROM w JOIN d ON d.repo_id = w.repo_id AND d.p = w.p + 1)
SELECT repo_id, ord, CAST(tokens AS BIGINT) AS tokens, CAST(batch AS BIGINT) AS batch FROM w""")
def batch_packing(t):
    return V.pack_batches(t.documents.select(F.col("source").alias("repo_id"), F.col("doc_id").alias("ord"), "text"))
