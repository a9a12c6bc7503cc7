"""Patch queries."""

from pyspark.sql import functions as F

from cilens import rules
from cilens.functions import text as X
from cilens.operators import patches as P
from cilens.plans.registry import cte, query
from cilens.plans.source import files
from cilens.session import cut_lineage

cte("d_diff_lines", """
SELECT patch_id, unnest(arr) AS line, generate_subscripts(arr, 1) AS line_no FROM (SELECT patch_id, string_split(regexp_replace(unified_diff, '\\n$', ''), chr(10)) AS arr FROM patches WHERE unified_diff <> '')""")
cte("d_hunk_lines", f"""
SELECT *, regexp_matches(line, '{rules.HUNK_HEADER}') AS header, sum(CAST(regexp_matches(line, '{rules.HUNK_HEADER}') AS INT)) OVER (PARTITION BY patch_id ORDER BY line_no) AS hunk_no,
 starts_with(line, '---') OR starts_with(line, '+++') OR starts_with(line, 'diff ') OR starts_with(line, 'index ') OR starts_with(line, '\\ No newline') AS file_header FROM d_diff_lines""")
_ADDED = "(SELECT patch_id, string_agg(substr(line, 2), chr(10) ORDER BY line_no) AS added FROM d_diff_lines WHERE starts_with(line, '+') GROUP BY patch_id)"
_WORDS = "(" + ", ".join(f"'{w}'" for w in rules.RISK_WORDS) + ")"
cte("d_signals", f"""
WITH p AS (SELECT p.*, coalesce(a.added, '') AS added FROM patches p LEFT JOIN {_ADDED} a USING (patch_id)),
w AS (SELECT patch_id, lower(unnest(regexp_extract_all(target_file || ' ' || function_name || chr(10) || added, '[A-Za-z]+'))) AS signal FROM p)
SELECT DISTINCT patch_id, signal FROM w WHERE signal IN {_WORDS}
""" + "".join(f"UNION ALL SELECT patch_id, '{label}' FROM p WHERE regexp_matches(added, '{pattern}')\n" for pattern, label in rules.RISK_PATTERNS))


@query("w11_hunks", """
SELECT patch_id, CAST(hunk_no AS BIGINT) AS hunk_no, greatest(1, coalesce(max(TRY_CAST(regexp_extract(line, '^@@\\s+-(\\d+)', 1) AS BIGINT)) FILTER (header), 1)) AS old_start,
 string_agg(substr(line, 2), chr(10) ORDER BY line_no) FILTER (NOT header AND NOT file_header AND (starts_with(line, '-') OR starts_with(line, ' '))) AS old_text,
 count(*) FILTER (NOT header AND NOT file_header AND starts_with(line, '+')) AS added, count(*) FILTER (NOT header AND NOT file_header AND starts_with(line, '-')) AS removed
FROM d_hunk_lines GROUP BY patch_id, hunk_no HAVING count(*) FILTER (NOT header AND NOT file_header AND (starts_with(line, '-') OR starts_with(line, '+') OR starts_with(line, ' '))) > 0""")
def hunks(t):
    return P.hunks(t.patches).select("patch_id", "hunk_no", "old_start", F.array_join("old_lines", "\n").alias("old_text"), "added", "removed")


@query("f14_diff_lines", """
SELECT patch_id, line_no, CASE WHEN starts_with(line, '@@') THEN 'hunk' WHEN file_header THEN 'header' WHEN starts_with(line, '+') THEN 'add' WHEN starts_with(line, '-') THEN 'remove' ELSE 'context' END AS kind, line FROM d_hunk_lines""")
def diff_lines(t):
    return P.diff_lines(t.patches)


@query("a10_diff_counters", """
SELECT patch_id, count(*) FILTER (NOT file_header AND starts_with(line, '+')) AS lines_added, count(*) FILTER (NOT file_header AND starts_with(line, '-')) AS lines_removed FROM d_hunk_lines GROUP BY patch_id""")
def diff_counters(t):
    """Counted inside each patch's own row; nothing is shuffled."""
    kinds = F.transform(X.lines(X.drop_last_newline(F.col("unified_diff"))), P.diff_line_kind)
    counted = t.patches.where("unified_diff <> ''").select("patch_id", kinds.alias("k"))
    count = lambda kind: F.size(F.filter("k", lambda k: k == kind)).cast("bigint")
    return counted.select("patch_id", count("add").alias("lines_added"), count("remove").alias("lines_removed"))


@query("f15_malformed_diff", """
SELECT patch_id, CASE WHEN trim(d) = '' THEN 'malformed_diff: empty' WHEN NOT regexp_matches(d, '(?m)^(\\+|-|@@)') THEN 'malformed_diff: no diff lines' END AS reason
FROM (SELECT patch_id, CASE WHEN patch_id % 13 = 0 THEN 'just prose' ELSE unified_diff END AS d FROM patches)""")
def malformed_diff(t):
    diff = F.when(F.col("patch_id") % 13 == 0, "just prose").otherwise(F.col("unified_diff"))
    return t.patches.select("patch_id", P.rejection(diff).alias("reason"))


@query("f12_patch_risk", """
SELECT patch_id, CASE WHEN count(signal) > 0 THEN 'HIGH' ELSE 'LOW' END AS risk_level, coalesce(string_agg(signal, ',' ORDER BY signal), '') AS matched FROM patches LEFT JOIN d_signals USING (patch_id) GROUP BY patch_id""")
def patch_risk(t):
    return P.risk(t.patches).select("patch_id", "risk_level", F.array_join("matched", ",").alias("matched"))


@query("f13_sign_off", """
SELECT patch_id, CASE WHEN gated THEN 'PENDING_APPROVAL' ELSE 'COMPLETED' END AS state, CASE WHEN gated THEN 'SAFETY_GATE_TRIGGERED' ELSE 'AUTO_APPLY_APPROVED' END AS action, CASE WHEN gated THEN 'REQUIRES_APPROVAL' ELSE 'SUCCESS' END AS result
FROM (SELECT patch_id, patch_id IN (SELECT patch_id FROM d_signals) AND patch_id % 4 <> 0 AS gated FROM patches)""")
def sign_off(t):
    return P.risk(t.patches).select("patch_id", P.sign_off(F.col("is_risky"), F.col("patch_id") % 4 != 0).alias("s")).select("patch_id", "s.*")


@query("a11_risk_signals", "SELECT signal, count(DISTINCT patch_id) AS patches FROM d_signals GROUP BY signal")
def risk_signals(t):
    return P.risk(t.patches).select(F.explode("matched").alias("signal")).groupBy("signal").agg(F.count(F.lit(1)).alias("patches"))


@query("j16_hunk_anchor", """
WITH f AS (SELECT file_no AS patch_id, string_split(content, chr(10)) AS ls FROM d_py_files),
k AS (SELECT patch_id, ls, unnest(range(0, len(ls) // 5)) AS k FROM f),
q AS (SELECT patch_id, k, ls, greatest(5 * k + k % 3 - 1, 0) AS pref,
 CASE WHEN k % 9 = 5 THEN [] ELSE list_transform([ls[5 * k + 1], ls[5 * k + 2] || CASE WHEN k % 7 = 3 THEN ' nowhere' ELSE '' END, ls[5 * k + 3]], lambda x: CASE WHEN k % 4 = 1 THEN '  ' ELSE '' END || x) END AS pat FROM k),
m AS (SELECT *, list_filter(range(0, greatest(len(ls) - len(pat) + 1, 0)), lambda i: ls[i + 1 : i + len(pat)] = pat) AS exact,
 list_filter(range(0, greatest(len(ls) - len(pat) + 1, 0)), lambda i: list_transform(ls[i + 1 : i + len(pat)], lambda x: trim(x)) = list_transform(pat, lambda x: trim(x))) AS loose FROM q)
SELECT patch_id, CAST(k + 1 AS BIGINT) AS hunk_no, CAST(CASE WHEN len(pat) = 0 THEN least(pref, len(ls)) WHEN len(exact) > 0 THEN CASE WHEN list_contains(exact, pref) THEN pref ELSE list_min(exact) END
 WHEN len(loose) > 0 THEN CASE WHEN list_contains(loose, pref) THEN pref ELSE list_min(loose) END ELSE -1 END AS BIGINT) AS at, len(pat) = 0 OR len(exact) > 0 AS exact FROM m""")
def hunk_anchor(t):
    """Each source file gets a patch of many hunks, some declared a line off, re-indented, absent or without expected
    lines; the patch is parsed and its hunks are looked for in the file."""
    source = files(t, "py").select("repo_id", "file_path", F.col("file_no").alias("patch_id"), X.lines(F.col("content")).alias("lines"))

    def hunk(k):
        line = lambda n: F.concat(F.when(k % 4 == 1, "  ").otherwise(""), F.get("lines", k * 5 + n))
        start = F.greatest(k * 5 + k % 3, F.lit(1)).cast("string")
        middle = F.concat(line(1), F.when(k % 7 == 3, " nowhere").otherwise(""))
        body = F.when(k % 9 == 5, "+fresh").otherwise(F.concat(F.lit(" "), line(0), F.lit("\n-"), middle, F.lit("\n+fresh\n "), line(2)))
        return F.concat(F.lit("@@ -"), start, F.lit(",3 +"), start, F.lit(",3 @@\n"), body)

    many = F.floor(F.size("lines") / 5)
    diff = F.array_join(F.transform(F.when(many > 0, F.sequence(F.lit(0).cast("bigint"), many - 1)).otherwise(F.array().cast("array<bigint>")), hunk), "\n")
    patches = source.select("patch_id", F.concat(F.lit("--- a/x.py\n+++ b/x.py\n"), diff, F.lit("\n")).alias("unified_diff"))
    parsed = P.hunks(patches).join(source.select("patch_id", "repo_id", "file_path").hint("merge"), "patch_id")
    placed = P.place_hunks(source, cut_lineage(parsed.select("repo_id", "file_path", "patch_id", "hunk_no", "old_start", "old_lines")))
    return placed.select("patch_id", "hunk_no", F.coalesce("at", F.lit(-1)).alias("at"), F.coalesce("exact", F.lit(False)).alias("exact"))


@query("u4_changed_lines", """
WITH b AS (SELECT repo_id, chunk_id, o.code AS old, n.code AS new FROM chunk_old o JOIN chunk_new n USING (repo_id, chunk_id) WHERE o.code <> n.code),
l AS (SELECT repo_id, chunk_id, unnest(string_split(old, chr(10))) AS line, -1 AS s FROM b UNION ALL SELECT repo_id, chunk_id, unnest(string_split(new, chr(10))), 1 FROM b)
SELECT repo_id, chunk_id, line, CASE WHEN sum(s) > 0 THEN 'added' ELSE 'removed' END AS side, CAST(abs(sum(s)) AS BIGINT) AS times FROM l GROUP BY repo_id, chunk_id, line HAVING sum(s) <> 0""")
def changed_lines(t):
    return P.changed_lines(t.chunk_old, t.chunk_new)


@query("u5_no_change", "SELECT repo_id, chunk_id, CASE WHEN regexp_replace(o.code, '\\n$', '') = regexp_replace(n.code, '\\n$', '') THEN 'no_change' ELSE 'changed' END AS verdict FROM chunk_old o JOIN chunk_new n USING (repo_id, chunk_id)")
def no_change(t):
    return P.no_change(t.chunk_old, t.chunk_new)
