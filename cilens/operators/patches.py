"""Unified diffs: hunks, counters, anchoring, risk, and differences between file versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cilens import rules
from cilens.functions import text as X

_HUNK_AHEAD = r"(?md)^(?=@@[ \t]+-\d+(?:,\d+)?[ \t]+\+\d+(?:,\d+)?[ \t]+@@)"


def _marked(line: Column, marker: str) -> Column:
    return F.startswith(line, F.lit(marker)) & ~X.starts_any(line, rules.FILE_HEADERS)


def hunks(patches: DataFrame) -> DataFrame:
    """One row per hunk: its number (the count of headers so far), declared start and lines.

    The text is cut in front of each header, so numbering needs no window. Lines before any
    header form a hunk of their own, anchored at line 1, if they hold diff content.
    """
    cut = F.split(X.drop_last_newline(F.coalesce("unified_diff", F.lit(""))), _HUNK_AHEAD)
    rows = patches.select("patch_id", F.posexplode(cut).alias("p", "part"), F.get(cut, F.lit(0)).rlike(rules.HUNK_HEADER).alias("headed"))
    rows = rows.select(
        "patch_id", (F.col("p") + F.when(F.col("headed"), 1).otherwise(0)).cast("bigint").alias("hunk_no"),
        F.col("part").rlike(rules.HUNK_HEADER).alias("has_header"), X.blank_to_null(F.regexp_extract("part", rules.HUNK_HEADER, 1)).alias("start"),
        X.lines(X.drop_last_newline(F.col("part"))).alias("lines"))
    body = F.when(F.col("has_header"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).otherwise(F.col("lines"))
    rows = rows.withColumn("lines", body)
    edit = F.array_position(F.transform("lines", lambda l: _marked(l, "+") | _marked(l, "-")), True)

    def blank(line: Column, i: Column) -> Column:
        inside = F.col("has_header") | ((F.col("edit") > 0) & (i >= F.col("edit")))
        return (X.strip(line) == "") & ~F.startswith(line, F.lit(" ")) & inside

    rows = rows.withColumn("edit", edit)
    old = F.filter("lines", lambda l, i: _marked(l, "-") | F.startswith(l, F.lit(" ")) | blank(l, i))
    new = F.filter("lines", lambda l, i: _marked(l, "+") | F.startswith(l, F.lit(" ")) | blank(l, i))
    return rows.select(
        "patch_id", "hunk_no", F.greatest(F.coalesce(F.col("start").cast("bigint"), F.lit(1)), F.lit(1)).alias("old_start"),
        F.transform(old, lambda l: F.substr(l, F.lit(2))).alias("old_lines"), F.transform(new, lambda l: F.substr(l, F.lit(2))).alias("new_lines"),
        F.size(F.filter("lines", lambda l: _marked(l, "+"))).cast("bigint").alias("added"),
        F.size(F.filter("lines", lambda l: _marked(l, "-"))).cast("bigint").alias("removed"),
    ).where("size(old_lines) > 0 or size(new_lines) > 0")


def diff_line_kind(line: Column) -> Column:
    return (F.when(F.startswith(line, F.lit("@@")), "hunk").when(X.starts_any(line, rules.FILE_HEADERS), "header")
            .when(F.startswith(line, F.lit("+")), "add").when(F.startswith(line, F.lit("-")), "remove").otherwise("context"))


def diff_lines(patches: DataFrame) -> DataFrame:
    rows = patches.where("unified_diff <> ''").select("patch_id", F.posexplode(X.lines(X.drop_last_newline(F.col("unified_diff")))).alias("p", "line"))
    return rows.select("patch_id", (F.col("p") + 1).cast("bigint").alias("line_no"), diff_line_kind(F.col("line")).alias("kind"), "line")


def rejection(diff: Column) -> Column:
    """Why a diff cannot be a patch at all; null when it can."""
    clean = F.regexp_replace(F.coalesce(diff, F.lit("")), r"\A\s+|\s+\z", "")
    marked = F.exists(X.lines(clean), lambda l: X.starts_any(l, ("+", "-", "@@")))
    return F.when(clean == "", "malformed_diff: empty").when(~marked, "malformed_diff: no diff lines")


def added_text(diff: Column) -> Column:
    added = F.filter(X.lines(F.coalesce(diff, F.lit(""))), lambda l: F.startswith(l, F.lit("+")))
    return F.array_join(F.transform(added, lambda l: F.substr(l, F.lit(2))), "\n")


def risk(patches: DataFrame, words: tuple[str, ...] = rules.RISK_WORDS) -> DataFrame:
    """Signals of a sensitive change: identifier tokens of where it lands and of added lines,
    plus patterns in added lines. ``words`` replaces the word list."""
    def tokens(text: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), F.lower)

    sensitive = F.array(*[F.lit(w) for w in words])
    df = patches.withColumn("added", added_text(F.col("unified_diff")))
    named = F.array_intersect(F.concat(tokens(F.concat_ws(" ", "target_file", "function_name")), tokens(F.col("added"))), sensitive)
    acts = F.array_compact(F.array(*[F.when(F.col("added").rlike(p), F.lit(label)) for p, label in rules.RISK_PATTERNS]))
    df = df.withColumn("matched", F.array_sort(F.array_distinct(F.concat(named, acts)))).drop("added")
    return df.withColumn("is_risky", F.size("matched") > 0).withColumn("risk_level", F.when(F.col("is_risky"), "HIGH").otherwise("LOW"))


def sign_off(risky: Column, approval_required: Column) -> Column:
    gated = risky & approval_required
    return F.struct(F.when(gated, "PENDING_APPROVAL").otherwise("COMPLETED").alias("state"),
                    F.when(gated, "SAFETY_GATE_TRIGGERED").otherwise("AUTO_APPLY_APPROVED").alias("action"),
                    F.when(gated, "REQUIRES_APPROVAL").otherwise("SUCCESS").alias("result"))


def _first_block(lines: Column, pattern: Column) -> Column:
    """0-based line where the pattern's lines first occur in a row, null when nowhere.

    Lines hold no newline, so a text search for the newline-framed block is the same as
    comparing every offset and takes one pass.
    """
    frame = lambda a: F.concat(F.lit("\n"), F.array_join(a, "\n"), F.lit("\n"))
    at = F.instr(frame(lines), frame(pattern))
    before = F.substr(frame(lines), F.lit(1), at - 1)
    return F.when(at > 0, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))))


def anchor(lines: Column, pattern: Column, preferred: Column) -> Column:
    """Where a hunk's expected lines sit: (line index, matched exactly), null when nowhere.

    The declared position wins, then the first exact occurrence, then the same two tests with
    surrounding blanks ignored. A hunk without expected lines sits at its clamped position.
    """
    size = F.size(pattern)
    fits = (preferred >= 0) & (preferred + size <= F.size(lines))
    trim = lambda a: F.transform(a, X.strip)

    def place(haystack: Column, needle: Column, exact: bool) -> Column:
        here = F.when(fits & (F.slice(haystack, F.greatest(preferred, F.lit(0)) + 1, size) == needle), preferred)
        return X.let(F.coalesce(here, _first_block(haystack, needle)), lambda at: F.when(
            at.isNotNull(), F.struct(at.cast("bigint").alias("at"), F.lit(exact).alias("exact"))))

    clamped = F.struct(F.greatest(F.lit(0), F.least(preferred, F.size(lines))).cast("bigint").alias("at"), F.lit(True).alias("exact"))
    return F.when(size == 0, clamped).otherwise(F.coalesce(place(lines, pattern, True), place(trim(lines), trim(pattern), False)))


def place_hunks(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """Every hunk with ``at``, the 0-based line of its file where its expected lines sit, and whether they match ``exact``.

    files: repo_id, file_path (one row each), lines; hunks: repo_id, file_path, patch_id, hunk_no (one row each), old_start,
    old_lines. The order of preference is that of ``anchor``. A hunk found nowhere, or whose file is missing, has null in both.
    A null line is an empty one. All hunks of a patch are placed in the file as given.

    An inverted index of the files' lines by hash is joined with the hunks' lines. The line of a hunk that its file holds
    least often names the candidates, so a line such as a lone bracket names some only where a hunk has no other; a hunk
    with a line that its file lacks has none. Candidates are verified line by line. No task needs a whole file.

    Every join is a sorted one: a planner that knows only the size of compressed files takes lines for a small table and
    would gather them in the driver to send them around.
    """
    file, hunk = ["repo_id", "file_path"], ["repo_id", "file_path", "patch_id", "hunk_no"]
    known = lambda rows, name: rows.withColumn(name, F.coalesce(name, F.lit(""))).withColumn("h", F.xxhash64(X.strip(F.col(name))))
    index = known(files.select(*file, F.posexplode("lines").alias("i", "line")), "line")
    asked = known(hunks.select(*hunk, F.posexplode("old_lines").alias("j", "want")), "want")
    counts = index.join(asked.select(*file, "h").distinct().hint("merge"), [*file, "h"], "left_semi").groupBy(*file, "h").agg(F.count(F.lit(1)).alias("n"))
    rarest = (asked.join(counts.hint("merge"), [*file, "h"], "left").groupBy(*hunk)
              .agg(F.min(F.struct("n", "j", "h")).alias("r"), F.count("n").alias("held"), F.count(F.lit(1)).alias("size")).where("held = size"))
    starts = (rarest.select(*hunk, "size", "r.j", "r.h").join(index.select(*file, "h", "i").hint("merge"), [*file, "h"])
              .select(*hunk, "size", (F.col("i") - F.col("j")).alias("at")).where("at >= 0"))
    pairs = (starts.join(asked.drop("h").hint("merge"), hunk).withColumn("i", F.col("at") + F.col("j")).join(index.select(*file, "i", "line").hint("merge"), [*file, "i"])
             .where(X.strip(F.col("line")) == X.strip(F.col("want"))))
    spots = pairs.groupBy(*hunk, "at", "size").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("line") == F.col("want")).alias("exact")).where("n = size")
    preferred = F.col("old_start") - 1
    best = (spots.join(hunks.select(*hunk, "old_start").hint("merge"), hunk).groupBy(*hunk)
            .agg(F.min(F.struct((~F.col("exact")).alias("loose"), (F.col("at") != preferred).alias("moved"), "at")).alias("best")))
    length = files.select(*file, F.greatest(F.size("lines"), F.lit(0)).alias("length"))
    empty = F.coalesce(F.size("old_lines"), F.lit(0)) <= 0
    clamped = F.when(F.col("length").isNotNull(), F.greatest(F.lit(0), F.least(preferred, F.col("length"))))
    return hunks.join(best.hint("merge"), hunk, "left").join(length.hint("merge"), file, "left").select(
        *hunk, F.when(empty, clamped).otherwise(F.col("best.at")).cast("bigint").alias("at"),
        F.when(empty, F.when(F.col("length").isNotNull(), F.lit(True))).otherwise(~F.col("best.loose")).alias("exact"))


def changed_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines removed and added between two versions of each file, as multisets.

    Unchanged files are left out by hash before any text is cut into lines; the counts combine
    ahead of the shuffle.
    """
    both = (before.select("repo_id", "chunk_id", F.col("code").alias("old"))
            .join(after.select("repo_id", "chunk_id", F.col("code").alias("new")), ["repo_id", "chunk_id"])
            .where(X.content_hash(F.col("old")) != X.content_hash(F.col("new"))))
    side = lambda col, sign: F.transform(X.lines(F.col(col)), lambda l: F.struct(l.alias("line"), F.lit(sign).alias("sign")))
    rows = both.select("repo_id", "chunk_id", F.inline(F.concat(side("old", -1), side("new", 1))))
    net = rows.groupBy("repo_id", "chunk_id", "line").agg(F.sum("sign").alias("net")).where("net <> 0")
    return net.select("repo_id", "chunk_id", "line", F.when(F.col("net") > 0, "added").otherwise("removed").alias("side"), F.abs("net").alias("times"))


def no_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether a version differs from the one before once its lines are joined again."""
    joined = lambda c: F.sha2(F.array_join(X.lines(X.drop_last_newline(F.col(c))), "\n"), 256)
    return (before.select("repo_id", "chunk_id", joined("code").alias("old")).join(after.select("repo_id", "chunk_id", joined("code").alias("new")), ["repo_id", "chunk_id"])
            .select("repo_id", "chunk_id", F.when(F.col("old") == F.col("new"), "no_change").otherwise("changed").alias("verdict")))
