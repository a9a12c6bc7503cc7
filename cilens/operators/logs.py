"""Failures out of raw test and build logs.

One log is one row, and every step is an expression over that row's lines, so parsing any
number of logs is a single narrow pass: no line table, no window and no shuffle. A hot
repository or run costs nothing extra because rows are never brought together.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from cilens import rules
from cilens.functions import text as X
from cilens.session import spread

FRAME = "array<struct<file_path:string,line_number:bigint,function_name:string>>"

_BANNER_AHEAD = r"(?md)^(?=[ \t]*_{3,}[ \t]*[" + rules.W + r".\[\]:<>-]+?[ \t]*_{3,}[ \t\r]*$)"
_BANNER_HEAD = r"(?d)^[ \t]*_{3,}[ \t]*([" + rules.W + r".\[\]:<>-]+?)[ \t]*_{3,}[ \t\r]*(?:\n|\z)"
_PY_FRAME = X.in_text(rules.PY_FRAME)
_PY_FRAME_LINE = _PY_FRAME + "|" + X.in_text(r"[^\n]*?" + rules.PY_NATIVE_FRAME).removeprefix("(?md)")
_PY_SITE = X.in_text(rules.PY_ERROR_SITE)
_PY_SUMMARY = X.in_text(rules.PY_SUMMARY)
_PY_MARKED = X.in_text(rules.PY_MARKED_EXC)
_PY_BARE = X.in_text("(?!FAILED|ERROR)" + rules.PY_BARE_EXC.removeprefix("^"))
_JS_ERROR = X.in_text(rules.JS_ERROR)
_JS_FRAME_LINE = X.in_text(rules.JS_FRAME) + "|" + X.in_text(rules.JS_ARROW_FRAME).removeprefix("(?md)")
_CPP_HINT = r"\.(?:c|cc|cpp|cxx|h|hh|hpp|hxx):\d+:"
_BULLETS = "|".join(rules.JS_SUMMARY_BULLETS)
_JS_HEAD = (r"(?:[ \t]*FAIL[ \t]+\S+?[ \t]*[>›][ \t]*\S.*|[ \t]*●[ \t]+(?!(?i:" + _BULLETS + r")[ \t\r]*(?:\n|\z))\S.*)")
_JS_AHEAD = r"(?md)^(?=" + _JS_HEAD + ")"
_JS_STOP_AHEAD = r"(?md)^(?=" + "|".join(rules.JS_STOPS) + ")"


def owned_languages(log: Column) -> Column:
    """Languages whose runner claims the log, in fixed order."""
    python = X.has_any(log, rules.PY_MARKERS) | (F.contains(log, F.lit("FAILED ")) & F.contains(log, F.lit(".py::")))
    cpp = (log.rlike(_CPP_HINT) & log.rlike(rules.CPP_DIAG)) | log.rlike(rules.GTEST) | log.rlike(rules.CTEST)

    def script(clean: Column) -> Column:
        one_bullet = clean.rlike(r"\A\s*●\s+.+?\s*\z") & clean.rlike(rules.JS_FILE_REF)
        return X.has_any(clean, rules.JS_MARKERS) | one_bullet

    js = X.let(X.ansi_free(log), script)  # colours are taken out once for all tests
    return F.array_compact(F.array(F.when(python, "python"), F.when(cpp, "cpp"), F.when(js, "javascript")))


def runner_language(log: Column) -> Column:
    """Which runner wrote the log: the first owner, null when nobody claims it."""
    return F.try_element_at(owned_languages(log), F.lit(1))


def python_sections(log: Column) -> Column:
    """Banner-headed blocks in order; the whole log when it has no banner."""
    parts = F.filter(F.split(log, _BANNER_AHEAD), lambda p: p.rlike(_BANNER_HEAD))
    return F.transform(F.when(F.size(parts) > 0, parts).otherwise(F.array(log)), X.drop_last_newline)


def js_sections(log: Column) -> Column:
    """Blocks headed by a failed-file line or a failure bullet, in order."""
    parts = F.filter(F.split(log, _JS_AHEAD), lambda p: p.rlike("(?d)^" + _JS_HEAD))
    return F.transform(F.when(F.size(parts) > 0, parts).otherwise(F.array(log)), X.drop_last_newline)


def sections(log: Column, language: Column) -> Column:
    return (F.when(language == "python", python_sections(log))
            .when(language == "javascript", js_sections(log))
            .otherwise(F.array(log)))


def banner_name(section: Column) -> Column:
    return X.blank_to_null(F.regexp_extract(section, _BANNER_HEAD, 1))


def _frame(line: Column, pattern: str, file: int, number: int, func: int | None) -> Column:
    name = F.lit("unknown") if func is None else F.regexp_extract(line, pattern, func)
    return F.struct(
        F.regexp_extract(line, pattern, file).alias("file_path"),
        F.regexp_extract(line, pattern, number).cast("bigint").alias("line_number"),
        F.when(name == "", "unknown").otherwise(name).alias("function_name"),
    )


def python_frames(section: Column) -> Column:
    hits = F.regexp_extract_all(section, F.lit(_PY_FRAME_LINE), F.lit(0))
    return F.transform(hits, lambda l: F.when(l.rlike(_PY_FRAME), _frame(l, _PY_FRAME, 1, 2, 3))
                       .otherwise(_frame(l, rules.PY_NATIVE_FRAME, 1, 2, 3)))


def js_frames(section: Column) -> Column:
    hits = F.regexp_extract_all(section, F.lit(_JS_FRAME_LINE), F.lit(0))
    return F.transform(hits, lambda l: F.when(l.rlike(rules.JS_FRAME), _frame(l, rules.JS_FRAME, 2, 3, 1))
                       .otherwise(_frame(l, rules.JS_ARROW_FRAME, 1, 2, None)))


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def _first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def _first_line(text: Column, pattern: str) -> Column:
    return X.blank_to_null(F.regexp_extract(text, pattern, 0))


def _last_line(text: Column, pattern: str) -> Column:
    return _last(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _exception(line: Column, pattern: str) -> Column:
    return X.let(line, lambda l: F.when(l.isNotNull(), F.struct(
        F.regexp_extract(l, pattern, 1).alias("type"), X.strip(F.regexp_extract(l, pattern, 2)).alias("message"))))


def python_exception(body: Column) -> Column:
    """Last marked exception line, else the last bare one; summary lines do not count."""
    return F.coalesce(_exception(_last_line(body, _PY_MARKED), _PY_MARKED), _exception(_last_line(body, _PY_BARE), _PY_BARE))


def python_error_site(section: Column) -> Column:
    """Last file:line:ErrorType marker of the section."""
    return X.let(_last_line(section, _PY_SITE), lambda line: F.when(line.isNotNull(), F.struct(
        F.regexp_extract(line, _PY_SITE, 1).alias("file"),
        F.regexp_extract(line, _PY_SITE, 2).cast("bigint").alias("line"),
        F.regexp_extract(line, _PY_SITE, 3).alias("type"))))


def python_summary(log: Column) -> Column:
    """First terminal FAILED/ERROR line of the log."""
    return X.let(_first_line(log, _PY_SUMMARY), lambda line: F.when(line.isNotNull(), F.struct(
        F.regexp_extract(line, _PY_SUMMARY, 1).alias("file"),
        F.regexp_extract(line, _PY_SUMMARY, 2).alias("test"),
        X.blank_to_null(F.regexp_extract(line, _PY_SUMMARY, 3)).alias("type"),
        X.strip(F.regexp_extract(line, _PY_SUMMARY, 4)).alias("message"))))


def js_test_name(section: Column) -> Column:
    """Leaf case name of the block's header line."""
    def name(head: Column) -> Column:
        bullet = F.regexp_extract(head, rules.JS_BULLET, 1)
        return (F.when(head.rlike(rules.JS_FAIL), F.regexp_extract(head, rules.JS_FAIL, 2))
                .when(head.rlike(rules.JS_BULLET) & ~F.lower(bullet).isin(*rules.JS_SUMMARY_BULLETS), bullet))

    return leaf_name(X.let(F.substring_index(section, "\n", 1), name))


def leaf_name(header: Column) -> Column:
    return X.strip(F.element_at(F.split(X.strip(header), rules.JS_SPLIT_NAME), -1))


def js_error(section: Column) -> Column:
    """Named error line, else expected/received, else a bare assertion marker."""
    def label(word: str) -> Column:
        return X.strip(_last(F.regexp_extract_all(section, F.lit(r"(?md)^[ \t]*" + word + r":(.*)$"), F.lit(1))))

    compared = X.let(F.struct(label("Expected").alias("want"), label("Received").alias("got")), lambda p: F.when(
        p["want"].isNotNull() | p["got"].isNotNull(),
        F.struct(F.lit("AssertionError").alias("type"),
                 F.concat(F.lit("expected "), F.coalesce(p["want"], F.lit("None")),
                          F.lit(", received "), F.coalesce(p["got"], F.lit("None"))).alias("message"))))
    return F.coalesce(
        _exception(_first_line(section, _JS_ERROR), _JS_ERROR), compared,
        F.when(X.has_any(section, rules.JS_ASSERTION_MARKERS),
               F.struct(F.lit("AssertionError").alias("type"), F.lit("Assertion failed").alias("message"))))


def _site(file: Column, line: Column) -> Column:
    return F.struct(file.alias("file"), line.alias("line"))


def python_site(error_site: Column, frames: Column, summary: Column) -> Column:
    """Error marker, else the deepest non-test frame, else the deepest frame, else the summary's file."""
    code = _last(F.filter(frames, lambda f: ~X.python_test_path(f["file_path"])))
    deepest = _last(frames)
    return F.coalesce(
        F.when(error_site.isNotNull(), _site(error_site["file"], error_site["line"])),
        F.when(code.isNotNull(), _site(code["file_path"], code["line_number"])),
        F.when(deepest.isNotNull(), _site(deepest["file_path"], deepest["line_number"])),
        F.when(summary.isNotNull(), _site(summary["file"], F.lit(0).cast("bigint"))))


def js_site(frames: Column) -> Column:
    """First non-test frame (innermost comes first), else the first frame."""
    hit = F.coalesce(_first(F.filter(frames, lambda f: ~X.js_test_path(f["file_path"]))), _first(frames))
    return F.when(hit.isNotNull(), _site(hit["file_path"], hit["line_number"]))


def _found(section, frames, test, exc_type, message, file, line) -> Column:
    return F.struct(
        section.alias("section"), frames.cast(FRAME).alias("frames"), X.blank_to_null(test).alias("test"),
        X.blank_to_null(exc_type).alias("exc_type"), F.coalesce(message, F.lit("")).alias("message"),
        file.alias("file"), line.alias("line"))


def _read_python(raw: Column) -> Column:
    def resolve(p: Column) -> Column:
        exc, summary, marker = p["exc"], p["summary"], p["marker"]
        message = F.when(exc.isNotNull(), exc["message"]).when(summary["type"].isNotNull(), summary["message"])
        return X.let(python_site(marker, p["frames"], summary), lambda site: _found(
            p["section"], p["frames"], F.coalesce(banner_name(p["section"]), summary["test"]),
            F.coalesce(exc["type"], summary["type"], marker["type"]), message, site["file"], site["line"]))

    def signals(section: Column) -> Column:
        return F.struct(
            section.alias("section"), python_frames(section).alias("frames"), python_error_site(section).alias("marker"),
            python_summary(raw).alias("summary"),
            F.coalesce(python_exception(section), python_exception(raw)).alias("exc"))

    return X.let(F.element_at(python_sections(raw), 1), lambda section: X.let(signals(section), resolve))


def _js_block(raw: Column) -> Column:
    """What is parsed of a script log or block: without colours, from its first heading to the run's totals."""
    def block(clean: Column) -> Column:
        return X.let(F.element_at(js_sections(clean), 1), lambda head: F.when(
            head.rlike("(?d)^" + _JS_HEAD), X.drop_last_newline(F.element_at(F.split(head, _JS_STOP_AHEAD), 1))).otherwise(clean))

    return X.let(X.ansi_free(raw), block)


def _read_js(raw: Column) -> Column:
    def resolve(p: Column) -> Column:
        section, site = p["section"], js_site(p["frames"])
        return _found(section, p["frames"], js_test_name(section), p["exc"]["type"], p["exc"]["message"],
                      site["file"], site["line"])

    def signals(section: Column) -> Column:
        return F.struct(section.alias("section"), js_frames(section).alias("frames"), js_error(section).alias("exc"))

    return X.let(_js_block(raw), lambda section: X.let(signals(section), resolve))


def _read_cpp(raw: Column) -> Column:
    file, line = F.regexp_extract(raw, rules.CPP_DIAG, 1), F.regexp_extract(raw, rules.CPP_DIAG, 2).cast("bigint")
    frame = F.array(F.struct(file.alias("file_path"), line.alias("line_number"), F.lit("compile").alias("function_name")))
    gtest = _first_line(raw, X.in_text(rules.GTEST))
    ctest = X.blank_to_null(F.regexp_extract(raw, rules.CTEST, 1))
    built = _found(raw, frame, F.lit("c++ build"), F.lit("CompilerError"),
                   X.strip(F.regexp_extract(raw, rules.CPP_DIAG, 5)), file, line)
    failed = _found(raw, F.array().cast(FRAME), F.coalesce(F.regexp_extract(gtest, X.in_text(rules.GTEST), 1), ctest, F.lit("c++ test")),
                    F.lit("AssertionError"), F.lit("C++ test failed"), F.lit(None).cast("string"), F.lit(None).cast("bigint"))
    return F.when(raw.rlike(_CPP_HINT) & raw.rlike(rules.CPP_DIAG), built).otherwise(failed)


@cache
def _reader(session_id: str, text: str, language: str) -> Column:
    """The parse expression over two named columns. Putting it together takes many calls into the
    JVM, so a session builds it once."""
    lang = F.col(language)

    def read(raw: Column) -> Column:
        return F.when(lang == "python", _read_python(raw)).when(lang == "javascript", _read_js(raw)).when(lang == "cpp", _read_cpp(raw))

    return X.let(X.unix_lines(F.col(text)), read)


def parse(df: DataFrame, text: str = "log_text", language: str = "language") -> DataFrame:
    """Add the parsed failure of every row; ``reject_reason`` is set where there is none.

    One expression per row picks the dialect, so a row only pays for its own patterns. The
    result passes through a generator, which keeps later filters from repeating the parse.
    """
    raw, lang = F.coalesce(F.col(text), F.lit("")), F.col(language)
    found = _reader(df.sparkSession.sparkContext.applicationId, text, language)
    df = df.select("*", F.explode(F.array(found)).alias("f"))
    empty = F.regexp_replace(raw, r"\s", "") == ""
    site_counts = (lang == "python") & F.coalesce(F.col("f.file") != "", F.lit(False))
    nothing = F.col("f.test").isNull() & F.col("f.exc_type").isNull() & (F.size("f.frames") == 0) & ~site_counts
    return df.select(
        *[c for c in df.columns if c != "f"], "f.section", "f.frames",
        F.coalesce("f.test", F.lit("unknown_test")).alias("test_name"),
        F.coalesce("f.file", F.lit("")).alias("failing_file"),
        F.coalesce("f.line", F.lit(0)).cast("bigint").alias("failing_line"),
        F.coalesce("f.exc_type", F.when(lang == "javascript", "AssertionError").otherwise("UnknownError")).alias("exception_type"),
        F.col("f.message").alias("exception_message"),
        F.when((lang != "cpp") & empty, "empty log").when((lang != "cpp") & nothing, "no failure identified").alias("reject_reason"))


def first_failures(run_logs: DataFrame) -> DataFrame:
    """One parsed failure per owned log."""
    return parse(first_owned(run_logs)).where("reject_reason is null")


def first_owned(run_logs: DataFrame) -> DataFrame:
    """Logs with their first owner; the generator classifies each log exactly once."""
    return spread(run_logs).withColumn("language", F.explode(F.slice(owned_languages(F.col("log_text")), 1, 1)))


def rejects(run_logs: DataFrame) -> DataFrame:
    """Logs no failure could be read from, with reason and remedy."""
    parsed = parse(first_owned(run_logs)).where("reject_reason is not null").select("log_id", "language", "reject_reason")
    unowned = spread(run_logs).where(F.size(owned_languages(F.col("log_text"))) == 0).select(
        "log_id", F.lit(None).cast("string").alias("language"), F.when(F.regexp_replace("log_text", r"\s", "") == "", "empty log")
        .otherwise("no runner recognised").alias("reject_reason"))
    return parsed.unionByName(unowned).withColumn(
        "remedy", F.when(F.col("reject_reason") == "empty log", "run the suite and pass its combined output")
        .otherwise("check that the log holds a failure section"))


def _readable(raw: Column) -> Column:
    """A script block only fails to parse when what is parsed of it has neither name, error nor frames."""
    return X.let(_js_block(raw), lambda section: (F.coalesce(js_test_name(section), F.lit("")) != "")
                 | js_error(section).isNotNull() | (F.size(js_frames(section)) > 0))


def failure_sections(run_logs: DataFrame, readable_only: bool = False) -> DataFrame:
    """Failure blocks of each log for every runner that claims it, numbered from 1."""
    owned = spread(run_logs).withColumn("language", F.explode(owned_languages(F.col("log_text"))))
    blocks = X.let(X.unix_lines(F.col("log_text")), lambda text: sections(text, F.col("language")))
    if readable_only:
        blocks = F.when(F.col("language") == "javascript", F.filter(blocks, _readable)).otherwise(blocks)
    rest = [c for c in owned.columns if c != "log_text"]
    return (owned.select(*rest, F.posexplode(blocks).alias("pos", "section_text"))
            .withColumn("section_no", (F.col("pos") + 1).cast("bigint")).drop("pos"))


def run_failures(run_logs: DataFrame) -> DataFrame:
    """All failures of each run, numbered per language over the blocks that parse.

    A block under a banner always parses, so only script blocks need the readability test;
    numbering is the position inside the log's own block array and needs no shuffle.
    """
    parsed = parse(failure_sections(run_logs, readable_only=True), text="section_text")
    return (parsed.where("reject_reason is null")
            .withColumn("failure_id", F.concat("language", F.lit("-"), F.col("section_no").cast("string"))))


def collected_nothing(output: Column, language: Column) -> Column:
    low = F.lower(F.coalesce(output, F.lit("")))
    return X.any_of([(language == lang) & X.has_any(low, words) for lang, words in rules.COLLECTED_NOTHING.items()])


def ran_nothing(exit_code: Column, output: Column, language: Column) -> Column:
    low = F.lower(F.coalesce(output, F.lit("")))
    by_code = X.any_of([(language == lang) & exit_code.isin(*codes)
                        for lang, codes in rules.RAN_NOTHING_EXIT.items() if codes])
    by_text = X.any_of([(language == lang) & X.has_any(low, words) for lang, words in rules.RAN_NOTHING_TEXT.items()])
    return by_code | by_text


def scan_status(run_logs: DataFrame, repo_languages: DataFrame | None = None, languages: tuple[str, ...] = rules.LANGUAGES) -> DataFrame:
    """Status of each run seen by each language's runner, with its failure count and excerpt.

    With ``repo_languages`` (repo_id, languages), a run is only seen by its own repository's runners.

    A run without output, without tests or not owned by that runner ends there; the rest is
    failed or unparsed depending on how many of its blocks parse. One short row per run takes
    part in the join, and languages are laid out after it.
    """
    text = F.col("log_text")
    flags = F.array(*[F.struct(F.lit(l).alias("language"), collected_nothing(text, F.lit(l)).alias("empty")) for l in languages])
    runs = spread(run_logs).select("log_id", "repo_id", F.substring(text, 1, rules.SCAN_EXCERPT_CHARS).alias("log_excerpt"),
                                   (F.regexp_replace(text, r"\s", "") == "").alias("blank"), owned_languages(text).alias("owners"), flags.alias("flags"))
    counts = run_failures(run_logs).groupBy("log_id").agg(*[F.count_if(F.col("language") == l).alias(f"n_{l}") for l in languages])
    found = F.array(*[F.coalesce(f"n_{l}", F.lit(0)).cast("bigint") for l in languages])
    joined = runs.join(counts, "log_id", "left").withColumn("found", found).select(
        "log_id", "repo_id", "log_excerpt", "blank", "owners", "found", F.posexplode("flags").alias("p", "f"))
    if repo_languages is not None:
        own = repo_languages.select("repo_id", F.explode("languages").alias("own"))
        joined = joined.join(own, (joined["repo_id"] == own["repo_id"]) & (F.col("f.language") == F.col("own")), "left_semi")
    n = F.get("found", F.col("p"))
    status = (F.when(F.col("blank"), "no_output").when(F.col("f.empty"), "no_tests")
              .when(~F.array_contains("owners", F.col("f.language")), "passed").when(n > 0, "failed").otherwise("unparsed_failure"))
    return joined.select("log_id", "repo_id", F.col("f.language").alias("language"), status.alias("status"), n.alias("n"), "log_excerpt").select(
        "log_id", "repo_id", "language", "status", F.when(F.col("status") == "failed", F.col("n")).otherwise(0).alias("failure_count"), "log_excerpt")


def feedback(text: Column) -> Column:
    """Keep both ends of long output: collection errors lead, the assertion summary trails."""
    half = rules.FEEDBACK_CHARS // 2
    return F.when(F.length(text) <= rules.FEEDBACK_CHARS, text).otherwise(
        F.concat(F.left(text, F.lit(half)), F.lit(rules.TRUNCATION_MARK), F.right(text, F.lit(half))))
