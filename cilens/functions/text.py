"""Column helpers for log and path text. All of them stay inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from cilens import rules

BLANKS = " \t\r\x0b\x0c"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Catalyst inlines plain column references, which would repeat an expensive expression at
    every use; a one-element array keeps it a bound variable.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(col: Column) -> Column:
    """Trim spaces, tabs and stray carriage returns from both ends of one line."""
    return F.btrim(col, F.lit(BLANKS))


def in_text(pattern: str) -> str:
    """A single-line pattern turned into one that scans a whole text line by line.

    Blanks are kept from matching a newline, and blanks around the line are ignored.
    """
    blank = r"[ \t\r\x0B\f]"
    body = re.sub(r"(?<!\[\^)\\s", lambda _: blank, pattern.removeprefix("^"))
    body = re.sub(r"\[\^([\"'`]+)\]", lambda m: f"[^{m.group(1)}\\n]", body)
    if body.endswith("$"):
        body = body[:-1] + blank + "*$"
    return f"(?md)^{blank}*{body}"


def lines(col: Column) -> Column:
    return F.split(col, r"\r\n|\r|\n")


def unix_lines(col: Column) -> Column:
    """A text, null as empty, whose lines all end in a line feed; a lone carriage return ends a line too."""
    text = F.coalesce(col, F.lit(""))
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)


def ansi_free(col: Column) -> Column:
    return F.regexp_replace(F.coalesce(col, F.lit("")), rules.ANSI, "")


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def has_any(col: Column, words) -> Column:
    return any_of([F.contains(col, F.lit(w)) for w in words])


def starts_any(col: Column, words) -> Column:
    return any_of([F.startswith(col, F.lit(w)) for w in words])


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def drop_last_newline(col: Column) -> Column:
    return F.regexp_replace(col, r"\n\z", "")


def slashes(col: Column) -> Column:
    return F.replace(col, F.lit("\\"), F.lit("/"))


def norm_path(col: Column) -> Column:
    return F.lower(slashes(col))


def basename(col: Column) -> Column:
    return F.substring_index(col, "/", -1)


def python_test_path(path: Column) -> Column:
    p = norm_path(path)
    b = basename(p)
    return (F.startswith(b, F.lit("test_")) | F.endswith(b, F.lit("_test.py"))
            | F.contains(p, F.lit("/tests/")) | F.startswith(p, F.lit("tests/")))


def js_test_path(path: Column) -> Column:
    p = norm_path(path)
    b = basename(p)
    return F.contains(b, F.lit(".test.")) | F.contains(b, F.lit(".spec.")) | F.contains(p, F.lit("__tests__/"))


def any_test_path(path: Column) -> Column:
    """The wider reading used to pick the spec file out of a traceback."""
    p = norm_path(path)
    b = basename(p)
    return (F.startswith(b, F.lit("test_")) | F.endswith(b, F.lit("_test.py")) | F.contains(b, F.lit(".test."))
            | F.contains(b, F.lit(".spec.")) | F.contains(p, F.lit("/tests/")) | F.contains(p, F.lit("/__tests__/")))


def vendored(path: Column, extra: tuple[str, ...] = ()) -> Column:
    """Whether any path segment is a dependency or build folder, or one of ``extra``."""
    p = F.regexp_replace(slashes(path), r"^(\./)+", "")
    return F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(seg) for seg in (*rules.VENDORED, *extra)]))


def language_of_path(path: Column) -> Column:
    """First language in fixed order that owns the file's extension."""
    low = F.lower(path)
    out = None
    for lang in rules.LANGUAGES:
        hit = any_of([F.endswith(low, F.lit(e)) for e in rules.EXTENSIONS[lang]])
        out = F.when(hit, lang) if out is None else out.when(hit, lang)
    return out


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4 * 1.15))


def cut_to_budget(text: Column) -> Column:
    return F.when(token_estimate(text) <= rules.TEXT_TOKENS, text).otherwise(F.substring(text, 1, rules.TEXT_CHARS))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)
