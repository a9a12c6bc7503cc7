"""Symbols, imports and bracket checks out of source text.

One file is one row, read in Arrow batches, and files are never cut apart and shuffled. A file is first reduced to its
code: comments go, strings shrink to their quotes, and ends of lines inside strings or after a backslash become a mark,
so that what is left of a line is code and nothing else. One pass over these lines with a stack of open blocks then
finds everything; work is linear in the lines of a file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cilens import rules

_JOIN = "\x1f"  # an end of line that ends no statement
_LINE_END = re.compile(r"\r\n?")
_PY_LEX = re.compile(r"""(?s)#[^\n]*|\\\n|(\"\"\"|''')(?:[^\\]|\\.)*?(?:\1|\Z)|"(?:[^"\\\n]|\\.)*+(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*+(?:'|(?=\n)|\Z)""")
_C_LEX = re.compile(r"""(?s)//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*+(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*+(?:'|(?=\n)|\Z)""")
# scripts also have templates, and expressions between slashes where a value may start
_JS_LEX = re.compile(r"(?s)(?<=[(,=:\[!&|?{};])[ \t]*/(?![/*])(?:[^\\/\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/|`(?:[^`\\]|\\.)*+(?:`|\Z)|" + _C_LEX.pattern.removeprefix("(?s)"))
_PY_HEAD = re.compile(rules.PY_DEF)
_PY_CALL = re.compile(r"([^\W\d]\w*)\s*\(")
_JS_FUNCTION, _JS_ARROW = (re.compile("(?m)" + p.replace(r"^\s*", r"^[ \t]*", 1)) for p in (rules.JS_FUNCTION, rules.JS_ARROW))
_JS_TEST = re.compile(rules.JS_TEST_CALL)
_JS_CALLS = re.compile(r"\b" + rules.JS_CALL)
_CPP_TEST, _CPP_FUNCTION, _CPP_CALLS = re.compile(rules.CPP_TEST_MACRO), re.compile(rules.CPP_FUNCTION), re.compile(r"\b" + rules.CPP_CALL)

#: name, qualified name, kind, first and last line, called names, whether it is a test
Symbol = tuple[str, str, str, int, int, list[str], bool]
_SYMBOLS = ("repo_id string, file_path string, name string, qualified string, symbol_type string, start_line bigint, end_line bigint, "
            "calls array<string>, is_test boolean, symbol_id string, code string")


def _unix(text: str | None) -> str:
    return _LINE_END.sub("\n", text or "")


def _python_code(text: str) -> str:
    def keep(m: re.Match) -> str:
        found = m.group()
        if found[0] == "#":
            return ""
        return _JOIN if found[0] == "\\" else f'"{_JOIN * found.count(chr(10))}"'

    return _PY_LEX.sub(keep, text.replace(_JOIN, " "))


def _blanked(lex: re.Pattern, text: str) -> str:
    """The text with comments and what is inside quotes turned into blanks, place by place."""
    def keep(m: re.Match) -> str:
        found = m.group()
        bare = re.sub(r"[^\n]", " ", found)
        return found[0] + bare[1:-1] + found[-1] if found[0] in "\"'`" and len(found) > 1 else bare

    return lex.sub(keep, text)


def _statements(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(first line, last line, indent, code) of each line of code; indent is -1 where a statement goes on."""
    depth, line = 0, 1
    for part in _python_code(text).split("\n"):
        size = part.count(_JOIN)
        code = part.replace(_JOIN, " ")
        if code.strip():
            wide = code.expandtabs(8)
            yield line, line + size, -1 if depth else len(wide) - len(wide.lstrip()), code
            depth = max(0, depth + sum(map(code.count, "([{")) - sum(map(code.count, ")]}")))
        line += 1 + size


def _python_file(path: str, text: str) -> list[Symbol]:
    base = path.replace("\\", "/").rsplit("/", 1)[-1]
    test_file = base.startswith("test_") or base.endswith("_test.py")
    found: list[dict] = []
    blocks: list[dict] = []  # open blocks: indent, indent of the body, the symbol or None, whether it owns calls
    body, last, owner, pending = None, 0, None, []

    def close(indent: int) -> None:
        while blocks and indent <= blocks[-1]["indent"]:
            if (symbol := blocks.pop()["symbol"]) is not None:
                symbol["end"] = last

    for first, end, indent, code in _statements(text):
        if indent >= 0:
            close(indent)
            top = blocks[-1] if blocks else None
            if top is None:
                body = indent if body is None else body
            elif top["body"] is None:
                top["body"] = indent
            # a definition counts where it stands in the body of another one or of the file, not below a condition or loop
            direct = indent == (body if top is None else top["body"]) and (top is None or top["symbol"] is not None)
            head = _PY_HEAD.match(code)
            if head:
                symbol = None
                if direct:
                    scope = [b["symbol"]["name"] for b in blocks]
                    symbol = {"name": head[3], "scope": scope, "kind": head[2], "start": first, "end": end, "calls": set()}
                    found.append(symbol)
                owner = symbol if head[2] == "def" else None
                if owner is not None:
                    owner["calls"].update(pending)
                blocks.append({"indent": indent, "body": None, "symbol": symbol, "owner": owner})
                code = code[head.end():]
            else:
                owner = top["owner"] if top else None
            decorator = code.lstrip().startswith("@")
            pending = pending if decorator else []
        names = [c for c in _PY_CALL.findall(code) if c not in rules.PY_CALL_SKIP]
        if decorator:
            pending += names
        elif owner is not None:
            owner["calls"].update(names)
        last = end
    close(-1)
    out = []
    for s in found:
        test = test_file or s["name"].startswith(("test_", "Test"))
        kind = "test" if test else "class" if s["kind"] == "class" else "method" if s["scope"] else "function"
        out.append((s["name"], ".".join([*s["scope"], s["name"]]), kind, s["start"], s["end"], sorted(s["calls"]), test))
    return out


def _script_file(path: str, text: str) -> list[Symbol]:
    flat, code = path.replace("\\", "/").lower(), _blanked(_JS_LEX, text)
    base = flat.rsplit("/", 1)[-1]
    test_file = ".test." in base or ".spec." in base or "__tests__/" in flat
    heads = [(m.start(), 0, m[1], False) for p in (_JS_FUNCTION, _JS_ARROW) for m in p.finditer(code)]
    heads += [(m.start(), 1, text[m.start(1):m.end(1)], True) for m in _JS_TEST.finditer(code)]
    lines, starts, at = text.split("\n"), [], 0
    for offset, order, name, test in sorted(heads, key=lambda h: h[:2]):
        at = starts[-1][0] + code.count("\n", starts[-1][1], offset) if starts else 1 + code.count("\n", 0, offset)
        starts.append((at, offset, name, test))
    out, bare = [], code.split("\n")
    for k, (at, _, name, test) in enumerate(starts):
        end = max(at, starts[k + 1][0] - 1) if k + 1 < len(starts) else len(lines)
        while end > at and not lines[end - 1].strip(" \t\r\x0b\x0c"):
            end -= 1
        calls = sorted({c for c in _JS_CALLS.findall("\n".join(bare[at - 1:end])) if c not in rules.JS_CALL_SKIP})
        test = test or test_file
        out.append((name, name, "test" if test else "function", at, end, calls, test))
    return out


def _cpp_file(path: str, text: str) -> list[Symbol]:
    lines, code = text.split("\n"), _blanked(_C_LEX, text).split("\n")
    found, open_heads, depth = [], [], 0
    for k, line in enumerate(code):
        test, function = _CPP_TEST.match(line), _CPP_FUNCTION.match(line)
        if test or function:
            if test:
                inside = re.search(r"\((.*)\)", lines[k])
                parts = [p for p in (p.strip(" ").strip('"') for p in (inside[1].split(",") if inside else [])) if p]
                name = ".".join(parts[:2]) or "cpp_test"
            else:
                name = function[1].rsplit("::", 1)[-1]
            head = {"name": name, "test": bool(test) or name.lower().startswith("test"), "start": k + 1, "end": k + 1, "depth": depth, "open": False}
            found.append(head)
            open_heads.append(head)
        depth += line.count("{") - line.count("}")
        for head in open_heads:
            head["open"] |= "{" in line
            if head["open"] and depth <= head["depth"]:
                head["end"], head["depth"] = k + 1, None
        open_heads = [h for h in open_heads if h["depth"] is not None]
    out = []
    for h in found:
        calls = sorted({c for c in _CPP_CALLS.findall("\n".join(code[h["start"] - 1:h["end"]])) if c not in rules.CPP_CALL_SKIP})
        out.append((h["name"], h["name"], "test" if h["test"] else "function", h["start"], h["end"], calls, h["test"]))
    return out


def _symbols(read: Callable[[str, str], list[Symbol]], schema: pa.Schema, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in schema]
        for repo, path, content in zip(*(c.to_pylist() for c in batch.columns)):
            text = _unix(content)
            lines = text.split("\n")
            for name, qualified, kind, start, end, calls, test in read(path or "", text):
                row = (repo, path, name, qualified, kind, start, end, calls, test, f"{path or ''}::{qualified}", "\n".join(lines[start - 1:end]))
                for column, value in zip(columns, row):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _emit(files: DataFrame, read: Callable[[str, str], list[Symbol]]) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(_SYMBOLS))
    return files.select("repo_id", "file_path", "content").mapInArrow(partial(_symbols, read, schema), _SYMBOLS)


def python_symbols(files: DataFrame) -> DataFrame:
    """Functions, methods and classes that stand in the body of the file or of another one, with their lines of source.

    A block runs to its last line of code. Its scope is every definition around it. Calls, those of decorators and
    defaults included, belong to the innermost definition; classes, and definitions below a condition or loop, own none.
    """
    return _emit(files, _python_file)


def script_symbols(files: DataFrame) -> DataFrame:
    """JavaScript functions, arrow constants and test blocks; the next one ends the span."""
    return _emit(files, _script_file)


def cpp_symbols(files: DataFrame) -> DataFrame:
    """C-family definitions and test macros; the span ends where braces balance again."""
    return _emit(files, _cpp_file)


def _python_imports(text: str | None) -> list[str]:
    names, whole = set(), []

    def take() -> None:
        for part in " ".join(whole).split(";"):
            if plain := re.match(r"\s*import\s+(.+)", part):
                module, listed = "", plain[1]
            elif member := re.match(r"\s*from\s*(\.*)\s*([\w.]*)\s*\bimport\b(.+)", part):
                module, listed = member[2], member[3]
            else:
                continue
            for name in re.sub(r"[()]", " ", listed).split(","):
                if words := name.split():
                    names.add(f"{module}.{words[0]}" if module else words[0])

    for _, _, indent, code in _statements(_unix(text)):
        if indent >= 0:
            take()
            whole = [code] if indent == 0 else []
        elif whole:
            whole.append(code)
    take()
    return sorted(names)


def python_imports(content: Column) -> Column:
    """Names bound by imports in the body of the file, as module or module.name, sorted and distinct."""
    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(_python_imports)

    return found(content)


_IMPORT = re.compile(r"""(?m)^[ \t]*import\b(?:[^'"`\n{]*\{[^}'"`]*\})?[^'"`\n{]*(['"`])([^'"`\n]+)['"`]""")
_REQUIRE = re.compile(r"""\brequire\s*\(\s*(['"`])([^'"`]+)['"`]""")


def _script_imports(text: str | None) -> list[str]:
    text = _unix(text)
    code = _blanked(_JS_LEX, text)
    return sorted({text[m.start(2):m.end(2)] for p in (_IMPORT, _REQUIRE) for m in p.finditer(code)})


def script_imports(content: Column) -> Column:
    """Module names in import statements and require calls, sorted and distinct; those in comments are none."""
    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(_script_imports)

    return found(content)


# a string takes in escaped characters, also the first one after a line end; group 1 is missing where it does not end
_MARK = re.compile(r"""[()\[\]{}]|'(?:[^'\\]|\\\n*[^\n])*+(')?|"(?:[^"\\]|\\\n*[^\n])*+(")?|`(?:[^`\\]|\\\n*[^\n])*+(`)?""")
_CLOSER = {"(": ")", "[": "]", "{": "}"}


def first_fault(source: str | None) -> tuple[str, int] | None:
    """The first bracket that closes what is not open, else a string without end, else the innermost open bracket."""
    lines = (source or "").splitlines()
    text, stack = "\n".join(lines), []
    line_of = lambda at: text.count("\n", 0, at) + 1
    for m in _MARK.finditer(text):
        mark = m.group()
        if mark in _CLOSER:
            stack.append((mark, m.start()))
        elif mark[0] in "\"'`":
            if m.lastindex is None:
                return "unterminated string", len(lines) or 1
        elif not stack or _CLOSER[stack.pop()[0]] != mark:
            return f"unexpected '{mark}'", line_of(m.start())
    return (f"missing '{_CLOSER[stack[-1][0]]}'", line_of(stack[-1][1])) if stack else None


def bracket_fault(source: Column) -> Column:
    """(message, line) of the first fault of a text, null where there is none."""
    @F.pandas_udf("message string, line bigint")
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([first_fault(t) or (None, None) for t in texts], columns=["message", "line"]).astype({"line": "Int64"})

    return found(source)


def bracket_issues(source: Column) -> Column:
    """Per bracket kind: closed too early or left open, once strings are taken out.

    Kinds are counted on their own: a summary for counts over many texts. ``bracket_fault`` tells where a text goes wrong.
    """
    flat = F.replace(source, F.lit("\n"), F.lit(""))
    bare = F.regexp_replace(flat, r"""'[^'\\]*(?:\\.[^'\\]*)*(?:'|$)|"[^"\\]*(?:\\.[^"\\]*)*(?:"|$)|`[^`\\]*(?:\\.[^`\\]*)*(?:`|$)""", "")
    marks = F.split(F.regexp_replace(bare, r"[^()\[\]{}]", ""), "")

    def scan(opening: str, closing: str) -> Column:
        def step(s: Column, c: Column) -> Column:
            depth = s["depth"] + F.when(c == opening, 1).when(c == closing, -1).otherwise(0)
            return F.struct(depth.alias("depth"), F.least(s["low"], depth).alias("low"))

        return F.aggregate(marks, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")), step)

    return F.struct(*[F.struct((s["low"] < 0).alias("early"), (s["depth"] > 0).alias("open")).alias(name)
                      for name, s in (("round", scan("(", ")")), ("square", scan("[", "]")), ("curly", scan("{", "}")))])
