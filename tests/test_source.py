"""Symbols and imports whose heads run over several lines, and distances of empty texts."""

import pytest
from pyspark.sql import functions as F

from cilens.operators import retrieval as V, source as S


def test_wrapped_script_heads(spark):
    text = "export const mill = async (\n  grain,\n  stone\n) => {\n  grind(grain);\n};\n\nit(\n  'turns with the wind',\n  () => {\n    spin(1);\n  });\nconst plain = (a) => a;\nconst n = (1 + 2);\n"
    rows = S.script_symbols(spark.createDataFrame([("r", "a.ts", text)], "repo_id string, file_path string, content string")).collect()
    assert sorted((r.name, r.start_line, r.end_line, r.calls, r.is_test) for r in rows) == [
        ("mill", 1, 6, ["async", "grind"], False), ("plain", 13, 14, [], False), ("turns with the wind", 8, 12, ["spin"], True)]
    assert next(r.code for r in rows if r.name == "mill").startswith("export const mill = async (\n  grain,")


@pytest.mark.parametrize("text, names", [
    ("from pkg import (\n    a,  # one, two\n    b as c,\n)\nimport os, sys as s\n", ["os", "pkg.a", "pkg.b", "sys"]),
    ("from .near import x\nfrom pkg import(a)\n", ["near.x", "pkg.a"]),
])
def test_wrapped_python_imports(spark, text, names):
    assert spark.range(1).select(S.python_imports(F.lit(text)).alias("i")).first().i == names


def test_wrapped_script_imports(spark):
    text = "import {\n  a,\n  b\n} from './mod';\nimport d, { e } from \"x\";\nimport './side';\nimport * as z from `tick`;\nconst q = require('lib');\n"
    assert spark.range(1).select(S.script_imports(F.lit(text)).alias("i")).first().i == ["./mod", "./side", "lib", "tick", "x"]


def test_chunk_code_is_the_symbol_s_source(spark):
    text = "def a(x):\n    return b(x)\n\nclass K:\n    def m(self):\n        pass\n"
    rows = S.python_symbols(spark.createDataFrame([("r", "a.py", text)], "repo_id string, file_path string, content string")).collect()
    assert {r.name: r.code for r in rows} == {"a": "def a(x):\n    return b(x)", "K": "class K:\n    def m(self):\n        pass", "m": "    def m(self):\n        pass"}


def test_distance_of_empty_texts(spark):
    items = spark.createDataFrame([(1, "p", "abc"), (2, "p", "")], "item_id bigint, part string, text string").select("item_id", "part", V.hash_counts(F.col("text")).alias("vec"))
    asked = spark.createDataFrame([(1, "p", "abc"), (2, "p", "")], "query_id bigint, part string, text string").select("query_id", "part", V.hash_counts(F.col("text")).alias("vec"))
    found = {(r.query_id, r.item_id): round(r.cost, 9) for r in V.nearest_hashed(items, asked, 2).collect()}
    assert found == {(1, 1): 0.0, (1, 2): 1.0, (2, 1): 1.0, (2, 2): 0.0}


def test_keyword_hits_stay_in_their_repository(spark):
    items = spark.createDataFrame([(1, "r", "red fish", "n"), (2, "s", "red red fish", "n")], "item_id bigint, repo_id string, code string, name string")
    asked = spark.createDataFrame([(7, "r", "red fish"), (8, "t", "red")], "query_id bigint, repo_id string, text string")
    assert [(r.query_id, r.item_id, r.score) for r in V.keyword_hits(items, asked).collect()] == [(7, 1, 2)]


def symbols(spark, read, path, text):
    return [r for r in read(spark.createDataFrame([("r", path, text)], "repo_id string, file_path string, content string")).collect()]


PYTHON = '''import os
"""def ghost():
    pass
"""
@app.route(make("/x"))
def outer(a, b=default(1)):
    """A text with
def ghost(x):
    """
    # def late(): call()
    text = 'def no(): ' + f(
  other(2),
)
    def inner():
        return deep("x(")

    if a:
        def hidden():
            lost()
            def below(): pass
    return last()  # trailing()

# after

class Box(Base):
    size = count()
    def get(self): return self.peek()

    class In:
        async def go(self):
            await run()
if True:
    def unseen(): pass
def tail():
    x = """
  end"""
'''


def test_python_strings_comments_continuations_and_conditions(spark):
    rows = {r.qualified: (r.symbol_type, r.start_line, r.end_line, r.calls) for r in symbols(spark, S.python_symbols, "a.py", PYTHON)}
    assert rows == {
        "outer": ("function", 6, 21, ["default", "f", "last", "make", "other", "route"]), "outer.inner": ("method", 14, 15, ["deep"]),
        "Box": ("class", 25, 31, []), "Box.get": ("method", 27, 27, ["peek"]), "Box.In": ("class", 29, 31, []), "Box.In.go": ("method", 30, 31, ["run"]),
        "tail": ("function", 34, 36, [])}


def test_python_symbols_against_the_grammar(spark):
    import ast

    import cilens.operators.localize as sample

    with open(sample.__file__) as file:
        text = file.read()
    want = []

    def visit(body, scope):
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.ClassDef)):
                want.append((".".join([*scope, node.name]), node.lineno, node.end_lineno))
                visit(node.body, [*scope, node.name])

    visit(ast.parse(text).body, [])
    assert sorted((r.qualified, r.start_line, r.end_line) for r in symbols(spark, S.python_symbols, "a.py", text)) == sorted(want)


def test_a_long_file_takes_linear_time(spark):
    import time

    text = "class K:\n" + "".join(f"    def m{k}(self):\n        return f{k}('''\n    def no():\n''')\n" for k in range(25_000))
    start = time.perf_counter()
    assert len(S._python_file("k.py", text)) == 25_001
    assert len(S._cpp_file("k.cpp", "".join(f"int f{k}(int x) {{\n  g(x); {{ }}\n  return '}}';\n}}\n" for k in range(25_000)))) == 25_000
    assert len(S._script_file("k.ts", "".join(f"function f{k}(x) {{\n  return `function g(`;\n}}\n// function h(\n" for k in range(25_000)))) == 25_000
    assert time.perf_counter() - start < 10


def test_scripts_and_c_without_comments_and_strings(spark):
    text = "/* function a() {} */\nfunction b() {\n  // it('no', x)\n  return c('function d() {', /['\"(]/, `e()`);\n}\nit('has \"quotes\"', () => {});\n"
    assert [(r.name, r.start_line, r.end_line, r.calls) for r in symbols(spark, S.script_symbols, "a.ts", text)] == [("b", 2, 5, ["b", "c"]), ('has "quotes"', 6, 6, [])]
    text = 'int f(int x) {\n  puts("}"); // }\n  return g(x);\n}\n/* int no(int x) { */\nTEST(A, B)\n{\n  h();\n}\n'
    assert [(r.name, r.start_line, r.end_line, r.calls) for r in symbols(spark, S.cpp_symbols, "a.cpp", text)] == [("f", 1, 4, ["f", "g", "puts"]), ("A.B", 6, 9, ["h"])]


@pytest.mark.parametrize("text, names", [
    ("from m import (  # see f()\n a,\n b)\n", ["m.a", "m.b"]),
    ("from m import a, \\\n b\nimport os; import sys\n", ["m.a", "m.b", "os", "sys"]),
    ("if x:\n    import no\n'''\nimport never\n'''\nfrom . import near\nfrom ..up.on import *\nimport a.b as c\n", ["a.b", "near", "up.on.*"]),
    ("import os\r\nimport sys\r", ["os", "sys"]), ("", []), (None, []),
])
def test_python_imports_read_statements(spark, text, names):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(S.python_imports(F.col("t")).alias("i")).first().i == names


def test_script_imports_skip_comments(spark):
    text = "import {\n  a, // } old\n  b\n} from './m'\n// import x from 'no'\n/* require('no') */ const q = require('yes')\n"
    assert spark.createDataFrame([(text,)], "t string").select(S.script_imports(F.col("t")).alias("i")).first().i == ["./m", "yes"]


@pytest.mark.parametrize("text, fault", [
    ("([)]", ("unexpected ')'", 1)), ("a\n{ (\n}\n)", ("unexpected '}'", 3)), ("f(')', \")\")", None), ("x = 'it", ("unterminated string", 1)),
    ("(\n'a\\'\nb", ("unterminated string", 3)), ("{\n (\n [] ", ("missing ')'", 2)), (")", ("unexpected ')'", 1)), ("'a\\\n\nb' (", ("missing ')'", 3)),
    ("", None), (None, None), ("`\n`)\n'", ("unexpected ')'", 2)), ("'\\", ("unterminated string", 1)), ("(" * 50_000 + ")" * 50_000, None),
])
def test_first_bracket_fault(spark, text, fault):
    assert S.first_fault(text) == fault
