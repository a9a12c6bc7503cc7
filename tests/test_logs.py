"""Log dialects on small hand-made logs."""

import pytest
from pyspark.sql import functions as F

from cilens.operators import logs as L

PYTEST = """collected 31 items / 2 deselected

==== FAILURES ====
____________ test_tide_table_for_leap_day ____________

    def test_tide_table_for_leap_day():
>       rows = harbour.tides("2024-02-29")

checks/test_harbour.py:41: in test_tide_table_for_leap_day
    rows = harbour.tides("2024-02-29")
harbour/almanac.py:118: in tides
    return [self.level(h) for h in hours(day)]
harbour/almanac.py:77: in level
    return self.phase[day.timetuple().tm_yday]
E   IndexError: list index out of range

harbour/almanac.py:77: IndexError
==== short test summary info ====
FAILED checks/test_harbour.py::test_tide_table_for_leap_day - IndexError: list index out of range
"""

JEST = """ FAIL  lib/__tests__/kiln.test.js
  ● Console

    console.warn pilot light is off

  ● kiln schedule › cools before opening the door

    expect(received).toEqual(expected)

    Expected: "closed"
    Received: "open"

      at Object.toEqual (lib/__tests__/kiln.test.js:57:31)
      at nextStep (lib/schedule.js:203:11)

Test Suites: 1 failed, 6 passed, 7 total
"""

VITEST_LINES = (" FAIL  spec/orbit.spec.ts > orbit > keeps its period", "RangeError: eccentricity must stay below 1", " ❯ spec/orbit.spec.ts:19:7", " ❯ src/kepler.ts:88:15")
VITEST = "\x1b[31m" + VITEST_LINES[0] + "\x1b[39m\n" + "\n".join(VITEST_LINES[1:]) + "\n RUN  v2.1.4\n"
COLOURED = "".join(f"\x1b[1m\x1b[31m{line}\x1b[39m\x1b[22m\n" for line in VITEST_LINES) + "\x1b[36m RUN  v2.1.4\x1b[39m\n"
CPP = "ninja: entering directory\nengine/valve.cc:310:22: error: no member named 'bleed' in 'Valve'\n"
TWO = "=== FAILURES ===\n____ test_loom ____\nweave/loom.py:14: in thread\nE  LookupError: warp\n____ test_shuttle[wool-3] ____\nweave/shuttle.py:6: in throw\nOSError: jammed\n"


def parsed(spark, *texts):
    logs = spark.createDataFrame([(i, "r", t) for i, t in enumerate(texts)], "log_id bigint, repo_id string, log_text string")
    return logs, {r.log_id: r for r in L.first_failures(logs).collect()}


def test_pytest_log(spark):
    _, rows = parsed(spark, PYTEST)
    row = rows[0]
    assert (row.test_name, row.exception_type, row.exception_message) == ("test_tide_table_for_leap_day", "IndexError", "list index out of range")
    assert (row.failing_file, row.failing_line) == ("harbour/almanac.py", 77)
    assert [f.function_name for f in row.frames] == ["test_tide_table_for_leap_day", "tides", "level"]


def test_jest_log(spark):
    _, rows = parsed(spark, JEST)
    row = rows[0]
    assert (row.language, row.test_name) == ("javascript", "cools before opening the door")
    assert row.exception_message == 'expected "closed", received "open"'
    assert (row.failing_file, row.failing_line) == ("lib/schedule.js", 203)
    assert "Test Suites" not in row.section


def test_vitest_log_with_colours(spark):
    _, rows = parsed(spark, VITEST)
    row = rows[0]
    assert (row.test_name, row.exception_type) == ("keeps its period", "RangeError")
    assert (row.failing_file, row.failing_line) == ("src/kepler.ts", 88)


def test_log_coloured_on_every_line_keeps_its_failure(spark):
    logs, rows = parsed(spark, COLOURED)
    assert (rows[0].test_name, rows[0].failing_line) == ("keeps its period", 88)
    assert [(r.failure_id, r.test_name) for r in L.run_failures(logs).collect()] == [("javascript-1", "keeps its period")]
    assert {r.status for r in L.scan_status(logs).where("language = 'javascript'").collect()} == {"failed"}


def test_lone_carriage_returns_and_other_line_ends(spark):
    plain = "=== FAILURES ===\n____ test_a ____\nE   KeyError: k\nprogress 10%\nmill.py:3: KeyError\n"
    _, rows = parsed(spark, plain, plain.replace("\nprogress", "\rprogress"), plain.replace("\n", "\r\n"), plain.replace("\n", "\r"))
    assert {(r.test_name, r.exception_type, r.exception_message, r.failing_line) for r in rows.values()} == {("test_a", "KeyError", "k", 3)} and len(rows) == 4


def test_runs_are_seen_by_their_repository_s_languages(spark):
    logs, _ = parsed(spark, TWO)
    own = spark.createDataFrame([("r", ["python", "javascript"]), ("s", ["cpp"])], "repo_id string, languages array<string>")
    assert {(r.language, r.status) for r in L.scan_status(logs, own).collect()} == {("python", "failed"), ("javascript", "passed")}


def test_compiler_log(spark):
    _, rows = parsed(spark, CPP)
    assert (rows[0].test_name, rows[0].exception_type, rows[0].failing_file, rows[0].failing_line) == ("c++ build", "CompilerError", "engine/valve.cc", 310)


def test_native_traceback_without_marker_takes_deepest_code_frame(spark):
    text = 'Traceback (most recent call last)\n  File "/w/src/a.py", line 3, in run\n  File "tests/test_a.py", line 9, in test_a\nTypeError: boom\n'
    _, rows = parsed(spark, text)
    assert (rows[0].failing_file, rows[0].failing_line, rows[0].exception_type) == ("/w/src/a.py", 3, "TypeError")


def test_unicode_test_names(spark):
    _, rows = parsed(spark, "=== FAILURES ===\n____ test_größe ____\nE   KeyError: ß\n")
    assert (rows[0].test_name, rows[0].exception_message) == ("test_größe", "ß")


def test_sections_are_numbered_per_run(spark):
    logs, _ = parsed(spark, TWO, JEST)
    found = {(r.log_id, r.failure_id): r.test_name for r in L.run_failures(logs).collect()}
    assert found == {(0, "python-1"): "test_loom", (0, "python-2"): "test_shuttle[wool-3]", (1, "javascript-1"): "cools before opening the door"}


def test_rejects_and_statuses(spark):
    logs, rows = parsed(spark, "=== FAILURES ===\nnothing else", "", "all good", "collected 0 items")
    assert rows == {}
    reasons = {r.log_id: r.reject_reason for r in L.rejects(logs).collect()}
    assert reasons == {0: "no failure identified", 1: "empty log", 2: "no runner recognised", 3: "no runner recognised"}
    status = {(r.log_id, r.language): r.status for r in L.scan_status(logs).collect()}
    assert status[(0, "python")] == "unparsed_failure"
    assert status[(1, "cpp")] == "no_output"
    assert status[(2, "python")] == "passed"
    assert status[(3, "python")] == "no_tests" and status[(3, "javascript")] == "passed"


@pytest.mark.parametrize("text, language", [("FAILED a.py::t - x", "python"), ("[  FAILED  ] Suite.Case", "cpp"), ("● only bullet a.ts:3", "javascript"), ("x\n● bullet a.ts:3", None)])
def test_runner_classification(spark, text, language):
    assert spark.range(1).select(L.runner_language(F.lit(text)).alias("l")).first().l == language


def test_feedback_keeps_both_ends(spark):
    long = "a" * 3000 + "b" * 3000
    out = spark.range(1).select(L.feedback(F.lit(long)).alias("f")).first().f
    assert out.startswith("a" * 2000 + "\n...\n[truncated]") and out.endswith("b" * 2000) and len(out) == 4000 + len("\n...\n[truncated]\n...\n")
