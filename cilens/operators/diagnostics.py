"""Checker diagnostics: own-source filter, gate choice and before/after comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cilens import rules
from cilens.functions import text as X


def identity():
    """What makes a diagnostic the same after lines have moved: file name, code and message."""
    return F.concat_ws("::", X.basename(F.col("file_path")), "code", "message")


def describe():
    return F.concat("file_path", F.lit(":"), F.col("line").cast("string"),
                    F.when(F.col("code") != "", F.concat(F.lit(" ["), F.col("code"), F.lit("]"))).otherwise(""),
                    F.lit(" "), "message")


def own_source(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.where(~X.vendored(F.col("file_path")))


def fixable():
    return (F.col("code") != "") & (F.col("fix_applicability") == "safe")


def _standing():
    """Place of a gate in the order of choice: higher precedence first, then fixed order."""
    ranked = sorted(rules.GATES, key=lambda g: (-g[1], g[2]))
    out = F.lit(len(ranked))
    for place, (name, _, _) in enumerate(ranked):
        out = F.when(F.col("gate") == name, place).otherwise(out)
    return out


def select_gate(diagnostics: DataFrame) -> DataFrame:
    """Per repository the most conclusive gate with an own-source diagnostic, and its first one.

    One aggregate with a map-side combine; a repository with a third of all rows is fine.
    """
    target = F.min(F.struct(_standing().alias("place"), "ord", "gate", "file_path", "line", "code", "message")).alias("t")
    return own_source(diagnostics).groupBy("repo_id").agg(target).select(
        "repo_id", "t.gate", F.col("t.ord").alias("target_ord"), "t.file_path", "t.line", "t.code", "t.message")


def gate_by_repo(diagnostics: DataFrame, repos: DataFrame) -> DataFrame:
    """Every repository with its gate, ``clean`` where no gate reports anything."""
    return repos.join(select_gate(diagnostics), "repo_id", "left").select(
        "repo_id", F.coalesce("gate", F.lit("clean")).alias("gate"), F.coalesce("target_ord", F.lit(-1)).alias("target_ord"))


def gate_failures(diagnostics: DataFrame) -> DataFrame:
    """A failure built from each repository's gate: its first rows described, one target."""
    chosen = select_gate(diagnostics)
    order = Window.partitionBy("repo_id").orderBy("ord")
    rows = (own_source(diagnostics).join(chosen.select("repo_id", "gate"), ["repo_id", "gate"], "left_semi")
            .select("repo_id", "ord", describe().alias("text"))
            .withColumn("n", F.row_number().over(order)).where(F.col("n") <= rules.GATE_TRACE_ROWS))
    trace = rows.groupBy("repo_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("raw_traceback"))
    return chosen.join(trace, "repo_id").select(
        "repo_id", F.concat("gate", F.lit(" check")).alias("test_name"), F.col("file_path").alias("failing_file"),
        F.col("line").alias("failing_line"), F.when(F.col("code") != "", F.col("code")).otherwise("Diagnostic").alias("exception_type"),
        F.col("message").alias("exception_message"), "raw_traceback", "gate")


def diagnostic_suspects(unlocalized: DataFrame, known_paths: DataFrame) -> DataFrame:
    """Suspect taken from the gate's own report, for failures without candidates whose reported
    file exists. ``unlocalized`` are gate failures; ``known_paths`` has repo_id, file_path."""
    f = unlocalized.join(known_paths.select("repo_id", F.col("file_path").alias("failing_file")).distinct(), ["repo_id", "failing_file"], "left_semi")
    return f.select("repo_id", F.concat("failing_file", F.lit("::<file>")).alias("symbol_id"),
                    X.basename(F.col("failing_file")).alias("name"), F.lit(1).cast("bigint").alias("rank"),
                    F.lit("diagnostic").alias("ranking_source"),
                    F.concat("gate", F.lit(" diagnostic at line "), F.col("failing_line").cast("string")).alias("evidence"))


def identities(diagnostics: DataFrame) -> DataFrame:
    """Per repository, gate and identity: how many rows before and after the patch."""
    return own_source(diagnostics).groupBy("repo_id", "gate", identity().alias("identity")).agg(
        F.count_if(F.col("phase") == "baseline").alias("baseline_rows"), F.count_if(F.col("phase") == "after").alias("after_rows"))


def _compared(diagnostics: DataFrame, targets: DataFrame) -> DataFrame:
    """Both anti-joins, introduced and resolved, read off one grouping by identity. ``targets`` has repo_id, gate, target."""
    sides = identities(diagnostics).join(targets, ["repo_id", "gate"])
    return sides.groupBy("repo_id", "gate", "target").agg(
        F.coalesce(F.sum(F.when(F.col("baseline_rows") == 0, F.col("after_rows"))), F.lit(0)).alias("introduced"),
        F.coalesce(F.sum("after_rows"), F.lit(0)).alias("remaining"),
        (~F.bool_or((F.col("identity") == F.col("target")) & (F.col("after_rows") > 0))).alias("resolved"),
    ).withColumn("passed", F.col("resolved") & (F.col("introduced") == 0))


def compare(diagnostics: DataFrame) -> DataFrame:
    """Verdict per repository on its chosen gate: the target is gone and nothing is new."""
    return _compared(diagnostics, select_gate(diagnostics.where("phase = 'baseline'")).select("repo_id", "gate", identity().alias("target")))


def verdicts(asked: DataFrame, runs: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(repo_id, oracle_name, exit_code, passed): what each repository's oracle says of its patch.

    asked: repo_id, oracle_name; runs: repo_id, ts, run_no, exit_code. The oracle named ``rules.TEST_ORACLE`` passes if the
    newest run of the repository's tests ended with code 0. One named ``rules.GATE_ORACLE`` and a gate passes if the first
    problem that the gate reported before is gone and the gate reports no new one. Without a run, without a code or without
    an earlier problem nothing is proved, and another name proves nothing: not passed.
    """
    newest = runs.groupBy("repo_id").agg(F.max_by("exit_code", F.struct("ts", "run_no")).alias("exit_code"))
    first = own_source(diagnostics.where("phase = 'baseline'")).groupBy("repo_id", "gate").agg(F.min_by(identity(), "ord").alias("target"))
    gates = _compared(diagnostics, first).select("repo_id", F.concat(F.lit(rules.GATE_ORACLE), "gate").alias("oracle_name"), F.col("passed").alias("clean"))
    tests = F.col("oracle_name") == rules.TEST_ORACLE
    return (asked.join(newest, "repo_id", "left").join(gates, ["repo_id", "oracle_name"], "left")
            .select("repo_id", "oracle_name", F.when(tests, F.col("exit_code")).alias("exit_code"),
                    F.coalesce(F.when(tests, F.col("exit_code") == 0).otherwise(F.col("clean")), F.lit(False)).alias("passed")))
