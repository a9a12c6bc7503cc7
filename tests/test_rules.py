"""Small literal cases of the remaining operators."""

import datetime as dt
import random

from pyspark.sql import Row, functions as F

from cilens.functions import text as X
from cilens.operators import commerce as C, diagnostics as D, graph as G, localize as Z, metrics as M, patches as P, records as R, retrieval as V, source as S
from cilens.sources import responses as A, tables as T, trees
from cilens.streaming import incidents as I


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


SYMBOLS = "repo_id string, ord bigint, symbol_id string, name string, symbol_type string, file_path string, start_line bigint, end_line bigint, is_test boolean"


def graph(spark):
    rows = [("r", 0, "svc/tax.py::Tax", "Tax", "class", "svc/tax.py", 1, 20, False), ("r", 1, "svc/tax.py::Tax.compute", "compute", "method", "svc/tax.py", 3, 6, False),
            ("r", 2, "svc/order.py::process", "process", "function", "svc/order.py", 1, 9, False), ("r", 3, "tests/test_order.py::test_order", "test_order", "test", "tests/test_order.py", 1, 12, True),
            ("r", 4, "svc/far.py::far", "far", "function", "svc/far.py", 1, 4, False), ("s", 5, "svc/tax.py::compute", "compute", "function", "svc/tax.py", 1, 4, False)]
    symbols = spark.createDataFrame(rows, SYMBOLS)
    refs = spark.createDataFrame([(3, "process"), (2, "compute"), (4, "process"), (2, "process")], "ord bigint, callee_name string")
    return symbols, G.call_edges(symbols, refs)


def test_edges_stay_in_their_repository(spark):
    _, edges = graph(spark)
    assert {(r.src, r.dst, r.relation) for r in edges.collect()} == {(3, 2, "tests"), (2, 1, "calls"), (4, 2, "calls")}


def test_reach_is_breadth_first(spark):
    symbols, edges = graph(spark)
    found = {(r.node, r.distance) for r in G.reach(edges, symbols.where("ord = 3")).collect()}
    assert found == {(3, 0), (2, 1), (1, 2), (4, 2)}


def test_reach_by_sets_equals_a_walk_per_start(spark):
    draw = random.Random(5)
    links = sorted({(*sorted(draw.sample(range(300), 2)),) for _ in range(260)} | {(0, i) for i in range(1, 90)})  # a hub among chains
    shape = "repo_id string, src bigint, dst bigint, src_test boolean, dst_test boolean, relation string"
    rows = [("r", a, b, False, False, "calls") for a, b in links] + [("s", 1000, 1001, False, False, "calls")]
    edges = spark.createDataFrame(rows, shape)
    starts = spark.createDataFrame([("r", i) for i in range(0, 300, 2)] * 2 + [("s", 1000), ("s", 2000), ("s", None)], "repo_id string, ord bigint")
    numbered = G.number_starts(starts)
    sets = G.reach_sets(edges, numbered)
    members = G.set_members(sets, numbered, spark.createDataFrame([("r", i) for i in range(300)] + [("s", i) for i in (1000, 1001, 2000)], "repo_id string, ord bigint"))
    beside = {}
    for _, a, b, *_ in rows:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    want = set()
    for start in [*range(0, 300, 2), 1000, 2000]:
        met, ring = {start}, {start}
        for distance in range(4):
            want |= {(start, node, distance) for node in ring}
            ring = {o for node in ring for o in beside.get(node, ())} - met
            met |= ring
    got = [(r.start, r.node, r.distance) for r in members.collect()]
    assert len(got) == len(want) and set(got) == want
    assert sets.count() * 8 < len(want), "a row holds many starts"


def test_evidence_adds_up_and_spreads_once(spark):
    symbols, edges = graph(spark)
    frame = "array<struct<file_path:string,line_number:bigint,function_name:string>>"
    failures = spark.createDataFrame([("f", "r", "svc/tax.py", 4, [("tests/test_order.py", 5, "test_order"), ("svc/order.py", 2, "process"), ("svc/tax.py", 4, "compute")], "in process then compute")],
                                     f"failure_id string, repo_id string, failing_file string, failing_line bigint, frames {frame}, section string")
    rows = {r.name: r for r in Z.score(failures, symbols, edges).collect()}
    assert rows["compute"].score == 100 + 50 + 25 + 15 + 5
    assert rows["process"].score == 40 + 25 + 5
    assert rows["Tax"].score == 15
    assert rows["far"].score == 10 + 5 and rows["far"].evidence[0] == "adjacent in the call graph to process"
    assert "test_order" not in rows
    for k in (1, 2, 3, 4, 9):
        full = [(r.name, r.score, r["rank"]) for r in Z.pool(Z.score(failures, symbols, edges), k).orderBy("rank").collect()]
        assert full == [(r.name, r.score, r["rank"]) for r in Z.pool(Z.score(failures, symbols, edges, top=k), k).orderBy("rank").collect()]
    assert rows["compute"].evidence[0] == "encloses the error site svc/tax.py:4"


def test_names_with_other_characters_are_found(spark):
    symbols, _ = graph(spark)
    odd = symbols.where("ord = 4").withColumn("name", F.lit("case $x"))
    failures = spark.createDataFrame([(1, "r", "ran case $x now"), (2, "r", "case x"), (3, "r", "far")], "failure_id bigint, repo_id string, section string")
    assert [r.failure_id for r in Z.named_in_text(failures, odd).collect()] == [1]
    plain = symbols.where("ord = 4")
    assert [r.failure_id for r in Z.named_in_text(failures, plain).collect()] == [3]


def test_model_answers_and_fallback(spark):
    rows = [(1, '```json\n{"rankings": [{"symbol_id": "b", "rank": 1, "plausibility_reason": "x"}, {"symbol_id": "zz", "rank": 2, "plausibility_reason": "y"}]}\n```'), (2, '{"rankings": [')]
    answers = spark.createDataFrame(rows, "failure_id bigint, answer string")
    pool = spark.createDataFrame([(f, s, s, "p.py", i) for f in (1, 2) for i, s in ((1, "a"), (2, "b"))], "failure_id bigint, symbol_id string, name string, file_path string, rank bigint")
    merged = sorted((r.failure_id, r["rank"], r.symbol_id, r.ranking_source) for r in Z.merge_rankings(pool, A.read_rankings(answers)).collect())
    assert merged == [(1, 1, "b", "llm"), (2, 1, "a", "static"), (2, 2, "b", "static")]
    assert [r.failure_id for r in A.rejected_answers(answers).collect()] == [2]


def test_vendored_paths(spark):
    flags = one(spark, a=X.vendored(F.lit("./.venv/lib/x.py")), b=X.vendored(F.lit("distribution/x.py")), c=X.vendored(F.lit("a/.tool_venv/x.py")), d=X.vendored(F.lit("src/build/x.py")),
                e=X.vendored(F.lit("a/.tool_venv/x.py"), (".tool_venv",)))
    assert tuple(flags) == (True, False, False, True, True)  # other folders count only where they are named


def test_gate_verdict(spark):
    def run(rows):
        df = spark.createDataFrame([(i, "r", p, "ruff", "src/a.py", i, c, m, "error") for i, (p, c, m) in enumerate(rows)],
                                   "ord bigint, repo_id string, phase string, gate string, file_path string, line bigint, code string, message string, severity string")
        return D.compare(df).first()

    assert run([("baseline", "E1", "x"), ("baseline", "E2", "y"), ("after", "E2", "y")]).passed
    worse = run([("baseline", "E1", "x"), ("after", "E3", "z")])
    assert worse.resolved and worse.introduced == 1 and not worse.passed
    assert not run([("baseline", "E1", "x"), ("after", "E1", "x")]).resolved


def test_patch_risk_tokens(spark):
    rows = [(1, "services/tax.py", "compute", "+rate = 1"), (2, "services/auth.py", "f", "+x"), (3, "a.py", "discard", "+y"), (4, "a.py", "loginUser", "+y"), (5, "a.py", "f", "-os.remove(p)"), (6, "a.py", "f", "+os.remove(p)")]
    df = spark.createDataFrame(rows, "patch_id bigint, target_file string, function_name string, unified_diff string")
    assert {r.patch_id: r.risk_level for r in P.risk(df).collect()} == {1: "LOW", 2: "HIGH", 3: "LOW", 4: "LOW", 5: "LOW", 6: "HIGH"}
    assert {r.patch_id for r in P.risk(df, ("discard",)).where("is_risky").collect()} == {3, 6}


def test_hunks_and_counters(spark):
    diff = "--- a/x.py\n+++ b/x.py\n@@ -3,2 +3,2 @@\n ctx\n-old\n+new\n\n@@ -9 +9 @@\n-a\n"
    bare = "-gone\n+here\n"
    rows = P.hunks(spark.createDataFrame([(1, diff), (2, bare), (3, "")], "patch_id bigint, unified_diff string")).collect()
    got = {(r.patch_id, r.hunk_no): (r.old_start, r.old_lines, r.new_lines, r.added, r.removed) for r in rows}
    assert got == {(1, 1): (3, ["ctx", "old", ""], ["ctx", "new", ""], 1, 1), (1, 2): (9, ["a"], [], 0, 1), (2, 0): (1, ["gone"], ["here"], 1, 1)}


def test_anchor_order(spark):
    lines = F.array(*[F.lit(x) for x in ("a", "b", "  a", "a", "b")])
    at = lambda pat, pref: P.anchor(lines, F.array(*[F.lit(p) for p in pat]) if pat else F.array().cast("array<string>"), F.lit(pref))
    row = one(spark, declared=at(["a", "b"], 3), first=at(["a", "b"], 2), loose=at(["b", "a"], 9), none=at(["c"], 0), empty=at([], 99))
    assert row.declared == Row(at=3, exact=True) and row.first == Row(at=0, exact=True)
    assert row.loose == Row(at=1, exact=False) and row.none is None and row.empty == Row(at=5, exact=True)


def test_billing(spark):
    row = one(spark, share=C.tier_share(F.lit(100)), low=C.tier_share(F.lit(9)), tax=C.tax_rate(F.lit(" ny ")), other=C.tax_rate(F.lit(None).cast("string")),
              home=C.warehouse(F.lit("ca")), up=C.prorated(F.lit("starter"), F.lit("pro"), F.lit(15)), down=C.prorated(F.lit("pro"), F.lit("starter"), F.lit(15)))
    assert float(row.share) * 1000 == 200.0 and float(row.low) == 0 and float(row.tax) == 0.08875 and float(row.other) == 0.05
    assert (row.home, row.up, row.down) == ("WH_US_WEST", 35.0, 0.0)
    headers = spark.createDataFrame([(1, "CA", "ENTERPRISE100"), (2, "ZZ", None)], "order_id bigint, state string, coupon string")
    items = spark.createDataFrame([(1, 10.0, 5.0)], "order_id bigint, price double, quantity double")
    totals = {r.order_id: r for r in C.invoices(items, headers).collect()}
    assert totals[1].discount == 50.0 and totals[1].total == 0.0
    assert totals[2].total == 0.0


def test_moving_average_and_header(spark):
    import datetime as dt

    points = spark.createDataFrame([("cpu", dt.datetime(2024, 1, i), i, 10.0 * i) for i in (1, 2, 3)], "name string, ts timestamp_ntz, event_id bigint, value double")
    assert float(M.latest_average(points, 3).first().moving_average) == 20.0
    text = one(spark, h=R.header(F.lit(None).cast("string"), F.lit("user@enterprise.com"), F.lit("Alert"))).h
    assert text == "[NORMAL] To: user@enterprise.com | Subject: Alert"


def test_env_and_redaction(spark):
    blocks = spark.createDataFrame([(1, "# c\nA = 'x=y'\n\nbad line\nB=\"2\""), (2, "9X=1\nA=1")], "req_id bigint, env_text string")
    rows = {r.req_id: r for r in R.env_pairs(blocks).collect()}
    assert [(p.key, p.value) for p in rows[1].pairs] == [("A", "x=y"), ("B", "2")] and rows[1].bad_name is None and rows[2].bad_name == "9X"
    texts = spark.createDataFrame([(1, "tok abcd ab"), (2, "abcd")], "id bigint, text string")
    secrets = spark.createDataFrame([(1, "K", "abcd", 1), (1, "S", "ab", 2)], "id bigint, key string, value string, place int")
    assert {r.id: r.text for r in R.redact(texts, secrets, "id", "place").collect()} == {1: "tok <redacted:K> ab", 2: "abcd"}
    overlapping = spark.createDataFrame([(1, "Z", "abc", 1), (1, "A", "abcd", 2)], "id bigint, key string, value string, place int")
    assert R.redact(texts, overlapping, "id", "place").where("id = 1").first().text == "tok <redacted:Z>d ab"  # as supplied, not by name


def test_latest_records_follow_a_loop(spark):
    import random

    rng = random.Random(4)
    log = [(i, rng.randint(0, 20), rng.choice(["insert", "update", "delete"]), f"s{i}", float(i)) for i in range(300)]
    table = {}
    for _, key, op, status, amount in log:
        if op == "insert" or (op == "update" and key in table):
            table[key] = (status, amount)
        elif op == "delete":
            table.pop(key, None)
    got = R.latest_records(spark.createDataFrame(log, "ord bigint, id bigint, op string, status string, amount double")).collect()
    assert {r.id: (r.status, r.amount) for r in got} == table


def test_similar_fixes_falls_back_to_words(spark):
    history = spark.createDataFrame([(1, "KeyError", "missing key"), (2, "keyerror", "other"), (3, "KeyError", "again"), (4, "OSError", "disk missing")], "ord bigint, exception_type string, exception_message string")
    failures = spark.createDataFrame([(1, "KEYERROR", "x"), (2, "Unseen", "the miss file"), (3, "Unseen", "a missing key"), (4, "Unseen", "abc")], "failure_id bigint, exception_type string, exception_message string")
    got = sorted((r.failure_id, r.n, r.fix_ord) for r in V.similar_fixes(failures, history).collect())
    assert got == [(1, 1, 3), (1, 2, 2), (2, 1, 4), (2, 2, 1), (3, 1, 4), (3, 2, 1)]


def test_repository_and_token_rules(spark):
    row = one(spark, n=X.token_estimate(F.lit("")), m=X.token_estimate(F.lit("x" * 100)), cut=F.length(X.cut_to_budget(F.lit("x" * 20000))))
    assert tuple(row) == (1, 28, 13913)


def test_source_symbols(spark):
    py = "import os\nclass A:\n    def run(self):\n        def inner():\n            return deep()\n        return go(1)\n\nx = 1\ndef test_b():\n    pass\n"
    rows = {r.qualified: r for r in S.python_symbols(spark.createDataFrame([("r", "m.py", py)], "repo_id string, file_path string, content string")).collect()}
    assert set(rows) == {"A", "A.run", "A.run.inner", "test_b"}
    assert (rows["A.run"].symbol_type, rows["A.run"].start_line, rows["A.run"].end_line, rows["A.run"].calls) == ("method", 3, 6, ["go"])
    assert rows["A.run.inner"].calls == ["deep"] and rows["test_b"].is_test and rows["A"].symbol_type == "class"
    cpp = "int add(int a) {\n  if (a) { go(a); }\n  return a;\n}\nTEST(S, One)\n{\n  add(1);\n}\n"
    rows = {r.name: r for r in S.cpp_symbols(spark.createDataFrame([("r", "m.cpp", cpp)], "repo_id string, file_path string, content string")).collect()}
    assert (rows["add"].start_line, rows["add"].end_line) == (1, 4) and (rows["S.One"].end_line, rows["S.One"].is_test) == (8, True)


def test_bracket_issues(spark):
    row = one(spark, a=S.bracket_issues(F.lit("f(')', [1]) {")), b=S.bracket_issues(F.lit(")(")), c=S.bracket_issues(F.lit("'it\\'s (' + (x)")))
    assert (row.a.round.early, row.a.round.open, row.a.curly.open) == (False, False, True)
    assert row.b.round.early and not row.c.round.open


def test_stage_progress(spark):
    states = spark.createDataFrame([("a", "PATCHING"), ("b", "FAILED"), ("c", "COMPLETED"), ("d", "IDLE")], "incident_id string, state string")
    got = {}
    for r in I.stage_progress(states).collect():
        got.setdefault(r.incident_id, {})[r.stage] = r.status
    order = ("LOCALIZING", "RETRIEVING", "PATCHING", "VERIFYING", "CHECKING_SAFETY")
    assert [got["a"][s] for s in order] == ["completed", "completed", "active", "pending", "pending"]
    assert [got["b"][s] for s in order] == ["completed", "completed", "completed", "failed", "pending"]
    assert set(got["c"].values()) == {"completed"} and set(got["d"].values()) == {"pending"}


def test_source_tree_reader(spark, tmp_path):
    for name in ("src/a.py", "src/b.TS", "node_modules/x.js", "docs/readme.md", "distribution/c.cpp"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"// {name}")
    got = {r.path: r.content for r in trees.read_tree(spark, str(tmp_path)).collect()}
    assert got == {n: f"// {n}" for n in ("src/a.py", "src/b.TS", "distribution/c.cpp")}


def test_scorecard_absent_is_not_zero(spark, tmp_path):
    assert [r.recorded for r in T.load_scorecard(spark, str(tmp_path / "none")).collect()] == [False]


def test_reservation_stream_equals_table_job(spark, tmp_path):
    from cilens.streaming import stock

    rows = spark.range(200).select((F.col("id") % 5).alias("sku"), F.col("id").alias("order_id"), F.lit(1).alias("line_no"), (F.col("id") % 13 + 1).alias("qty"),
                                   F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.lit(0).cast("bigint").alias("l_suppkey"), F.lit(0.0).alias("l_extendedprice"))
    items = spark.range(5).select(F.col("id").alias("sku"), F.lit(60).cast("bigint").alias("available_qty"))
    rows.join(items, "sku").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    live = stock.reserve_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    got = {(r.sku, r.order_id): r.granted for r in I.run_to_table(live, "reserve").collect()}
    want = {(r.sku, r.order_id): r.granted for r in stock.reserve(rows, items).collect()}
    assert got == want and any(want.values()) and not all(want.values())


def test_an_update_sets_only_what_it_gives(spark):
    log = [(1, 7, "insert", "new", 5.0), (2, 7, "update", None, 6.0), (3, 7, "update", "old", None), (4, 8, "insert", None, 1.0), (5, 9, "update", "x", 1.0)]
    got = R.latest_records(spark.createDataFrame(log, "ord bigint, id bigint, op string, status string, amount double")).collect()
    assert {r.id: (r.status, r.amount, r.created_ord, r.updated_ord) for r in got} == {7: ("old", 6.0, 1, 3), 8: (None, 1.0, 4, 4)}


def test_oracles_by_name(spark):
    at = dt.datetime(2024, 1, 1)
    runs = [("a", at, 1, 1), ("a", at, 2, 0), ("b", at, 5, 0), ("b", at, 6, 1), ("e", at, 1, None)]
    seen = [(1, "c", "baseline", "E1"), (2, "c", "after", "E2"), (3, "d", "baseline", "E1"), (4, "d", "baseline", "E2"), (5, "d", "after", "E2"), (6, "f", "after", "E1")]
    found = [(n, repo, phase, "ruff", "src/m.py", 1, code, "problem", "error", "") for n, repo, phase, code in seen]
    asked = [("a", "test-suite"), ("b", "test-suite"), ("e", "test-suite"), ("g", "test-suite"), ("c", "gate:ruff"), ("d", "gate:ruff"), ("d", "gate:tsc"), ("f", "gate:ruff"), ("a", "guess"), ("a", None)]
    got = D.verdicts(spark.createDataFrame(asked, "repo_id string, oracle_name string"), spark.createDataFrame(runs, "repo_id string, ts timestamp, run_no bigint, exit_code bigint"),
                     spark.createDataFrame(found, "ord bigint, repo_id string, phase string, gate string, file_path string, line int, code string, message string, severity string, fix_applicability string"))
    assert {(r.repo_id, r.oracle_name): (r.exit_code, r.passed) for r in got.collect()} == {
        ("a", "test-suite"): (0, True), ("b", "test-suite"): (1, False), ("e", "test-suite"): (None, False), ("g", "test-suite"): (None, False),
        ("c", "gate:ruff"): (None, False), ("d", "gate:ruff"): (None, True), ("d", "gate:tsc"): (None, False), ("f", "gate:ruff"): (None, False),
        ("a", "guess"): (None, False), ("a", None): (None, False)}


def test_keywords_answer_only_what_vectors_do_not_find(spark):
    suspects = [(1, "r", "charge", "KeyError", "missing tariff"), (2, "s", "charge", "KeyError", "missing tariff")]
    held = [("r", 1, "c1", "pay", "tariff = 1", False, True), ("r", 2, "c2", "charge", "missing tariff", False, False),
            ("s", 3, "c3", "pay", "tariff = 1", False, False), ("s", 4, "c4", "charge", "missing tariff", True, False), ("s", 5, "c5", "x", "y", False, False)]
    got = V.retrieve(spark.createDataFrame(suspects, "failure_id bigint, repo_id string, name string, exception_type string, exception_message string"),
                     spark.createDataFrame(held, "repo_id string, ord bigint, chunk_id string, name string, code string, is_test boolean, embedded boolean"))
    # r has one vector, so its other chunk is never seen; s has none: c4 holds three words of the first framing, c3 one
    assert {(r.failure_id, r.chunk_id): tuple(r.place) for r in got.collect()} == {(1, "c1"): (1, 1), (2, "c4"): (1, 1), (2, "c3"): (1, 2)}


def test_telemetry_comes_back_as_written(spark, tmp_path):
    rng, folder, want = random.Random(3), str(tmp_path / "telemetry"), {}
    for batch in range(2):
        # times say nothing of the order, many are equal, and one incident holds nearly all rows
        rows = [(batch * 1000 + k, dt.datetime(2024, 1, 1 + rng.randrange(3)), "a", "x", "y", "z", "hot" if k % 10 else f"i{k % 3}", rng.random()) for k in range(400)]
        events = spark.createDataFrame(rows, T.TELEMETRY + ", arrived double").repartition(5)
        for _ in range(2):  # an append that is repeated replaces itself
            T.append_telemetry(events, folder, batch, ("arrived",))
        for row in sorted(rows, key=lambda r: r[7]):
            want.setdefault(row[6], []).append(row[0])
    got = {}
    for row in T.replay(T.read_telemetry(spark, folder)).orderBy("n").collect():
        got.setdefault(row.incident_id, []).append(row.event_id)
        assert row.n == len(got[row.incident_id])
    assert got == want and T.replay(T.read_telemetry(spark, folder, "i1")).count() == len(want["i1"])
