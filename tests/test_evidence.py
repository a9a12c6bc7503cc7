"""How evidence and hits are gathered: what is sorted, sent around and dealt out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cilens import plans, session
from cilens.operators import graph as G, localize as Z, retrieval as V
from cilens.plans import localize as LP, retrieval as RP

SYMBOLS = "repo_id string, ord bigint, symbol_id string, name string, symbol_type string, file_path string, start_line bigint, end_line bigint, is_test boolean"
FAILURES = ("failure_id bigint, repo_id string, failing_file string, failing_line bigint, "
            "frames array<struct<file_path:string,line_number:bigint,function_name:string>>, section string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark, n=9):
    symbols = spark.createDataFrame([("r", k, f"a.py::fn_{k}", f"fn_{k}", "function", "a.py", 10 * k + 1, 10 * k + 9, False) for k in range(n)], SYMBOLS)
    failures = spark.createDataFrame([(k, "r", "a.py", 10 * k + 2, [], f"ab in fn_{k} at fn_0") for k in range(n)], FAILURES)
    return failures, symbols


def test_words_meet_names_without_a_sort_or_a_broadcast(spark):
    failures, symbols = tables(spark)
    found = Z.named_in_text(failures, symbols)
    text = plan(found)
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text and "Broadcast" not in text
    assert text.count("Generate") == 1  # words are laid out once
    assert sorted(map(tuple, found.collect())) == sorted({(k, o) for k in range(9) for o in (0, k)})


def test_evidence_is_dealt_out_by_counted_failures(spark, monkeypatch):
    failures, symbols = tables(spark)
    edges = spark.createDataFrame([("r", 1, 2, False, False)], "repo_id string, src bigint, dst bigint, src_test boolean, dst_test boolean")
    key = lambda df: sorted((r.failure_id, r.ord, r.score, tuple(r.evidence)) for r in df.collect())
    want = key(Z.score(failures, symbols, edges))
    steps, write = [], Z.cut_lineage
    monkeypatch.setattr(Z, "cut_lineage", lambda df: steps.append(plan(df)) or write(df))
    monkeypatch.setattr(Z, "TASK_FAILURES", 1)
    assert key(Z.score(failures, symbols, edges)) == want
    assert "9), REPARTITION_BY_NUM" in steps[0]  # a failure a task


def test_frames_and_paths_are_laid_out_once(spark):
    failures, symbols = tables(spark)
    framed = failures.withColumn("frames", F.expr("array(named_struct('file_path', 'x/a.py', 'line_number', failing_line, 'function_name', 'f'))"))
    found = Z.direct_evidence(framed, symbols)
    assert plan(found).count("posexplode(frames") == 1  # for the signal of the frames; sites and paths are read as written
    got = found.groupBy("ord", "reason").agg(F.count(F.lit(1)).alias("n"), F.max("bonus").alias("bonus")).where("ord = 3").collect()
    assert {(r.reason, r.n, r.bonus) for r in got} == {
        ("encloses the error site a.py:32", 1, 0), ("appears in the traceback at x/a.py:32", 1, 0), ("named in the traceback", 1, 0), ("defined in the failing file", 9, 5)}


def test_settled_failures_are_known_when_evidence_is_gathered(spark, monkeypatch):
    failures, symbols = tables(spark)
    kinds = F.expr("CASE WHEN ord = 2 THEN 'test' WHEN ord % 3 = 0 THEN 'class' ELSE symbol_type END")
    symbols = symbols.withColumn("symbol_type", kinds).withColumn("is_test", F.col("ord") == 2)
    # fn_9 lies elsewhere and is met as a neighbour only
    symbols = symbols.unionByName(spark.createDataFrame([("r", 9, "b.py::fn_9", "fn_9", "method", "b.py", 1, 9, False)], SYMBOLS))
    edges = spark.createDataFrame([("r", k, 9, k == 2, False) for k in range(9)], "repo_id string, src bigint, dst bigint, src_test boolean, dst_test boolean")
    key = lambda df, n: sorted((r.failure_id, r.ord, r.score, r["rank"]) for r in Z.pool(df, n).collect())
    steps, write = [], Z.cut_lineage
    monkeypatch.setattr(Z, "cut_lineage", lambda df: steps.append(write(df)) or steps[-1])
    for top, settled in ((1, {True}), (5, {True}), (7, {True, False}), (8, {False})):
        scored = Z.score(failures, symbols, edges, top, False)
        assert key(scored, top) == key(Z.score(failures, symbols, edges, None, False), top)
        assert {r.settled for r in steps[-2].select("settled").distinct().collect()} == settled
        assert plan(scored).count("LeftAnti") == 1  # neighbours against symbols met before, nothing else


def test_items_of_a_search_are_never_sent_around(spark):
    texts = [(k, f"p{k % 3}", "text" * (k % 7) + chr(97 + k % 26)) for k in range(60)] + [(60, "p0", "")]
    rows = spark.createDataFrame(texts, "id bigint, part string, text string")
    vec = V.hash_counts(F.col("text"), 64).alias("vec")
    items, asked = rows.select(F.col("id").alias("item_id"), "part", vec), rows.where("id % 4 = 0").select(F.col("id").alias("query_id"), "part", vec)
    found = V.nearest_hashed(items, asked, 2, block=1, dim=64)
    assert "BuildLeft" not in plan(found) and plan(found).count("BuildRight") == 2  # the table of blocks, once a side
    dense = np.zeros((61, 64))
    for k, _, text in texts:
        for i, c in enumerate(text):
            dense[k, (ord(c) + i) % 64] += 1
    sums = (dense * dense).sum(axis=1)
    cost = np.add.outer((sums > 0) * 1.0, (sums > 0) * 1.0) - 2.0 * (dense @ dense.T / np.sqrt(np.maximum(np.outer(sums, sums), 1.0)))
    want = {(q, i, cost[i, q]) for q, part, _ in texts if q % 4 == 0
            for i in sorted((i for i, p, _ in texts if p == part), key=lambda i: (cost[i, q], i))[:2]}
    for block in (1, 1024):
        assert {(r.query_id, r.item_id, r.cost) for r in V.nearest_hashed(items, asked, 2, block=block, dim=64).collect()} == want


def test_lines_of_products_with_enough_for_all_leave_at_once(spark, monkeypatch):
    from cilens.operators import commerce as C

    orders = spark.createDataFrame([(k, k) for k in range(40)], "order_id bigint, ts bigint")
    rows = [(k, 1, 5) for k in range(40)] + [(k, 2, 3) for k in range(0, 40, 2)] + [(39, 3, 0)]
    lines = spark.createDataFrame(rows, "order_id bigint, sku bigint, qty bigint")
    stock = spark.createDataFrame([(1, 200), (2, 31)], "sku bigint, available_qty bigint")
    steps, write = [], C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df: steps.append(write(df)) or steps[-1])
    got = {r.order_id: r.granted for r in C.settle(orders, lines, stock).collect()}
    assert got == {k: k != 39 and (k % 2 == 1 or k // 2 < 10) for k in range(40)}
    rounds = steps[2:]  # after the numbered orders and their lines
    assert rounds and all(step.where("sku = 1").isEmpty() for step in rounds)


def test_a_written_step_is_not_sent_by_the_size_of_its_files(spark):
    rows = spark.range(session.SENT_ROWS + 1).select(F.col("id").alias("ord"), F.lit("src/mod.py").alias("file_path"))
    large, few = session.shared(rows), session.shared(rows.limit(9))
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size(large) < 1 << 20  # less than the planner sends around
    asked = rows.select("ord").where("ord % 1000 = 7")
    for step in (large, large.where("ord > 5").withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))), large.groupBy("ord").count()):
        assert "Broadcast" not in plan(asked.join(step, "ord"))
    assert "BroadcastHashJoin" in plan(asked.join(few, "ord"))
    assert asked.join(large, "ord").count() == 66


def test_ends_of_names_are_never_sent_around(spark):
    symbols = session.shared(spark.createDataFrame([("r", "lib/abc.py"), ("r", "abc.py"), ("s", "x/bc.py")], "repo_id string, file_path string"))
    reported = session.shared(spark.createDataFrame([("r", "bc.py"), ("r", "/work/abc.py"), ("s", "c.py")], "repo_id string, path string"))
    pairs = Z.path_pairs(symbols, reported)
    assert plan(pairs).count("SortMergeJoin") == 2  # a side each of ends of names
    want = [("r", "abc.py", "/work/abc.py"), ("r", "abc.py", "bc.py"), ("r", "lib/abc.py", "/work/abc.py"), ("r", "lib/abc.py", "bc.py"), ("s", "x/bc.py", "c.py")]
    assert sorted({tuple(r) for r in pairs.collect()}) == want


def test_only_neighbours_meet_the_symbols_they_are_credited_to(spark):
    failures, symbols = tables(spark)
    symbols = symbols.unionByName(spark.createDataFrame([("r", 9, "b.py::other", "other", "method", "b.py", 1, 9, False)], SYMBOLS))
    edges = spark.createDataFrame([("r", k, 9, False, False) for k in range(9)], "repo_id string, src bigint, dst bigint, src_test boolean, dst_test boolean")
    scored = Z.score(failures, symbols, edges)
    assert "-1 AS seed" not in plan(scored)  # one key for all others
    evidence = {(r.failure_id, r.ord): r.evidence for r in scored.collect()}
    assert len(evidence) == 90
    for k in range(9):
        assert evidence[k, 9] == [f"adjacent in the call graph to fn_{k}", "is an executable function or method"]
        assert evidence[k, (k + 1) % 9] in (["defined in the failing file", "is an executable function or method"],
                                            ["named in the traceback", "defined in the failing file", "is an executable function or method"])


def test_called_names_are_never_sent_around(spark):
    symbols = session.shared(spark.createDataFrame([("r", k, f"fn_{k}", False, [f"fn_{k + 1}"]) for k in range(5)], "repo_id string, ord bigint, name string, is_test boolean, calls array<string>"))
    found = G.call_edges(symbols, symbols.select("ord", F.explode("calls").alias("callee_name")))
    assert "SortMergeJoin" in plan(found)
    assert sorted((r.src, r.dst) for r in found.collect()) == [(k, k + 1) for k in range(4)]


def part_copies(folder):
    """Two repositories with logs, symbols and fixes, as a folder of tables."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    kinds = ("error", "click", "view", "purchase", "signup")
    tables = {
        "part": {"p_partkey": pa.array(range(800), pa.int64()), "p_size": pa.array([k % 50 for k in range(800)], pa.int32())},
        "events": {"event_id": pa.array(range(300), pa.int64()), "ts": pa.array([k * 10**6 for k in range(300)], pa.timestamp("us")),
                   "user_id": pa.array([k % 60 for k in range(300)], pa.int64()), "event_type": pa.array([kinds[k // 7 % 5] for k in range(300)])},
        "orders": {"o_orderkey": pa.array(range(90), pa.int64()), "o_custkey": pa.array(range(90), pa.int64())},
    }
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["a1_evidence_score", "j9_merge_model_ranking", "r9_context_bundle", "r5_query_framings", "r6_context_caps",
                                  "j10_unlocalized", "w2_candidate_pool", "u1_merged_hits"])
def test_no_step_of_a_query_is_sent_by_the_size_of_its_files(spark, tmp_path, monkeypatch, name):
    folder, steps, write = part_copies(tmp_path), [], session.cut_lineage
    for module in (session, Z, V, LP, RP):
        monkeypatch.setattr(module, "cut_lineage", lambda df: steps.append(plan(df)) or write(df), raising=False)
        monkeypatch.setattr(module, "SENT_ROWS", 0, raising=False)  # as if every step held too many
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")  # more than any step here, less than what joins of them may give
    try:
        steps.append(plan(plans.QUERIES[name](spark, folder)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(steps) > 5 and not [text for text in steps if "BroadcastExchange" in text]
