"""Order-dependent jobs against plain sequential Python, with hot groups and tiny buckets."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from cilens.operators import commerce as C, localize as Z, metrics as M, patches as P, prefix, retrieval as V
from cilens.streaming import stock as S

T0 = dt.datetime(2024, 1, 1)


def requests(spark, rows):
    schema = "order_id bigint, line_no int, sku bigint, qty bigint, ts timestamp_ntz, l_suppkey bigint, l_extendedprice double"
    return spark.createDataFrame(rows, schema)


def sequential(rows, stock):
    left, out = dict(stock), {}
    for r in sorted(rows, key=lambda r: (r[2], r[4], r[0], r[1])):
        ok = left.get(r[2], -1) >= r[3]
        out[(r[0], r[1])] = ok
        if ok:
            left[r[2]] -= r[3]
    return out


def test_hot_product_matches_sequential_reservation(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, 1 if i % 3 == 0 else rng.randint(2, 6), rng.randint(1, 40), T0 + dt.timedelta(days=rng.randint(0, 20)), 0, 0.0) for i in range(600)]
    stock = {1: 1000, 2: 90, 3: 5, 4: 400, 5: 0}
    items = spark.createDataFrame(list(stock.items()), "sku bigint, available_qty bigint")
    want = sequential(rows, stock)
    for hot in (1_000_000, 50):  # one walk; then the largest products in rounds
        got = {(r.order_id, r.line_no): r.granted for r in S.reserve(requests(spark, rows), items, hot_rows=hot).collect()}
        assert got == want


def test_adversarial_quantities_finish_in_rounds(spark):
    rows = [(i, 0, 1, (100 - i // 2) if i % 2 else 1, T0 + dt.timedelta(hours=i), 0, 0.0) for i in range(200)]
    items = spark.createDataFrame([(1, 100)], "sku bigint, available_qty bigint")
    got = {(r.order_id, r.line_no): r.granted for r in S.reserve(requests(spark, rows), items, hot_rows=10).collect()}
    assert got == sequential(rows, {1: 100})


def one_by_one(orders, lines, stock):
    left, wants = dict(stock), {}
    for order, sku, qty in lines:
        wants.setdefault(order, {}).setdefault(sku, 0)
        wants[order][sku] += qty or 0
    out = {}
    for order, _ in sorted(orders, key=lambda o: (o[1], o[0])):
        want = wants.get(order, {})
        out[order] = all(qty <= left.get(sku, -1) for sku, qty in want.items())
        if out[order]:
            for sku, qty in want.items():
                left[sku] -= qty
    return out


def test_orders_of_several_products_equal_a_sequential_loop(spark):
    rng = random.Random(8)
    stock = {1: 2000, 2: 90, 3: 5, 4: 400, 5: 0}
    items = spark.createDataFrame(list(stock.items()), "sku bigint, available_qty bigint")
    for same_time in (False, True):  # all orders at one time, so only their ids order them
        orders = [(i, T0 + dt.timedelta(hours=0 if same_time else rng.randint(0, 300))) for i in range(400)]
        lines = [(i, sku, rng.choice([None, *range(40)])) for i in range(390) for sku in {1, rng.randint(2, 9)} | ({rng.randint(2, 4)} if i % 5 == 0 else set())]
        lines = [x for x in lines if x[1] < 7] + [(7, 4, 1), (7, 4, 1), (9, 4, 300), (9, 4, 300)]  # lines of one product are added up
        got = C.settle(spark.createDataFrame(orders, "order_id bigint, ts timestamp_ntz"), spark.createDataFrame(lines, "order_id bigint, sku bigint, qty bigint"), items)
        want = one_by_one(orders, lines, stock)
        assert {r.order_id: r.granted for r in got.collect()} == want and 30 < sum(want.values()) < 390


def test_settling_nothing(spark):
    orders, lines = spark.createDataFrame([], "order_id bigint, ts timestamp_ntz"), spark.createDataFrame([], "order_id bigint, sku bigint, qty bigint")
    assert C.settle(orders, lines, spark.createDataFrame([], "sku bigint, available_qty bigint")).count() == 0


def located(lines, old, preferred):
    """The first offset in the order of preference, by trying them all."""
    if not old:
        return max(0, min(preferred, len(lines))), True
    spots = range(len(lines) - len(old) + 1)
    for exact, form in ((True, str), (False, str.strip)):
        for at in [i for i in spots if i == preferred] + [i for i in spots if i != preferred]:
            if [form(x) for x in lines[at:at + len(old)]] == [form(x) for x in old]:
                return at, exact
    return None, None


def test_hunks_are_placed_as_by_trying_every_offset(spark):
    rng = random.Random(11)
    bits = ["", "}", "  }", "x = 1", "\tx = 1", "return x", "é()"]
    files = {(f"r{k % 2}", f"f{k}.py"): [rng.choice(bits) for _ in range(rng.randrange(0, 30))] for k in range(12)}
    files["r0", "hot.py"] = ["}"] * 500 + ["last"]
    hunks, want = [], {}
    for n, (key, lines) in enumerate(files.items()):
        for k in range(8):
            a = rng.randrange(0, len(lines) + 1)
            old = lines[a:a + rng.randrange(0, 4)]
            if k == 3:
                old = ["   " + x for x in old]
            elif k == 5:
                old = [*old, "nowhere"]
            start = max(1, a + rng.randrange(-2, 3))
            hunks.append((*key, n, k, start, old))
            want[n, k] = located(lines, old, start - 1)
    hunks += [("r0", "missing.py", 99, 0, 1, ["x = 1"]), ("r0", "missing.py", 99, 1, 1, [])]
    want |= {(99, 0): (None, None), (99, 1): (None, None)}
    source = spark.createDataFrame([(*key, lines) for key, lines in files.items()], "repo_id string, file_path string, lines array<string>")
    asked = spark.createDataFrame(hunks, "repo_id string, file_path string, patch_id bigint, hunk_no bigint, old_start bigint, old_lines array<string>")
    got = {(r.patch_id, r.hunk_no): (r.at, r.exact) for r in P.place_hunks(source, asked).collect()}
    assert got == want
    assert sum(x == (None, None) for x in want.values()) > 5 and any(x[1] is False for x in want.values())
    assert P.place_hunks(source.limit(0), asked.limit(0)).count() == 0


def test_packing_equals_greedy_loop_for_any_chunk(spark):
    rng = random.Random(5)
    texts = [("hot" if i % 3 else "cold", i * 7, "x" * rng.choice([0, 10, 400, 4000, 13000, 20000])) for i in range(900)]
    want, state = {}, {}
    for repo, order, text in texts:
        n = max(1, int(len(text) / 4 * 1.15))
        n = n if n <= 4000 else max(1, int(13913 / 4 * 1.15))
        batch, count, total = state.get(repo, (1, 0, 0))
        if count and (total + n > 8000 or count >= 100):
            batch, count, total = batch + 1, 0, 0
        state[repo] = (batch, count + 1, total + n)
        want[(repo, order)] = batch
    df = spark.createDataFrame(texts, "repo_id string, ord bigint, text string")
    for chunk in (100, 128, 5000):
        assert {(r.repo_id, r.ord): r.batch for r in V.pack_batches(df, chunk=chunk).collect()} == want


def test_packing_when_rows_are_small(spark):
    df = spark.range(250).select(F.lit("r").alias("repo_id"), F.col("id").alias("ord"), F.lit("abc").alias("text"))
    assert {r.batch: r["count"] for r in V.pack_batches(df, chunk=100).groupBy("batch").count().collect()} == {1: 100, 2: 100, 3: 50}


def test_running_totals_and_next_rows(spark):
    rows = [("h" if i % 4 else "c", i, (i * 13) % 17) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    got = {(r.k, r.o): r.run for r in prefix.running_totals(df, ["k"], F.floor(F.col("o") / 10), ["o"], {"run": F.col("v")}).collect()}
    total = {}
    for k, o, v in rows:
        total[k] = total.get(k, 0) + v
        assert got[(k, o)] == total[k]
    nxt = {(r.k, r.o): r.next_o for r in prefix.next_rows(df.where("o % 50 < 12"), ["k"], F.floor(F.col("o") / 10), ["o"], ["o"]).collect()}
    kept = [(k, o) for k, o, _ in rows if o % 50 < 12]
    for k in ("h", "c"):
        mine = [o for kk, o in kept if kk == k]
        assert [nxt[(k, o)] for o in mine] == mine[1:] + [None]


def test_ranges_split_a_key_whose_rows_share_a_second(spark):
    draw = random.Random(8)
    rows = [("hot", 60, i, draw.randrange(9)) for i in range(4000)] + [("hot", 61, i, 1) for i in range(20)] + [(k, 60, i, 2) for k in ("a", "z", None) for i in range(3)]
    df = spark.createDataFrame(draw.sample(rows, len(rows)), "k string, at bigint, id bigint, v bigint")
    cut = prefix.ranged(df, ["k"], ["at", "id"], 8)
    depth = [r["count"] for r in cut.where("k = 'hot'").groupBy("_range").count().collect()]
    assert len(depth) >= 6 and max(depth) < 2000, "no task holds the second"
    got = {(r.k, r.at, r.id): r.run for r in prefix.running_totals(cut.where("k IS NOT NULL"), ["k"], F.col("_range"), ["at", "id"], {"run": F.col("v")}).collect()}
    total, want = {}, {}
    for k, at, i, v in sorted(r for r in rows if r[0]):
        total[k] = total.get(k, 0) + v
        want[k, at, i] = total[k]
    assert got == want
    following = {(r.at, r.id): (r.next_at, r.next_id) for r in prefix.next_rows(cut.where("k = 'hot'"), ["k"], F.col("_range"), ["at", "id"], ["at", "id"]).collect()}
    line = sorted((at, i) for k, at, i, _ in rows if k == "hot")
    assert [following[x] for x in line] == [*line[1:], (None, None)]
    whole = {(r.k, r.at, r.id): r.position for r in prefix.positions(prefix.ranged(df.where("k IS NOT NULL"), [], ["k", "at", "id"], 5), [], F.col("_range"), ["k", "at", "id"]).collect()}
    assert whole == {x: n for n, x in enumerate(sorted(want), 1)}


def test_percentile_on_heavy_tail_and_ties(spark):
    rng = np.random.default_rng(1)
    groups = {"tail": np.exp(rng.normal(0, 6, 500)), "ties": np.repeat([1.0, 2.0, 2.0, 9.0], 50), "one": np.array([4.5]), "neg": -np.arange(101, dtype=float)}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "name string, value double")
    for percent in (0, 50, 95, 100):
        got = {r.name: r.value for r in M.percentile_floor(df, percent).collect()}
        assert got == {k: float(sorted(v)[int((len(v) - 1) * (percent / 100.0))]) for k, v in groups.items()}


def test_quota_usage_matches_sliding_loop(spark):
    rng = random.Random(9)
    seconds = sorted(rng.sample(range(200_000), 400))
    rows = [(i, "hot" if i % 3 else "cold", s, rng.randint(0, 300_000)) for i, s in enumerate(seconds)]
    got = {r.req_id: r for r in M.quota_usage(spark.createDataFrame(rows, "req_id bigint, provider string, t_sec bigint, tokens bigint")).collect()}
    for i, p, s, _ in rows:
        before = [(t, min(tok, 240_000)) for _, q, t, tok in rows if q == p and t < s]
        assert got[i].requests_minute == sum(s - t < 60 for t, _ in before)
        assert got[i].tokens_minute == sum(tok for t, tok in before if s - t < 60)
        assert got[i].requests_day == sum(s - t < 86_400 for t, _ in before)


def _vectors(spark):
    rng = np.random.default_rng(2)
    items = [(i, "a" if i % 3 else "b", rng.integers(0, 5, 8).tolist()) for i in range(300)]
    asked = [(i, "a" if i % 2 else "b", rng.integers(0, 5, 8).tolist()) for i in range(40)]
    return items, asked, spark.createDataFrame(items, "item_id bigint, part string, vec array<int>"), spark.createDataFrame(asked, "query_id bigint, part string, vec array<int>")


def test_vector_search_is_exact_on_both_paths(spark):
    items, asked, i_df, q_df = _vectors(spark)
    want = {}
    for q, part, v in asked:
        near = sorted((sum((x - y) ** 2 for x, y in zip(v, w)), i) for i, p, w in items if p == part)[:5]
        want[q] = [i for _, i in near]
    for block in (4096, 7):  # shared with every task; then block against block
        rows = V.nearest(i_df, q_df, 5, block=block).collect()
        got = {q: [r.item_id for r in sorted(rows, key=lambda r: r.hit) if r.query_id == q] for q, _, _ in asked}
        assert got == want


def test_vectors_of_other_lengths_never_meet(spark):
    i_df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0])], "item_id bigint, part string, vec array<double>")
    q_df = spark.createDataFrame([(9, "a", [1.0])], "query_id bigint, part string, vec array<double>")
    assert [r.item_id for r in V.nearest(i_df, q_df, 5).collect()] == [2]


def test_keyword_search_on_both_paths(spark):
    items = spark.createDataFrame([(1, "r", "Tax rate table", "calc"), (2, "r", "nothing", "tax_rate"), (3, "r", "rate", "x")], "item_id bigint, repo_id string, code string, name string")
    asked = spark.createDataFrame([(7, "r", "tax RATE rate"), (8, "r", "absent")], "query_id bigint, repo_id string, text string")
    for block in (4096, 1):
        rows = sorted((r.query_id, r.hit, r.item_id, r.score) for r in V.keyword_hits(items, asked, block=block).collect())
        assert rows == [(7, 1, 1, 2), (7, 2, 2, 2), (7, 3, 3, 1)]


def test_path_pairs_equal_the_literal_rule(spark):
    rng = random.Random(11)
    parts = ["a", "b", "tax.py", "mytax.py", "x.py", "y", "Tax.py", "py"]
    paths = sorted({"/".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(120)})

    def same(s, r):
        s, r = s.lower(), r.lower()
        return s.endswith(r) or r.endswith(s) or s.rsplit("/", 1)[-1] == r.rsplit("/", 1)[-1]

    symbols = spark.createDataFrame([("r", p) for p in paths[::2]], "repo_id string, file_path string")
    reported = spark.createDataFrame([("r", p) for p in paths[1::2]], "repo_id string, path string")
    got = sorted((x.symbol_path, x.reported_path) for x in Z.path_pairs(symbols, reported).collect())
    assert got == sorted((s, r) for s in paths[::2] for r in paths[1::2] if same(s, r))
    assert len(got) == len(set(got))


def test_credit_of_symbols_with_large_numbers(spark):
    """Numbers as monotonically_increasing_id gives them on many partitions lose no bits."""
    big = (1 << 33) * 700
    symbols = spark.createDataFrame(
        [("r", big + k, f"a.py::f{k}", f"func_{k}", "function", "a.py", 10 * k + 1, 10 * k + 9, False) for k in range(3)],
        "repo_id string, ord bigint, symbol_id string, name string, symbol_type string, file_path string, start_line bigint, end_line bigint, is_test boolean")
    failures = spark.createDataFrame([(1, "r", "a.py", 12, [("a.py", 12, "func_1")], "boom")],
                                     "failure_id bigint, repo_id string, failing_file string, failing_line bigint, frames array<struct<file_path:string,line_number:bigint,function_name:string>>, section string")
    failures = failures.where("failing_file <> ''")
    edges = spark.createDataFrame([("r", big + 1, big + 2, False, False, "calls")], "repo_id string, src bigint, dst bigint, src_test boolean, dst_test boolean, relation string")
    rows = {r.ord - big: r.evidence for r in Z.score(failures, symbols.where("ord <> 0"), edges).collect()}
    assert all(e is not None and None not in e for e in rows.values())
    near = Z.score(failures.withColumn("failing_file", F.lit("")), symbols.where("name <> 'func_0'"), edges).where(F.col("ord") == big + 2).first()
    assert near.evidence[0] == "adjacent in the call graph to func_1"


def test_blocks_without_a_counterpart_keep_text_ids(spark):
    items = spark.createDataFrame([(i, "a", [float(i)]) for i in range(20)] + [(99, "b", [1.0])], "item_id bigint, part string, vec array<double>")
    asked = spark.createDataFrame([(f"q{i}", "a", [float(i)]) for i in range(20)] + [("z", "none", [1.0])], "query_id string, part string, vec array<double>")
    got = V.nearest(items, asked, 1, id_type="string", block=2).collect()
    assert sorted((r.query_id, r.item_id) for r in got) == sorted((f"q{i}", i) for i in range(20))


def test_character_counts_of_a_batch_stay_arrays():
    import tracemalloc
    from collections import Counter

    import pyarrow as pa

    texts = ["".join(chr(200 + (k * 7 + i * 3) % 3000) for i in range(2500)) for k in range(600)] + ["", None, "aab"]
    given = pa.array(texts)
    tracemalloc.start()
    got = V.count_arrays(given, 3072)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * 2**20  # 1.2 million counts; as Python objects they took several times that
    for text, counts in list(zip(texts, got.to_pylist()))[::50] + [(texts[-2], got[-2].as_py()), (texts[-1], got[-1].as_py())]:
        want = Counter((ord(c) + i) % 3072 for i, c in enumerate((text or "")[:2000]))
        assert [(c["slot"], c["n"]) for c in counts] == sorted(want.items())


def test_rows_of_one_split_are_dealt_out(spark, tmp_path):
    from cilens.session import spread

    path = str(tmp_path / "one")
    spark.range(5000).selectExpr("id", "'x' AS log").coalesce(1).write.parquet(path)
    spark.range(0).selectExpr("id", "'x' AS log").coalesce(1).write.mode("append").parquet(path)
    scan = spark.read.parquet(path)
    wide = spread(scan.union(scan.limit(0)).union(scan.where("id < 0")).union(scan.where("id < -1")), 500)
    held = [r["count"] for r in wide.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 5000 and max(held) <= 500
    assert wide.select(F.sum("id")).first()[0] == 5000 * 4999 // 2 and wide.columns == ["id", "log"]
    even = spark.range(4000, numPartitions=4)
    assert spread(even).rdd.getNumPartitions() == 4 and spread(even.limit(0)).count() == 0


def test_hunks_are_placed_without_sending_lines_around(spark):
    files = spark.createDataFrame([("r", "a.py", ["x", "y", "z"])], "repo_id string, file_path string, lines array<string>")
    asked = spark.createDataFrame([("r", "a.py", 1, 1, 1, ["y"])], "repo_id string, file_path string, patch_id bigint, hunk_no bigint, old_start bigint, old_lines array<string>")
    placed = P.place_hunks(files, asked)
    assert [(r.at, r.exact) for r in placed.collect()] == [(1, True)]
    assert "BroadcastExchange" not in placed._jdf.queryExecution().executedPlan().toString()
