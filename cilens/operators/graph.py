"""Call graphs over many repositories at once. Nodes are symbols (``ord`` is their global
parse order), edges point from caller to callee and never leave a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from cilens import rules
from cilens.functions import text as X
from cilens.operators.prefix import positions
from cilens.session import cut_lineage


def keep_first(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """First definition of each key. A min over structs combines before the shuffle, so one
    key holding most rows never gathers in a single task."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    return (rows.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("first"))
            .select(*keys, f"first.{order}", *[f"first.{c}" for c in rest]))


def call_edges(symbols: DataFrame, call_refs: DataFrame) -> DataFrame:
    """A called name reaches every symbol of that name in the same repository, except itself.

    References are distinct per caller and a symbol has one name, so the pairs are already
    distinct and need no further shuffle. A few symbols call many names, so the references are never sent around.
    """
    callers = symbols.select("repo_id", "ord", F.col("is_test").alias("src_test"))
    targets = symbols.select("repo_id", F.col("name").alias("callee_name"), F.col("ord").alias("dst"),
                             F.col("is_test").alias("dst_test"))
    return (call_refs.hint("merge").join(callers, "ord").withColumnRenamed("ord", "src")
            .join(targets, ["repo_id", "callee_name"]).where("src <> dst")
            .select("repo_id", "src", "dst", "src_test", "dst_test",
                    F.when(F.col("src_test"), "tests").otherwise("calls").alias("relation")))


def neighbours(edges: DataFrame) -> DataFrame:
    """Every edge seen from both ends."""
    out = edges.select("repo_id", F.col("src").alias("node"), F.col("dst").alias("other"),
                       F.col("dst_test").alias("other_test"), F.lit("callee").alias("side"))
    back = edges.select("repo_id", F.col("dst").alias("node"), F.col("src").alias("other"),
                        F.col("src_test").alias("other_test"), F.lit("caller").alias("side"))
    return out.unionByName(back)


def degrees(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    counted = (neighbours(edges).groupBy(F.col("node").alias("ord"))
               .agg(F.count_if(F.col("side") == "caller").alias("incoming"), F.count_if(F.col("side") == "callee").alias("outgoing")))
    return (symbols.select("ord", "symbol_id").join(counted, "ord", "left")
            .select("symbol_id", F.coalesce("incoming", F.lit(0)).alias("incoming"), F.coalesce("outgoing", F.lit(0)).alias("outgoing")))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (column ord)."""
    return (edges.join(nodes.select(F.col("ord").alias("src")), "src", "left_semi")
            .join(nodes.select(F.col("ord").alias("dst")), "dst", "left_semi"))


def view_nodes(symbols: DataFrame, kind: str = "all", search: str = "") -> DataFrame:
    keep = {"functions": ~F.col("is_test"), "tests": F.col("is_test")}.get(kind, F.lit(True))
    if search:
        keep = keep & (F.contains(F.lower("name"), F.lit(search.lower())) | F.contains(F.lower("file_path"), F.lit(search.lower())))
    return symbols.where(keep)


def repo_kind(symbols: DataFrame) -> DataFrame:
    path = F.lower("file_path")
    return symbols.groupBy("repo_id").agg(
        F.when(F.bool_or(path.rlike(r"\.(tsx?|jsx?)\b")), "TypeScript / JavaScript")
        .when(F.bool_or(path.rlike(r"\.(cpp|cc|cxx|hpp|h)\b")), "C++")
        .when(F.bool_or(path.rlike(r"\.py\b")), "Python").otherwise("Mixed codebase").alias("label"))


def targeted_tests(patches: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Tests worth running for a patch: its failing test first, then tests that call a symbol
    of a file with the patched basename, in symbol and caller order.

    ``patches`` has patch_id, repo_id, target_file, failing_test. The test list is worked out
    once per file name, not once per patch.
    """
    code = symbols.where("not is_test").select(F.col("ord").alias("dst"), X.basename(F.col("file_path")).alias("base"))
    tests = symbols.where("is_test").select(F.col("ord").alias("src"), F.col("name").alias("test_name"))
    covering = (edges.where("src_test and not dst_test").join(code, "dst").join(tests, "src")
                .groupBy("repo_id", "base", "test_name").agg(F.min(F.struct("dst", "src")).alias("place")))
    found = (patches.withColumn("base", X.basename(F.col("target_file")))
             .join(covering, ["repo_id", "base"]).where(~F.col("test_name").eqNullSafe(F.col("failing_test")))
             .select("patch_id", "test_name", F.lit(1).alias("tier"), "place"))
    none = F.struct(F.lit(0).cast("bigint").alias("dst"), F.lit(0).cast("bigint").alias("src"))
    own = patches.where("failing_test <> ''").select("patch_id", F.col("failing_test").alias("test_name"), F.lit(0).alias("tier"), none.alias("place"))
    order = Window.partitionBy("patch_id").orderBy("tier", "place")
    return own.unionByName(found).withColumn("position", F.row_number().over(order).cast("bigint")).drop("tier", "place")


def reach(edges: DataFrame, starts: DataFrame, depth: int = rules.TRACE_DEPTH) -> DataFrame:
    """Everything within ``depth`` undirected hops of each start (column ord), with the shortest
    distance. A node first met late in a depth-first walk can hide shorter paths; breadth
    first cannot, so this returns a superset of such a walk.

    Each round extends the newest ring only, removes what was met before and is written to
    the checkpoint folder, so plans stay short and a lost executor redoes one round.
    """
    links = neighbours(edges).select("node", "other").distinct()
    ring = starts.select(F.col("ord").alias("start"), F.col("ord").alias("node"), F.lit(0).cast("bigint").alias("distance"))
    seen = ring
    for hop in range(1, depth + 1):
        step = (ring.select("start", "node").join(links, "node")
                .select("start", F.col("other").alias("node")).distinct()
                .join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        ring = step.withColumn("distance", F.lit(hop).cast("bigint"))
        if hop < depth:
            ring = cut_lineage(ring)
        seen = seen.unionByName(ring)
    return seen


def number_starts(starts: DataFrame) -> DataFrame:
    """Starts (repo_id, ord) numbered inside their repository, as word and bit of a set; repeated starts count once."""
    once = starts.where("ord IS NOT NULL").select("repo_id", "ord").distinct()
    placed = positions(once, ["repo_id"], F.floor(F.col("ord") / 65_536), ["ord"])
    return placed.select("repo_id", "ord", F.floor((F.col("position") - 1) / 64).alias("word"), F.expr("shiftleft(1L, cast((position - 1) % 64 AS INT))").alias("bits"))


def reach_sets(edges: DataFrame, numbered: DataFrame, depth: int = rules.TRACE_DEPTH) -> DataFrame:
    """What ``reach`` finds, for many starts in one walk: per node and distance, the set of starts at that shortest distance.

    A set is kept as words of 64 starts, a row each (node, word, distance, bits), so a node that all starts of a repository reach
    has a row per 64 of them. Words that meet at a node are joined bit by bit, within tasks first. ``numbered`` is what
    ``number_starts`` gives, written. Each round extends the newest ring, takes away what was met before and is written.
    """
    links = cut_lineage(neighbours(edges).select("node", "other").distinct())
    ring = numbered.select(F.col("ord").alias("node"), "word", F.lit(0).cast("bigint").alias("distance"), "bits")
    found = ring
    for hop in range(1, depth + 1):
        came = ring.join(links, "node").groupBy(F.col("other").alias("node"), "word").agg(F.bit_or("bits").alias("came"))
        met = found.groupBy("node", "word").agg(F.bit_or("bits").alias("met"))
        new = F.col("came").bitwiseAND(F.bitwise_not(F.coalesce("met", F.lit(0).cast("bigint"))))
        ring = cut_lineage(came.join(met, ["node", "word"], "left").select("node", "word", F.lit(hop).cast("bigint").alias("distance"), new.alias("bits")).where("bits <> 0"))
        found = found.unionByName(ring)
    return found


def set_members(sets: DataFrame, numbered: DataFrame, nodes: DataFrame) -> DataFrame:
    """The starts in the sets of some nodes (repo_id, ord), one row each."""
    here = nodes.select("repo_id", F.col("ord").alias("node")).join(sets, "node")
    own = numbered.select("repo_id", F.col("ord").alias("start"), "word", F.col("bits").alias("bit"))
    return here.join(own, ["repo_id", "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("start", "node", "distance")
