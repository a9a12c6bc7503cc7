"""Which symbols most likely hold the defect behind each failure.

``failures`` carries failure_id, repo_id, failing_file, failing_line, frames and section;
``symbols`` carries repo_id, ord, symbol_id, name, symbol_type, file_path, start_line,
end_line and is_test. Everything joins inside a repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from cilens import rules
from cilens.functions import text as X
from cilens.operators import graph
from cilens.session import cut_lineage, shared, unsent

LINE_BIN = 500
#: Failures whose evidence one task gathers; a failure has tens of observations.
TASK_FAILURES = 65_536


def _paths(rows: DataFrame, path: str, alias: str) -> DataFrame:
    norm = X.norm_path(F.col(path))
    return (rows.where(F.col(path) != "").select("repo_id", F.col(path).alias(alias)).distinct()
            .withColumn(f"{alias}_norm", X.norm_path(F.col(alias)))
            .withColumn(f"{alias}_base", X.basename(X.norm_path(F.col(alias)))))


def path_pairs(symbols: DataFrame, reported: DataFrame, path: str = "path") -> DataFrame:
    """Pairs of symbol path and reported path that mean the same file: one ends with the other,
    or their basenames agree.

    A suffix holding a slash implies equal basenames, so the comparison is an equi-join on the
    basename plus, for paths without any slash, an equi-join on the suffixes of the other
    side's basename. Nothing is compared all against all. Both sides are met three times, so their
    paths are written once. What is laid out of a few rows is many, which the planner does not know.
    """
    s, r = shared(_paths(symbols, "file_path", "symbol_path")), shared(_paths(reported, path, "reported_path"))
    cols = ["repo_id", "symbol_path", "reported_path"]
    same = s.join(r.withColumnRenamed("reported_path_base", "symbol_path_base"), ["repo_id", "symbol_path_base"]).select(*cols)

    def by_suffix(longer: DataFrame, long_name: str, shorter: DataFrame, short_name: str) -> DataFrame:
        base = F.col(f"{long_name}_base")
        tails = F.transform(F.sequence(F.lit(2), F.length(base)), lambda i: F.substr(base, i))
        cut = longer.where(F.length(base) >= 2).select("repo_id", long_name, F.explode(tails).alias("tail"))
        flat = shorter.where(~F.contains(F.col(f"{short_name}_norm"), F.lit("/")))
        return cut.hint("merge").join(flat.withColumnRenamed(f"{short_name}_norm", "tail"), ["repo_id", "tail"]).select(*cols)

    return (same.unionByName(by_suffix(s, "symbol_path", r, "reported_path"))
            .unionByName(by_suffix(r, "reported_path", s, "symbol_path")))


def symbols_by_path(symbols: DataFrame, reported: DataFrame, path: str = "path") -> DataFrame:
    """Symbols of every file a reported path may mean."""
    pairs = path_pairs(symbols, reported, path)
    return pairs.join(symbols.withColumnRenamed("file_path", "symbol_path"), ["repo_id", "symbol_path"])


def enclosing(candidates: DataFrame, sites: DataFrame, order) -> DataFrame:
    """Best symbol spanning each (repo_id, path, line). Spans and sites meet on line bins, so a
    long file is not compared whole; the pick is an aggregate that combines before shuffling."""
    spans = candidates.withColumn("bin", F.explode(F.sequence(
        F.floor(F.col("start_line") / LINE_BIN), F.floor(F.greatest("end_line", "start_line") / LINE_BIN))))
    places = (sites.select("repo_id", F.col("path").alias("reported_path"), "line").distinct()
              .withColumn("bin", F.floor(F.col("line") / LINE_BIN)))
    best = F.min(F.struct(*order, F.col("ord").alias("o"), "symbol_id", "name", "is_test")).alias("best")
    return (places.join(spans.hint("merge"), ["repo_id", "reported_path", "bin"]).where("line between start_line and end_line")
            .groupBy("repo_id", "reported_path", "line").agg(best)
            .select("repo_id", F.col("reported_path").alias("path"), "line", F.col("best.o").alias("ord"),
                    "best.symbol_id", "best.name", "best.is_test"))


def innermost(candidates: DataFrame, sites: DataFrame) -> DataFrame:
    return enclosing(candidates, sites, [(F.col("end_line") - F.col("start_line")).alias("span")])


def first_enclosing(candidates: DataFrame, sites: DataFrame) -> DataFrame:
    """Variant that prefers a suffix match over a bare basename match, then parse order."""
    s, r = X.norm_path(F.col("symbol_path")), X.norm_path(F.col("reported_path"))
    tier = F.when(F.endswith(s, r) | F.endswith(r, s), 0).otherwise(1)
    return enclosing(candidates, sites, [tier.alias("tier")])


def frame_rows(failures: DataFrame) -> DataFrame:
    return (failures.select("failure_id", "repo_id", F.size("frames").alias("n"), F.posexplode("frames").alias("depth", "f"))
            .select("failure_id", "repo_id", "n", "depth", F.col("f.file_path").alias("path"), F.col("f.line_number").alias("line")))


def sites_of(failures: DataFrame) -> DataFrame:
    own = failures.where("failing_file <> '' and failing_line > 0").select(
        "repo_id", F.col("failing_file").alias("path"), F.col("failing_line").alias("line"))
    return own.unionByName(frame_rows(failures).select("repo_id", "path", "line")).distinct()


def named_in_text(failures: DataFrame, symbols: DataFrame) -> DataFrame:
    """(failure_id, ord) for every non-test symbol named as a whole word in the section.

    The section's distinct words meet symbol names in an equi-join, which holds the names of a partition and never sorts
    the words: these are many times the failures. A name holding other characters joins on its first word and is then
    looked up in the text; the words are laid out again for that only where there are such names.
    """
    word = f"[{rules.W}]+"
    names = (symbols.where(~F.col("is_test") & (F.length("name") >= rules.MIN_NAME_CHARS))
             .select("repo_id", "ord", "name", F.regexp_extract("name", word, 0).alias("word")))
    words = failures.select("failure_id", "repo_id", F.explode(F.array_distinct(
        F.regexp_extract_all("section", F.lit(word), F.lit(0)))).alias("word"))
    # a name that is one word is as long as that word
    plain = words.where(F.length("word") >= rules.MIN_NAME_CHARS).hint("shuffle_hash").join(
        names.where("word = name").drop("name").hint("shuffle_hash"), ["repo_id", "word"]).select("failure_id", "ord")
    odd = names.where("word <> name and word <> ''")
    if odd.isEmpty():
        return plain
    # the text itself travels only for names that are not a single word
    whole = F.concat(F.lit(r"\b\Q"), F.col("name"), F.lit(r"\E\b"))
    other = (words.hint("shuffle_hash").join(odd.hint("shuffle_hash"), ["repo_id", "word"])
             .join(failures.select("failure_id", "section").hint("merge"), "failure_id")
             .where(F.regexp_like(F.col("section"), whole)).select("failure_id", "ord"))
    return plain.unionByName(other)


def _bonus():
    return F.when(F.col("symbol_type").isin("function", "method"), rules.EXECUTABLE_POINTS).otherwise(0)


def _evidence(rows: DataFrame, points, group: int, depth, reason, bonus=None) -> DataFrame:
    """One observation. ``place`` is the signal, then the frame depth, as one number: a depth is the index of an
    array and stays below 2^32. It is the same order for all observations of a symbol, so its minimum is a plain one.
    ``bonus`` is what is known here of the points for the symbol's kind, null for a test."""
    place = F.lit(group << 32).cast("bigint") + depth.cast("bigint")
    return rows.select("failure_id", "ord", points.cast("bigint").alias("points"), place.alias("place"), reason.alias("reason"),
                       (F.lit(0) if bonus is None else bonus).cast("int").alias("bonus"))


def direct_evidence(failures: DataFrame, symbols: DataFrame) -> DataFrame:
    """Signals 1 to 4, one row per failure, symbol and observation.

    Sites, candidates and the symbols at sites are each read by several signals, and the planner would lay out all
    frames and paths anew for each; they are written once.
    """
    sites = shared(sites_of(failures))
    reported = sites.select("repo_id", "path").unionByName(
        failures.where("failing_file <> ''").select("repo_id", F.col("failing_file").alias("path")))
    candidates = shared(symbols_by_path(symbols, reported).select(
        "repo_id", "reported_path", "ord", "symbol_id", "name", "symbol_type", "start_line", "end_line", "is_test"))
    at = shared(innermost(candidates, sites).select("repo_id", "path", "line", "ord", "is_test"))

    own = failures.where("failing_file <> '' and failing_line > 0").select(
        "failure_id", "repo_id", F.col("failing_file").alias("path"), F.col("failing_line").alias("line"))
    spot = F.concat("path", F.lit(":"), F.col("line").cast("string"))
    site = _evidence(own.join(at, ["repo_id", "path", "line"]), F.lit(rules.SITE_POINTS), 0, F.lit(0),
                     F.concat(F.lit("encloses the error site "), spot), F.when(~F.col("is_test"), 0))
    framed = frame_rows(failures).hint("merge").join(at.where("not is_test"), ["repo_id", "path", "line"])
    weight = rules.FRAME_BASE + F.floor(rules.FRAME_DEPTH * (F.col("depth") / F.greatest(F.col("n") - 1, F.lit(1))))
    frames = _evidence(framed, weight, 1, F.col("depth"), F.concat(F.lit("appears in the traceback at "), spot))
    named = _evidence(named_in_text(failures, symbols), F.lit(rules.NAMED_POINTS), 2, F.lit(0), F.lit("named in the traceback"))
    filed = failures.where("failing_file <> ''").select("failure_id", "repo_id", F.col("failing_file").alias("reported_path")) \
        .join(candidates.where("not is_test").select("repo_id", "reported_path", "ord", "symbol_type"), ["repo_id", "reported_path"])
    same_file = _evidence(filed, F.lit(rules.SAME_FILE_POINTS), 3, F.lit(0), F.lit("defined in the failing file"), _bonus())
    return site.unionByName(frames).unionByName(named).unionByName(same_file)


def score(failures: DataFrame, symbols: DataFrame, edges: DataFrame, top: int | None = None, explain: bool = True) -> DataFrame:
    """Additive score of every candidate symbol of every failure, with its evidence in order.

    Neighbours of everything implicated get their points once, credited to the first
    implicated symbol. The implicated symbols are written once and read several times.

    A caller that only wants the best ``top`` candidates says so: a failure that already has
    that many symbols above the most a mere neighbour can reach needs no neighbours, and the
    best ``top`` come out the same. A caller that ranks without reading the evidence says so too
    (``explain``): then only numbers are gathered, and there is no evidence column.
    """
    tasks = max(failures.sparkSession.sparkContext.defaultParallelism, -(-failures.count() // TASK_FAILURES))
    reasons = [F.transform(F.array_sort(F.collect_list(F.struct("place", "reason"))), lambda e: e["reason"]).alias("reasons")] if explain else []
    # observations hardly repeat inside a task, so they are dealt out by counted failures before they are gathered
    dealt = lambda rows, *keys: rows.repartition(tasks, *keys)
    seeds = dealt(direct_evidence(failures, symbols), *(["failure_id", "ord"] if top is None else ["failure_id"])).groupBy("failure_id", "ord").agg(
        F.sum("points").alias("points"), F.min("place").alias("place"), F.max("bonus").alias("bonus"), *reasons)
    if top is not None:
        # known where a failure's observations lie together: what is left out of a bonus belongs to more points than a neighbour can have
        strong = F.col("ord").isNotNull() & (F.col("points") + F.col("bonus") > rules.NEIGHBOUR_POINTS + rules.EXECUTABLE_POINTS)
        enough = F.count_if(strong).over(Window.partitionBy("failure_id")) >= top
        seeds = seeds.withColumn("settled", F.col("failure_id").isNotNull() & enough)
    seeds = unsent(cut_lineage(seeds.drop("bonus")))
    links = graph.neighbours(edges).where("not other_test").select(F.col("node").alias("ord"), "other").distinct()
    code = symbols.where("not is_test").select("ord", "symbol_id", "name", "symbol_type", "file_path")
    runs = F.col("symbol_type").isin("function", "method")
    bonus = _bonus()
    open_seeds = seeds if top is None else seeds.where("not settled")
    near = (dealt(open_seeds.select("failure_id", "ord", F.struct("place", F.col("ord").alias("seed")).alias("place")).join(links, "ord")
                  .select("failure_id", F.col("other").alias("ord"), "place"), "failure_id", "ord")
            .groupBy("failure_id", "ord").agg(F.min("place").alias("place"))
            .join(open_seeds.select("failure_id", "ord"), ["failure_id", "ord"], "left_anti"))
    if not explain:
        both = seeds.select("failure_id", "ord", "points").unionByName(
            near.select("failure_id", "ord", F.lit(rules.NEIGHBOUR_POINTS).cast("bigint").alias("points")))
        return both.join(code, "ord").select("failure_id", "ord", "symbol_id", "name", "file_path", (F.col("points") + bonus).cast("bigint").alias("score"))
    # only neighbours are credited to a symbol
    credited = symbols.select(F.col("ord").alias("seed"), F.concat(F.lit("adjacent in the call graph to "), "name").alias("adjacent"))
    adjacent = near.select("failure_id", "ord", F.col("place.seed").alias("seed")).join(credited, "seed", "left")
    merged = seeds.select("failure_id", "ord", "points", "reasons").unionByName(
        adjacent.select("failure_id", "ord", F.lit(rules.NEIGHBOUR_POINTS).cast("bigint").alias("points"), F.array("adjacent").alias("reasons")))
    return merged.join(code, "ord").select(
        "failure_id", "ord", "symbol_id", "name", "file_path",
        (F.col("points") + bonus).cast("bigint").alias("score"),
        F.concat("reasons",
                 F.when(runs, F.array(F.lit("is an executable function or method"))).otherwise(F.array().cast("array<string>"))).alias("evidence"))


def pool(scored: DataFrame, size: int = rules.RANKING_POOL) -> DataFrame:
    """Strongest candidates per failure; the rank limit is applied before the shuffle too."""
    order = Window.partitionBy("failure_id").orderBy(F.desc("score"), "file_path", "name", "symbol_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).withColumn("rank", F.col("rank").cast("bigint"))


def merge_rankings(candidates: DataFrame, rankings: DataFrame) -> DataFrame:
    """Suspects per failure: the model's order over known candidates, else the static order."""
    known = (rankings.select("failure_id", "symbol_id", F.col("rank").alias("model_rank"), "reason")
             .join(candidates.drop("rank"), ["failure_id", "symbol_id"]))
    order = Window.partitionBy("failure_id").orderBy("model_rank", "symbol_id")
    ranked = (known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rules.MAX_SUSPECTS)
              .select("failure_id", "symbol_id", "name", "file_path", F.col("rank").cast("bigint").alias("rank"),
                      F.lit("llm").alias("ranking_source")))
    unranked = candidates.join(ranked.select("failure_id").distinct(), "failure_id", "left_anti")
    static = (unranked.where(F.col("rank") <= rules.MAX_SUSPECTS)
              .select("failure_id", "symbol_id", "name", "file_path", "rank", F.lit("static").alias("ranking_source")))
    return ranked.unionByName(static)


def unlocalized(failures: DataFrame, scored: DataFrame) -> DataFrame:
    return failures.join(scored.select("failure_id").distinct(), "failure_id", "left_anti")
