"""Related code, tests and past fixes for suspects, and upkeep of the chunk index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cilens import rules
from cilens.functions import text as X
from cilens.operators.prefix import positions
from cilens.session import SENT_ROWS, cut_lineage, shared, small, spread

QUERY_BLOCK = 1024  # queries one task holds; up to that many are sent to every task
ITEM_BLOCK = 8192  # items one task holds when queries are too many to send around
SHAPE_BYTES = 4 << 20  # size of the written table of blocks up to which it is sent to every task
DENSE_ROWS = 512  # items whose sparse counts are laid out at a time
HASH_STEP = 256  # texts whose characters are counted at a time
PACK_CHUNK = 262_144  # rows per packing task, far more than one batch can hold


# --- index upkeep ------------------------------------------------------------------------

def index_diff(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """new, changed, unchanged or stale for every chunk of every repository."""
    old = stored.select("repo_id", "chunk_id", X.content_hash(F.col("code")).alias("old_hash"))
    new = incoming.select("repo_id", "chunk_id", X.content_hash(F.col("code")).alias("new_hash"))
    return old.join(new, ["repo_id", "chunk_id"], "full").select(
        "repo_id", "chunk_id", "new_hash",
        F.when(F.col("new_hash").isNull(), "stale").when(F.col("old_hash").isNull(), "new")
        .when(F.col("old_hash") != F.col("new_hash"), "changed").otherwise("unchanged").alias("status"))


def refresh(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Index after a refresh: stale rows gone, unchanged rows kept, the rest taken over.

    Only hashes are compared; texts are joined to the verdict once, on their own key.
    """
    verdict = index_diff(stored, incoming).select("repo_id", "chunk_id", "status")
    kept = stored.join(verdict.where("status = 'unchanged'"), ["repo_id", "chunk_id"])
    taken = incoming.join(verdict.where("status in ('new', 'changed')"), ["repo_id", "chunk_id"])
    return kept.unionByName(taken)


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union by id, the incoming row wins. Only the stored side is moved for the comparison."""
    replaced = incoming.select("repo_id", "chunk_id")
    return stored.join(replaced, ["repo_id", "chunk_id"], "left_anti").unionByName(incoming)


# --- vectors -----------------------------------------------------------------------------

def count_arrays(texts: pa.Array, dim: int) -> pa.ListArray:
    """The counts of ``hash_counts`` for some texts. They stay arrays of numbers, so a batch takes the bytes of its counts
    and a step of ``HASH_STEP`` texts some more."""
    sizes, slots, times = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for a in range(0, len(texts), HASH_STEP):
        points = [np.frombuffer((value or "")[:rules.HASH_CHARS].encode("utf-32-le"), dtype="<u4").astype(np.int64)
                  for value in texts[a:a + HASH_STEP].to_pylist()]
        size = np.array([len(p) for p in points], dtype=np.int64)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        key, n = np.unique(np.repeat(np.arange(len(points)), size) * dim + (np.concatenate(points) + place) % dim, return_counts=True)
        sizes.append(np.bincount(key // dim, minlength=len(points)))
        slots.append((key % dim).astype(np.int32))
        times.append(n.astype(np.int32))
    flat = pa.StructArray.from_arrays([pa.array(np.concatenate(slots)), pa.array(np.concatenate(times))], ["slot", "n"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), flat)


def hash_counts(text: Column, dim: int = rules.HASH_DIM) -> Column:
    """Character-position counts of a text, the offline embedding before normalization, as sparse (slot, n).

    Each character adds one to slot (code point + position) mod dim, over the leading
    characters the embedding is defined on; slots are in ascending order. An empty text has none.
    Only those characters go to the worker.
    """
    @F.arrow_udf("array<struct<slot:int,n:int>>")
    def counts(texts: pa.Array) -> pa.Array:
        return count_arrays(texts, dim)

    return counts(F.substring(text, 1, rules.HASH_CHARS))


def unit(counts: Column) -> Column:
    """Sparse counts scaled to length one, as (slot, weight); an empty text stays empty."""
    norm = F.sqrt(F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x["n"].cast("bigint") * x["n"]))
    return X.let(norm, lambda n: F.transform(counts, lambda x: F.struct(x["slot"].alias("slot"), (x["n"] / n).alias("weight"))))


def _counted(slots: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts of some rows, one after another: row, slot and count."""
    row = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    flat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
    return row, flat(slots, np.int64), flat(times, np.float64)


def _dense(row: np.ndarray, at: np.ndarray, n: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Counts at the given columns as a matrix; those at column -1 are left out. Whole numbers, so products of it are exact."""
    out = np.zeros(shape)
    held = at >= 0
    out[row[held], at[held]] = n[held]
    return out


def fit_dimension(vector: Column, dim: int) -> Column:
    pad = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(dim) - F.size(vector), F.lit(0)))
    return F.concat(F.slice(vector, 1, dim), pad)


def _trim(best: pd.DataFrame, n: int) -> pd.DataFrame:
    """Keep the n lowest (cost, item) per query."""
    best = best.sort_values(["query_id", "cost", "item_id"], kind="stable")
    return best[best.groupby("query_id").cumcount() < n]


def _best_rows(costs: np.ndarray, items: np.ndarray, ids: np.ndarray, n: int) -> pd.DataFrame:
    """Lowest n items per query column of a cost matrix; unusable pairs cost infinity.

    Everything up to the n-th lowest cost is taken, ties included, and ties are then cut by item.
    """
    keep = np.isfinite(costs)
    if len(costs) > n:
        keep &= costs <= np.partition(costs, n - 1, axis=0)[n - 1]
    row, col = np.nonzero(keep)
    return _trim(pd.DataFrame({"query_id": ids[col], "item_id": items[row], "cost": costs[row, col]}), n)


def _search(items: DataFrame, queries: DataFrame, cost, n: int, id_type: str = "bigint", block: int = QUERY_BLOCK) -> DataFrame:
    """Top n items per query inside each ``part``. ``cost(items, queries, n)`` yields the best rows
    of two frames.

    Queries counted to be few are sent to every task, which keeps a running best over its own
    items. More queries than that are cut into blocks per part and meet blocks of items in a
    co-grouped shuffle: work is spread over block pairs, a part holding a third of the rows
    included. Either way a task returns at most n rows per query and no pair is emitted. The table of
    blocks, a row per part, is what is sent around for that if it is small; items and queries never are.
    """
    schema = f"query_id {id_type}, item_id bigint, cost double"
    queries = cut_lineage(queries)
    if queries.limit(block + 1).count() <= block:
        shared = items.sparkSession.sparkContext.broadcast(queries.toPandas())

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for batch in batches:
                for rows in cost(batch, shared.value, n):
                    best = rows if best is None else _trim(pd.concat([best, rows], ignore_index=True), n)
            if best is not None and len(best):
                yield _trim(best, n)

        found = items.mapInPandas(scan, schema)
    else:
        def cut(rows: DataFrame, size: int, name: str) -> DataFrame:
            return rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

        shape = small(cut_lineage(cut(items, ITEM_BLOCK, "item_blocks").join(cut(queries, block, "query_blocks"), "part")), SHAPE_BYTES)
        all_of = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
        left = (items.hint("merge").join(shape, "part").withColumn("ib", F.pmod(F.xxhash64("item_id"), F.col("item_blocks")).cast("int"))
                .withColumn("qb", all_of("query_blocks")).drop("item_blocks", "query_blocks"))
        right = (queries.hint("merge").join(shape, "part").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int"))
                 .withColumn("ib", all_of("item_blocks")).drop("item_blocks", "query_blocks"))

        def meet(batch: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            parts = list(cost(batch, asked, n)) if len(batch) and len(asked) else []
            return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: pd.Series([], dtype=object) for c in ("query_id", "item_id", "cost")})

        found = left.groupBy("part", "ib", "qb").cogroup(right.groupBy("part", "ib", "qb")).applyInPandas(meet, schema)
    order = Window.partitionBy("query_id").orderBy("cost", "item_id")
    return found.withColumn("hit", F.row_number().over(order)).where(F.col("hit") <= n).withColumn("hit", F.col("hit").cast("bigint"))


def nearest(items: DataFrame, queries: DataFrame, n: int = rules.KEYWORD_HITS, id_type: str = "bigint", block: int = QUERY_BLOCK) -> DataFrame:
    """Nearest vectors by squared distance inside one repository, vector space and dimension.

    items: item_id, part, vec; queries: query_id, part, vec. ``part`` names repository and
    space; vectors of another length never meet.
    """
    def cost(batch, block, n):
        sizes = block["vec"].map(len)
        for (part, dim), rows in batch.groupby([batch["part"], batch["vec"].map(len)], sort=False):
            asked = block[(block["part"] == part) & (sizes == dim)]
            if len(asked):
                x, q = np.stack(rows["vec"]).astype(np.float64), np.stack(asked["vec"]).astype(np.float64)
                gaps = np.stack([((x - row) ** 2).sum(axis=1) for row in q], axis=1)
                yield _best_rows(gaps, rows["item_id"].to_numpy(), asked["query_id"].to_numpy(), n)

    return _search(items, queries, cost, n, id_type, block)


def nearest_hashed(items: DataFrame, queries: DataFrame, n: int = rules.CODE_HITS, id_type: str = "bigint", block: int = QUERY_BLOCK,
                   dim: int = rules.HASH_DIM) -> DataFrame:
    """Same search over hashed texts: ``vec`` holds sparse integer counts, so the squared distance of
    the unit vectors, |a|^2 + |b|^2 - 2 dot / sqrt(|a|^2 |b|^2), is the same number on every machine.

    An empty text is the zero vector: one apart from any other text, and not at all from another empty one.

    Counts travel as two arrays of numbers, and only slots that some query of the part holds are laid out: products need no
    others, and lengths are summed from the sparse counts.
    """
    def cost(batch, block, n):
        for part, rows in batch.groupby("part", sort=False):
            asked = block[block["part"] == part]
            if len(asked):
                row, slot, times = _counted(list(asked["slots"]), list(asked["times"]))
                place = np.full(dim, -1)
                used = np.unique(slot)
                place[used] = np.arange(len(used))
                q = _dense(row, place[slot], times, (len(asked), len(used)))
                q2 = (q * q).sum(axis=1)
                for a in range(0, len(rows), DENSE_ROWS):
                    some = rows.iloc[a:a + DENSE_ROWS]
                    row, slot, times = _counted(list(some["slots"]), list(some["times"]))
                    x = _dense(row, place[slot], times, (len(some), len(used)))
                    x2 = np.bincount(row, times * times, len(some))
                    gaps = np.add.outer((x2 > 0) * 1.0, (q2 > 0) * 1.0) - 2.0 * (x @ q.T / np.sqrt(np.maximum(np.outer(x2, q2), 1.0)))
                    yield _best_rows(gaps, some["item_id"].to_numpy(), asked["query_id"].to_numpy(), n)

    def arrays(rows, key):
        return rows.select(key, "part", F.col("vec")["slot"].alias("slots"), F.col("vec")["n"].alias("times"))

    return _search(arrays(items, "item_id"), arrays(queries, "query_id"), cost, n, id_type, block)


def _word_finder(vocabulary: list[str]):
    """Positions of the vocabulary words a text contains, as substrings, in one pass of the text.

    Words hold no blanks, so fields joined by a newline cannot match across their border.
    """
    import ahocorasick

    machine = ahocorasick.Automaton()
    for i, word in enumerate(vocabulary):
        machine.add_word(word, i)
    machine.make_automaton()
    return lambda text: list({i for _, i in machine.iter(text)}) if vocabulary else []


def keyword_hits(items: DataFrame, queries: DataFrame, n: int = rules.KEYWORD_HITS, block: int = QUERY_BLOCK, id_type: str = "bigint") -> DataFrame:
    """Fallback search: how many distinct query words occur inside a chunk's code or name.

    items: item_id, repo_id, code, name; queries: query_id, repo_id, text. Only chunks of the
    query's own repository are looked at. A word is looked up once per chunk however many
    queries hold it, and only the words found are counted.
    """
    prepared = queries.select("query_id", F.col("repo_id").alias("part"), F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("words"))

    def cost(batch, block, n):
        for part, rows in batch.groupby("part", sort=False):
            asked = block[block["part"] == part]
            vocabulary = sorted({w for words in asked["words"] for w in words})
            if not vocabulary:
                continue
            holders = {w: [] for w in vocabulary}  # which queries hold a word
            for col, words in enumerate(asked["words"]):
                for w in words:
                    holders[w].append(col)
            holders = [np.array(holders[w]) for w in vocabulary]
            occurring = _word_finder(vocabulary)
            score = np.zeros((len(rows), len(asked)))
            for i, (code, name) in enumerate(zip(rows["code"], rows["name"])):
                found = occurring(f"{code.lower()}\n{name.lower()}")
                if found:
                    score[i] = np.bincount(np.concatenate([holders[w] for w in found]), minlength=len(asked))
            yield _best_rows(np.where(score > 0, -score, np.inf), rows["item_id"].to_numpy(), asked["query_id"].to_numpy(), n)

    found = _search(spread(items.select("item_id", F.col("repo_id").alias("part"), "code", "name")), prepared, cost, n, id_type, block)
    return found.select("query_id", "item_id", (-F.col("cost")).cast("bigint").alias("score"), "hit")


# --- retrieval for suspects --------------------------------------------------------------

def framings(suspects: DataFrame) -> DataFrame:
    """Up to three query texts per suspect; empty ones are left out.

    ``suspects`` has failure_id, repo_id, name, exception_type, exception_message.
    """
    error = F.trim(F.concat_ws(" ", "exception_type", "exception_message"))
    texts = F.array(F.trim(F.concat_ws(" ", "name", error)), error, F.col("name"))
    return (suspects.select("failure_id", "repo_id", F.posexplode(texts).alias("p", "text"))
            .where("text <> ''").select("failure_id", "repo_id", (F.col("p") + 1).cast("bigint").alias("framing"), "text"))


def retrieve(suspects: DataFrame, chunks: DataFrame, n: int = rules.CODE_HITS) -> DataFrame:
    """Chunks for each suspect, merged over its framings: the first appearance decides the place.

    Equal query texts of a repository are searched once. ``chunks`` has repo_id, ord, chunk_id, name, code, is_test and,
    where an outage left some out of the vector index, a boolean ``embedded``. Only a query for which vector search finds
    nothing at all goes on to keyword search, which reads every chunk of its repository.
    """
    asked = framings(suspects).withColumn("query_id", F.concat_ws("|", "repo_id", "text"))
    distinct = shared(asked.select("query_id", "repo_id", "text").distinct())
    embedded = chunks.where("embedded") if "embedded" in chunks.columns else chunks
    items = embedded.select(F.col("ord").alias("item_id"), F.col("repo_id").alias("part"), hash_counts(F.col("code")).alias("vec"))
    hits = shared(nearest_hashed(items, distinct.select("query_id", F.col("repo_id").alias("part"), hash_counts(F.col("text")).alias("vec")), n, "string")
                       .select("query_id", "item_id", "hit"))
    missed = shared(distinct.join(hits.select("query_id").distinct(), "query_id", "left_anti"))
    if not missed.isEmpty():
        words = keyword_hits(chunks.select(F.col("ord").alias("item_id"), "repo_id", "code", "name"), missed, n, id_type="string")
        hits = hits.unionByName(words.select("query_id", "item_id", "hit"))
    rows = asked.join(hits, "query_id").groupBy("failure_id", "item_id").agg(F.min(F.struct("framing", "hit")).alias("place"))
    return rows.join(chunks.select(F.col("ord").alias("item_id"), "chunk_id", "is_test"), "item_id").select(
        "failure_id", "chunk_id", "is_test", "place")


def context(merged: DataFrame, suspects: DataFrame) -> DataFrame:
    """The suspect's own chunk is dropped; then the first code and test chunks are kept."""
    own = suspects.select("failure_id", F.col("symbol_id").alias("chunk_id"))
    order = Window.partitionBy("failure_id", "is_test").orderBy("place")
    return (merged.join(own, ["failure_id", "chunk_id"], "left_anti").withColumn("n", F.row_number().over(order))
            .where(F.col("n") <= F.when(F.col("is_test"), rules.TEST_HITS).otherwise(rules.CODE_HITS))
            .select("failure_id", "chunk_id", "is_test", F.col("n").cast("bigint").alias("n")))


def newest(history: DataFrame, keys: list[str], limit: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("ord"))
    return history.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)


def similar_fixes(failures: DataFrame, history: DataFrame, limit: int = rules.FIX_HITS) -> DataFrame:
    """Newest fixes of the same exception type; without any, newest whose message contains a
    long word of the failure's message.

    Failures are reduced to distinct (type, message) first, and history to its newest rows per
    type or message, so hot types cost two rows. Each distinct word finds its newest rows once,
    however many messages hold it, and a message takes the newest over its words. The contains
    test is an equi-join on four characters: every word compared has at least four, so its first
    four must occur in the message.
    """
    signs = shared(failures.select("exception_type", "exception_message").distinct().withColumn("kind", F.lower("exception_type")))
    past = history.withColumn("kind", F.lower("exception_type")).withColumn("said", F.lower("exception_message")).select("ord", "kind", "said")
    by_type = newest(past, ["kind"], limit).select("kind", "ord", "n")
    exact = signs.join(by_type, "kind").select("exception_type", "exception_message", "ord", "n")

    rest = signs.join(by_type.select("kind").distinct(), "kind", "left_anti")
    words = rest.select("exception_type", "exception_message", F.explode(F.array_distinct(F.split(F.lower("exception_message"), r"\s+"))).alias("word")) \
        .where(F.length("word") >= rules.FIX_WORD_CHARS).hint("merge")  # some for each message
    asked = words.select("word").distinct().withColumn("gram", F.left("word", F.lit(rules.FIX_WORD_CHARS)))
    said = newest(past, ["said"], limit).select("said", "ord").hint("merge")
    starts = F.sequence(F.lit(1), F.length("said") - (rules.FIX_WORD_CHARS - 1))
    grams = past.select("said").distinct().where(F.length("said") >= rules.FIX_WORD_CHARS).select("said", F.explode(F.array_distinct(
        F.transform(starts, lambda i: F.substr(F.col("said"), i, F.lit(rules.FIX_WORD_CHARS))))).alias("gram"))
    latest = newest(asked.join(grams, "gram").where(F.contains("said", F.col("word"))).select("word", "said").join(said, "said"), ["word"], limit)
    alike = words.join(latest.select("word", "ord"), "word").select("exception_type", "exception_message", "ord").distinct()
    loose = newest(alike, ["exception_type", "exception_message"], limit).select("exception_type", "exception_message", "ord", "n")
    found = cut_lineage(exact.unionByName(loose))
    found = F.broadcast(found) if found.count() <= SENT_ROWS else found.hint("merge")
    return (failures.select("failure_id", "exception_type", "exception_message").join(found, ["exception_type", "exception_message"])
            .select("failure_id", F.col("ord").alias("fix_ord"), F.col("n").cast("bigint").alias("n")))


# --- batch packing -----------------------------------------------------------------------

def _jumps(tokens: np.ndarray, limit_tokens: int, limit_rows: int) -> np.ndarray:
    """For a batch opened at each row, the row that opens the next one."""
    total = np.concatenate([[0], np.cumsum(tokens)])
    start = np.arange(len(tokens))
    by_tokens = np.searchsorted(total, total[:-1] + limit_tokens, side="right") - 1
    return np.maximum(np.minimum(by_tokens, start + limit_rows), start + 1)


def pack_batches(texts: DataFrame, chunk: int = PACK_CHUNK, limit_tokens: int = rules.BATCH_TOKENS,
                 limit_rows: int = rules.BATCH_ROWS) -> DataFrame:
    """Greedy batches per repository in ``ord`` order, closed by count or estimated tokens.

    Greedy packing looks sequential, but a batch holds at most ``limit_rows`` rows, so the
    first batch opened inside a chunk of rows starts at one of its first ``limit_rows`` rows.
    Each chunk, with a short look into the next one, maps that entry row to the entry row of
    the next chunk and the number of batches opened. Composing the maps per repository gives
    every chunk its entry, and chunks are then numbered on their own. No task sees more than
    one chunk of rows.
    """
    if chunk < limit_rows:
        raise ValueError("a chunk must hold at least one full batch")
    tokens = X.token_estimate(X.cut_to_budget(F.col("text")))
    placed = positions(texts.select("repo_id", "ord", tokens.alias("tokens")), ["repo_id"], F.floor(F.col("ord") / 65536), ["ord"])
    placed = cut_lineage(placed.withColumn("chunk", F.floor((F.col("position") - 1) / chunk)).withColumn("slot", (F.col("position") - 1) % chunk))
    ahead = placed.where((F.col("slot") < limit_rows) & (F.col("chunk") > 0)).withColumn("chunk", F.col("chunk") - 1).withColumn("slot", F.col("slot") + chunk)
    rows = placed.withColumn("own", F.lit(True)).unionByName(ahead.withColumn("own", F.lit(False)))

    def chunk_map(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot")
        own = int(pdf["own"].sum())
        jump = _jumps(pdf["tokens"].to_numpy(), limit_tokens, limit_rows)
        # steps are doubled until every row has left the chunk
        leave, opened = jump[:own].copy(), np.ones(own, dtype=np.int64)
        while (inside := np.flatnonzero(leave < own)).size:
            at = leave[inside]
            opened[inside], leave[inside] = opened[inside] + opened[at], leave[at]
        return pd.DataFrame({"repo_id": [pdf["repo_id"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "own": [own],
                             "leave": [leave[:limit_rows] - own], "opened": [opened[:limit_rows]]})

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        at, batch, out = 0, 1, []
        for row in pdf.sort_values("chunk").itertuples():
            out.append((row.repo_id, row.chunk, at, batch))
            if at < row.own:
                batch += int(row.opened[at])
                at = int(row.leave[at])
            else:
                at -= row.own
        return pd.DataFrame(out, columns=["repo_id", "chunk", "entry", "batch"])

    maps = rows.groupBy("repo_id", "chunk").applyInPandas(chunk_map, "repo_id string, chunk bigint, own bigint, leave array<bigint>, opened array<bigint>")
    starts = maps.groupBy("repo_id").applyInPandas(entries, "repo_id string, chunk bigint, entry bigint, batch bigint")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot")
        jump = _jumps(pdf["tokens"].to_numpy(), limit_tokens, limit_rows)
        opens = np.zeros(len(pdf), dtype=np.int64)
        at = int(pdf["entry"].iloc[0])
        while at < len(pdf):
            opens[at] = 1
            at = jump[at]
        batch = pdf["batch"].iloc[0] - 1 + np.cumsum(opens)
        return pd.DataFrame({"repo_id": pdf["repo_id"], "ord": pdf["ord"], "tokens": pdf["tokens"], "batch": batch})

    return placed.join(starts, ["repo_id", "chunk"]).groupBy("repo_id", "chunk").applyInPandas(
        number, "repo_id string, ord bigint, tokens bigint, batch bigint")
