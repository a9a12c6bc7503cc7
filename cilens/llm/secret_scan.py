"""Secret scans over an incremental ledger of blobs, in DataFrame expressions alone.

Every version of every file is a row of path columns and a text. A text is addressed by its SHA-256, so copies, moves
and unchanged versions share one blob. The ledger keeps three tables in a folder:

* ``paths``: each path with the blob it held, one row per version ever recorded;
* ``scans``: the rule versions that each blob has been scanned with;
* ``findings``: (blob, rule, start, end) in code points.

An update scans only the pairs of blob and rule version that are not in ``scans``: new texts with all rules, known
texts with new rule versions alone. Findings are joined back to all paths of their blob. Findings are written before
the scans that vouch for them; an update that dies in between is repeated by the next one, and findings are read
as a set, so nothing is lost or counted twice.

A text leaves a task once per blob (the shuffle by blob is pre-aggregated) and matches are placed by a running sum
over the gaps between them, so texts of any length and any number of matches take linear work.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cilens.llm.common import cut_lineage, join_back, scratch_path, table, whole_text
from cilens.session import small


@dataclass(frozen=True)
class Rule:
    """A pattern whose ``group`` must have ``least`` characters; any change of a rule takes a new version."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The forms of secrets. Patterns read the same in Java and RE2.
_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),  # runs of 24 and more; shorter ones would fail anyway
)
RULES = (*BASE,
         Rule("key_block", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
         Rule("forge_token", r"gh[oprsu]_[0-9A-Za-z]{36,}"),
         Rule("chat_token", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
         Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"))

_PLACES = "array<struct<start:bigint,rank:int,end:bigint>>"


class Ledger:
    """The three tables below ``folder``; opening one that is not there makes it empty."""

    def __init__(self, spark: SparkSession, folder: str, paths: str = "doc_id bigint"):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schemas = {"paths": f"{paths}, blob string", "scans": "blob string, rules array<string>",
                        "findings": "blob string, rule string, start bigint, end bigint"}
        for name, schema in self.schemas.items():
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.folder}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/{name}")


def address(docs: DataFrame, text: str = "text"):
    """The content address of a row's text; a null text is the empty one."""
    return F.sha2(whole_text(docs, text).cast("binary"), 256)


def _at_least(least: int, size: Column) -> Column:
    return size >= least


def _of_rule(rank: int, place: Column) -> Column:
    return place["rank"] == rank


def matches(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, start, end) for ``texts`` (blob, text, todo); todo names the rules to try on a row.

    Matches of a rule are leftmost and do not overlap; those with too short a group are dropped and not tried again.
    """
    found = texts
    for k, rule in enumerate(rules):
        hit = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        found = found.withColumn(f"hit{k}", F.when(F.array_contains("todo", rule.key), hit))
    sets = []
    for k, rule in enumerate(rules):
        hit = F.col(f"hit{k}")
        size = F.transform(hit, F.char_length)
        held = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hit
        gaps = F.transform(F.split("text", rule.pattern, -1), F.char_length)
        good = F.transform(F.transform(held, F.char_length), partial(_at_least, rule.least))
        rows = F.arrays_zip(F.slice(gaps, 1, F.size(hit)).alias("gap"), size.alias("size"), good.alias("good"))
        sets.append(F.struct(F.lit(rule.key).alias("rule"), F.when(F.size(hit) > 0, rows).cast("array<struct<gap:bigint,size:bigint,good:boolean>>").alias("m")))
    rows = found.select("blob", F.explode(F.array(*sets)).alias("s")).where("s.m is not null")
    rows = rows.select("blob", F.col("s.rule").alias("rule"), F.posexplode("s.m").alias("at", "m"))
    # the end of a match is the sum of all gaps and matches up to it
    upto = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(upto))
    return rows.where("m.good").select("blob", "rule", (F.col("end") - F.col("m.size")).alias("start"), "end")


def update(ledger: Ledger, versions: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Record ``versions`` and scan what is new; returns the recorded paths (the path columns, blob).

    Rows with equal paths are versions of one file and are all recorded, repeated rows too. Null paths are kept, a null
    text is empty, an empty table records nothing, further columns are not read.
    """
    paths = [c for c in ledger.read("paths").columns if c != "blob"]
    types = ledger.read("paths").schema
    keyed = versions.select(*[F.col(c).cast(types[c].dataType).alias(c) for c in paths], address(versions, text).alias("blob"))
    recorded = cut_lineage(keyed)
    now = [r.key for r in rules]
    scans = ledger.read("scans")
    seen = scans.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
    todo = F.array_except(F.lit(now), F.coalesce("seen", F.array().cast("array<string>")))
    unseen = cut_lineage(recorded.select("blob").distinct().join(seen, "blob", "left").select("blob", todo.alias("todo")).where("size(todo) > 0"))
    texts = versions.select(address(versions, text).alias("blob"), whole_text(versions, text).alias("text"))
    if not scans.isEmpty():
        texts = texts.join(small(unseen.select("blob")), "blob", "left_semi")  # known texts stay where they are
    texts = texts.dropDuplicates(["blob"]).join(unseen, "blob")
    ledger.append("findings", matches(texts, rules))
    ledger.append("scans", unseen.select("blob", F.col("todo").alias("rules")))
    ledger.append("paths", recorded)
    return recorded


def places(ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, places): each blob's findings of the given rule versions, by start, then by the rules' order."""
    rank = F.create_map(*[F.lit(x) for k, rule in enumerate(rules) for x in (rule.key, k)])
    found = ledger.read("findings").where(F.col("rule").isin([r.key for r in rules]))
    return found.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", rank[F.col("rule")].cast("int").alias("rank"), "end"))).cast(_PLACES).alias("places"))


def located(recorded: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``recorded`` (path columns, blob) with the places of its blobs, empty where there are none: findings of all paths.

    However many paths share one blob, their rows are spread over tasks.
    """
    sizes = recorded.groupBy("blob").agg(F.count(F.lit(1)).alias("n"))
    rows = join_back(recorded, places(ledger, rules), "blob", sizes)
    return rows.withColumn("places", F.coalesce("places", F.array().cast(_PLACES)))


def query(spark: SparkSession, folder: str) -> DataFrame:
    ledger = Ledger(spark, scratch_path(spark, "blobs"))
    found = located(update(ledger, table(spark, folder, "documents")), ledger)
    names = F.array(*[F.lit(r.name) for r in RULES])
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"], x["end"])), ",")
    counts = [F.size(F.filter("places", partial(_of_rule, k))).cast("bigint").alias(f"n_{r.name}") for k, r in enumerate(BASE)]
    base = F.filter("places", lambda x: x["rank"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("places")).alias("spans"), "blob")


def _sets() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    one = "SELECT r, {k} AS k, '{name}' AS name, {least} AS least, regexp_extract_all(t, {p}, 0) AS f, regexp_extract_all(t, {p}, {g}) AS g, regexp_split_to_array(t, {p}) AS s FROM d"
    return " UNION ALL ".join(one.format(k=k, name=r.name, least=r.least, p=quoted(r.pattern), g=r.group) for k, r in enumerate(RULES))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_sets()}),
u AS (SELECT r, k, name, least, unnest(f) AS f, unnest(g) AS g, unnest(s[1:len(f)]) AS s, generate_subscripts(f, 1) AS i FROM m WHERE len(f) > 0),
p AS (SELECT r, k, name, length(g) >= least AS good, length(f) AS n, sum(length(s) + length(f)) OVER (PARTITION BY r, k ORDER BY i) AS e FROM u),
q AS (SELECT r, k, e - n AS b, concat(name, ':', CAST(e - n AS BIGINT), ':', CAST(e AS BIGINT)) AS told FROM p WHERE good),
a AS (SELECT r, {', '.join(f"count(*) FILTER (k = {k}) AS n_{x.name}" for k, x in enumerate(BASE))},
 string_agg(told, ',' ORDER BY b, k) FILTER (k < {len(BASE)}) AS base, string_agg(told, ',' ORDER BY b, k) AS spans FROM q GROUP BY r)
SELECT doc_id, {', '.join(f"coalesce(n_{x.name}, 0) AS n_{x.name}" for x in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob FROM d LEFT JOIN a USING (r)"""
