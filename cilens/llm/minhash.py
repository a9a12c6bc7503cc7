"""Document fingerprints by one-permutation MinHash, in DataFrame expressions alone.

Each shingle of five words is hashed once. The top bits of the hash choose one of ``BINS`` bins, and a bin keeps its
smallest hash. An empty bin i takes over the value of another one, by optimal densification: all bins are ranked by a
hash of i and their number, and the first that is not empty is copied, so that equal sets fill equal bins and every
empty bin draws anew. Of each value the lowest ``BITS`` bits are stored. Two unequal sets agree in a bin by chance with
probability 2^-BITS, which the estimate of likeness corrects.

A document's successor is found by a lead over buckets of ids, so no window holds the table: bucket bounds are
approximate quantiles of the ids, and each bucket also gets a copy of the first row of the next one. Texts are
shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cilens.llm.common import cut_lineage, table, whole_text

SHINGLE_WORDS = 5
BINS = 128
BITS = 8
_SHIFT = 57  # 64 less the bits of a bin number
_PRIME = 2147483647
#: Attempts of an empty bin that are looked up in a table; then the ranks of all filled bins are compared.
_TRIES = 3
_LOW = (1 << _SHIFT) - 1  # the bits of a hash below its bin; all set, they mark the end of a bin


def _rank(i, j):
    """The place of bin j in the order that empty bin i tries; for numbers and columns."""
    t = i * BINS + j + 1
    x = t * 48271 % _PRIME
    return (x * x + t) % _PRIME * 69621 % _PRIME


def _tries() -> list[list[int]]:
    orders = [sorted(range(BINS), key=lambda j, i=i: (_rank(i, j), j)) for i in range(BINS)]
    return [[order[k] for order in orders] for k in range(_TRIES)]


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of a text column in lower-case hex; a text without words has an empty one.

    The last possible hash of every bin joins the hashes, so that the first of each bin in sorted order make up all bins.
    """
    words, hashes, bins = (f"__{name}_{part}" for part in ("words", "hashes", "bins"))
    bin_of = lambda h: F.shiftright(h, _SHIFT) + BINS // 2  # noqa: E731  rises with the hash
    df = df.withColumn(words, F.array_remove(F.split(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+"), ""))
    df = df.withColumn(words, F.transform(words, lambda w: F.xxhash64(w)))
    more = [lambda i, k=k: F.get(words, i + k) for k in range(1, SHINGLE_WORDS)]
    whole = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (SHINGLE_WORDS - 1), F.lit(0))),
                        lambda h, i: F.xxhash64(h, *[get(i) for get in more]))
    ends = F.lit([((b - BINS // 2) << _SHIFT) | _LOW for b in range(BINS)]).cast("array<bigint>")
    df = df.withColumn(hashes, F.sort_array(F.concat(F.when(F.size(words) < SHINGLE_WORDS, F.array(F.xxhash64(words))).otherwise(whole), ends)))
    least = F.filter(hashes, lambda h, i: ~F.shiftright(h, _SHIFT).eqNullSafe(F.shiftright(F.get(hashes, i - 1), _SHIFT)))
    df = df.withColumn(bins, F.transform(least, lambda h: F.when(h.bitwiseAND(_LOW) != _LOW, h)))
    tries = [F.array(*map(F.lit, row)) for row in _tries()]
    signs = F.array(*[F.lit(f"{k:0{BITS // 4}x}") for k in range(1 << BITS)])

    def fill(x: Column, i: Column) -> Column:
        ranked = F.transform(F.filter(bins, lambda h: h.isNotNull()), lambda h: F.struct(_rank(i.cast("bigint"), bin_of(h)).alias("r"), bin_of(h).alias("b"), h.alias("h")))
        return F.coalesce(x, *[F.get(bins, F.get(row, i)) for row in tries], F.array_min(ranked)["h"])

    digits = F.transform(F.transform(bins, fill), lambda x: F.get(signs, x.bitwiseAND((1 << BITS) - 1).cast("int")))
    return df.withColumn(name, F.when(F.size(words) > 0, F.array_join(digits, "")).otherwise(F.lit(""))).drop(words, hashes, bins)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles of two fingerprints, chance agreement taken off; two empty ones are alike."""
    width = max(1, BITS // 8)
    both = F.array(F.struct(F.unhex(a).alias("a"), F.unhex(b).alias("b")))  # bound once, read per bin
    at = F.sequence(F.lit(1), F.lit(BINS * width), F.lit(width))
    same = F.get(F.transform(both, lambda s: F.size(F.filter(at, lambda i: F.substr(s["a"], i, F.lit(width)) == F.substr(s["b"], i, F.lit(width))))), F.lit(0))
    chance = 0.5 ** BITS
    estimate = F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(estimate)


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """Number of bounds up to an id, found in two steps so that many bounds cost little; null ids come first."""
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[k:k + step] for k in range(0, len(bounds), step)]
    if not rows:
        return F.lit(0)
    count = lambda held: F.size(F.filter(held, lambda b: b <= doc_id))
    first = F.greatest(count(F.lit([r[0] for r in rows]).cast("array<bigint>")) - 1, F.lit(0))
    inside = F.get(F.array(*[F.lit(r).cast("array<bigint>") for r in rows]), first)
    return F.when(doc_id.isNull(), F.lit(0)).otherwise(first * step + count(inside))


def with_next(docs: DataFrame, text: str = "text", buckets: int | None = None) -> DataFrame:
    """(doc_id, h, text, next_text, fingerprint, next_fingerprint), the next document being that with the next id.

    After the last comes the first. Null ids stand first, rows with one id follow xxhash64 of their texts, h, and of
    equal rows each is next to the other. ``buckets`` bounds the rows of a window; by default four to a partition.
    """
    spark = docs.sparkSession
    whole = whole_text(docs, text)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(whole).alias("h"), whole.alias("text"))
    wanted = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / wanted for k in range(1, wanted)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 20 * wanted).alias("b")).first()["b"] if shares else None
    rows = rows.withColumn("bucket", _bucket(F.col("doc_id"), sorted(set(found or ()))))
    # a row per bucket: its first key, and which bucket it follows; the last bucket is followed by the first
    firsts = rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), F.coalesce("doc_id", F.lit(0)).alias("i"), "h")).alias("f"))
    turn = Window.orderBy("bucket")
    last = F.max("bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    edges = cut_lineage(firsts.select("f.*", F.col("bucket").alias("from"), F.coalesce(F.lag("bucket").over(turn), last).alias("to")))
    edges = F.broadcast(edges.select(F.col("some").alias("e_some"), F.col("i").alias("e_i"), F.col("h").alias("e_h"), "to"))  # one row per bucket
    key = (F.col("doc_id").isNotNull() == F.col("e_some")) & (F.coalesce("doc_id", F.lit(0)) == F.col("e_i")) & (F.col("h") == F.col("e_h"))
    copies = rows.join(edges, key).dropDuplicates(["doc_id", "h", "to"]).select("doc_id", "h", "text", F.col("to").alias("bucket"), F.lit(True).alias("copy"))
    both = with_fingerprint(rows.withColumn("copy", F.lit(False)).unionByName(copies), "text", "fingerprint")
    order = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").asc_nulls_first(), "h")
    led = both.select("doc_id", "h", "text", "copy", "fingerprint", F.lead("text").over(order).alias("next_text"),
                      F.lead("fingerprint").over(order).alias("next_fingerprint"))
    return led.where("not copy").drop("copy")


def edited(docs: DataFrame, text: str = "text", buckets: int | None = None) -> DataFrame:
    """Every row's fingerprint beside those of its edited text and of the next document.

    The edited text is the first half of the text, the longer one if the number of code points is odd, and as much of
    the start of the next document as there is, up to the length of the other half. Null texts are empty; an empty
    table gives no rows; other columns are not read. Equal texts have equal fingerprints.
    """
    rows = with_next(docs, text, buckets).withColumn("n_chars", F.char_length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next_text", F.lit(1), half)))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return edited(table(spark, folder, "documents"))
