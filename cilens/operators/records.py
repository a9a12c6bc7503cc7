"""Small record rules: environment text, redaction, validation, sessions, lookups, latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cilens import rules
from cilens.functions import text as X

ENV_NAME = r"^[A-Za-z_][A-Za-z0-9_]*$"
EMAIL = r"^[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+$"


def env_pairs(blocks: DataFrame) -> DataFrame:
    """KEY=value pairs of every block; a bad name rejects the block as a whole.

    The row-wise ``bad_name`` keeps accepted and rejected blocks in one pass.
    """
    usable = F.filter(F.transform(X.lines(F.coalesce("env_text", F.lit(""))), X.strip),
                      lambda l: (l != "") & ~F.startswith(l, F.lit("#")) & F.contains(l, F.lit("=")))

    def pair(line: Column) -> Column:
        value = F.btrim(F.btrim(X.strip(F.substr(line, F.instr(line, "=") + 1)), F.lit('"')), F.lit("'"))
        return F.struct(X.strip(F.substring_index(line, "=", 1)).alias("key"), value.alias("value"))

    return blocks.select("req_id", F.transform(usable, pair).alias("pairs")).select(
        "req_id", "pairs", F.try_element_at(F.filter(F.transform("pairs", lambda p: p["key"]), lambda k: ~k.rlike(ENV_NAME)), F.lit(1)).alias("bad_name"))


def redact(texts: DataFrame, secrets: DataFrame, key: str, order: str) -> DataFrame:
    """Replace every supplied value of three characters or more, in the order supplied.

    Where values overlap, the one that comes first is masked whole. An owner's secrets are one environment block,
    which is folded over each of its texts.
    """
    per_owner = (secrets.where(F.length("value") >= 3).groupBy(key)
                 .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("key").alias("k"), "value"))).alias("values")))
    clean = F.aggregate("values", F.col("text"), lambda acc, s: F.replace(acc, s["value"], F.concat(F.lit("<redacted:"), s["k"], F.lit(">"))))
    return texts.join(per_owner, key, "left").withColumn("text", F.when(F.col("values").isNull(), F.col("text")).otherwise(clean)).drop("values")


def mask_env(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.lit("<redacted>")).otherwise(text)


def valid_account(user_id: Column, email: Column) -> Column:
    return F.coalesce((user_id != "") & (email != "") & email.rlike(EMAIL), F.lit(False))


def valid_sku(sku: Column, price: Column) -> Column:
    return F.coalesce((sku != "") & (price >= 0) & (F.length(sku) >= 3), F.lit(False))


def valid_order(order_id: Column, customer_id: Column, lines: Column, total: Column) -> Column:
    return F.coalesce((order_id != "") & (customer_id != "") & (lines > 0) & (total >= 0), F.lit(False))


def token_shape(token: Column) -> Column:
    return F.coalesce((F.length(token) >= 10) & F.startswith(token, F.lit("Bearer_")), F.lit(False))


def live_sessions(sessions: DataFrame, revoked: DataFrame, now: Column, role: str) -> DataFrame:
    kept = sessions.join(revoked.select("token"), "token", "left_anti")
    return kept.where((F.col("expires_at") >= now) & F.array_contains("roles", role))


def lookup(value: Column, table: dict[str, str], default: str) -> Column:
    """Constant table lookup with a default; a map literal needs no join at all."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, value), F.lit(default))


def latest_records(changes: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """Table state after a log of inserts, updates and deletes.

    An insert starts a record over, a delete removes it and an update only counts on a record
    that exists then, where it sets the values that it gives (a null gives none). Per key it takes the
    last insert not followed by a delete, then the last value given since for each column; both are
    aggregates that combine before the shuffle.
    """
    marks = changes.groupBy(key).agg(
        F.max(F.when(F.col("op") == "insert", F.col(order))).alias("born"),
        F.max(F.when(F.col("op") == "delete", F.col(order))).alias("gone"))
    alive = marks.where("born is not null and (gone is null or gone < born)").select(key, "born")
    since = changes.where("op <> 'delete'").join(alive, key).where(F.col(order) >= F.col("born"))
    given = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return since.groupBy(key).agg(given("status"), given("amount"), F.max("born").alias("created_ord"), F.max(order).alias("updated_ord"))


def incident_status(asked: DataFrame, results: DataFrame, errors: DataFrame) -> DataFrame:
    return (asked.join(results.select("incident_id", F.lit(True).alias("done")).distinct(), "incident_id", "left")
            .join(errors.select("incident_id", F.lit(True).alias("failed")).distinct(), "incident_id", "left")
            .select("incident_id", F.when(F.col("done"), "completed").when(F.col("failed"), "error").otherwise("running").alias("status")))


def scan_lookup(asked: DataFrame, scans: DataFrame, failures: DataFrame) -> DataFrame:
    """A missing scan and a missing failure inside a known scan are different answers."""
    known = scans.select("scan_id", F.lit(True).alias("has_scan")).distinct()
    return (asked.join(known, "scan_id", "left").join(failures.select("scan_id", "failure_id", "test_name"), ["scan_id", "failure_id"], "left")
            .select("scan_id", "failure_id", "test_name",
                    F.when(F.col("has_scan").isNull(), "no scan").when(F.col("test_name").isNull(), "no failure").otherwise("found").alias("answer")))


def gateway(channel: Column) -> Column:
    return lookup(channel, rules.CHANNELS, rules.DEFAULT_CHANNEL)


def header(priority: Column, recipient: Column, subject: Column) -> Column:
    return F.concat(F.lit("["), F.upper(F.coalesce(priority, F.lit("normal"))), F.lit("] To: "), recipient, F.lit(" | Subject: "), subject)
