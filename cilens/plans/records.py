"""Record rules: validation, redaction, sessions, lookups, latest state."""

from pyspark.sql import functions as F

from cilens.operators import records as R
from cilens.plans.registry import query


@query("p9_env_blocks", r"""
WITH l AS (SELECT req_id, trim(line) AS t FROM (SELECT req_id, unnest(string_split(env_text, chr(10))) AS line FROM env_blocks)),
k AS (SELECT req_id, trim(split_part(t, '=', 1)) AS key, trim(trim(trim(substr(t, instr(t, '=') + 1)), '"'), chr(39)) AS value FROM l WHERE t <> '' AND NOT starts_with(t, '#') AND contains(t, '=')),
bad AS (SELECT req_id, any_value(key) AS key FROM k WHERE NOT regexp_matches(key, '^[A-Za-z_][A-Za-z0-9_]*$') GROUP BY req_id)
SELECT req_id, key, value, false AS rejected FROM k WHERE req_id NOT IN (SELECT req_id FROM bad) UNION ALL SELECT req_id, key, '', true FROM bad""")
def env_blocks(t):
    parsed = R.env_pairs(t.env_blocks)
    good = parsed.where("bad_name is null").select("req_id", F.explode("pairs").alias("p")).select("req_id", "p.key", "p.value", F.lit(False).alias("rejected"))
    return good.unionByName(parsed.where("bad_name is not null").select("req_id", F.col("bad_name").alias("key"), F.lit("").alias("value"), F.lit(True).alias("rejected")))


@query("p10_secret_redaction", """
WITH s AS (SELECT conv_id, max(value) FILTER (key = 'KEY_A' AND length(value) >= 3) AS a, max(value) FILTER (key = 'KEY_B' AND length(value) >= 3) AS b FROM secrets GROUP BY conv_id)
SELECT c.conv_id, c.turn, CASE WHEN c.conv_id % 2 = 0 THEN replace(replace(c.text, coalesce(a, ''), CASE WHEN a IS NULL THEN '' ELSE '<redacted:KEY_A>' END), coalesce(b, ''), CASE WHEN b IS NULL THEN '' ELSE '<redacted:KEY_B>' END)
 ELSE replace(replace(c.text, coalesce(b, ''), CASE WHEN b IS NULL THEN '' ELSE '<redacted:KEY_B>' END), coalesce(a, ''), CASE WHEN a IS NULL THEN '' ELSE '<redacted:KEY_A>' END) END AS text
FROM conversations c LEFT JOIN s USING (conv_id)""")
def secret_redaction(t):
    return R.redact(t.conversations.select("conv_id", "turn", "text"), t.secrets, "conv_id", "place")


@query("p11_request_masking", "SELECT conv_id, turn, role, CASE WHEN env <> '' THEN '<redacted>' ELSE env END AS env_text FROM (SELECT *, CASE WHEN role = 'user' THEN text ELSE '' END AS env FROM conversations)")
def request_masking(t):
    env = F.when(F.col("role") == "user", F.col("text")).otherwise("")
    return t.conversations.select("conv_id", "turn", "role", R.mask_env(env).alias("env_text"))


@query("p12_record_validation", r"""
SELECT 'account' AS kind, CAST(c_custkey AS VARCHAR) AS id, regexp_matches(email, '^[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+$') AS valid FROM (SELECT c_custkey, CASE WHEN c_custkey % 8 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN 'user at mail' ELSE 'user.' || CAST(c_custkey AS VARCHAR) || '@mail.example' END AS email FROM customer)
UNION ALL SELECT 'sku', CAST(p_partkey AS VARCHAR), length('P' || CAST(p_partkey AS VARCHAR)) >= 3 AND p_retailprice - 905 >= 0 FROM part
UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), coalesce(n, 0) > 0 AND o_totalprice >= 0 FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def record_validation(t):
    k = F.col("c_custkey")
    email = F.when(k % 8 == 0, "").when(k % 5 == 0, "user at mail").otherwise(F.concat(F.lit("user."), k.cast("string"), F.lit("@mail.example")))
    accounts = t.customer.select(F.lit("account").alias("kind"), k.cast("string").alias("id"), R.valid_account(k.cast("string"), email).alias("valid"))
    pk = F.col("p_partkey").cast("string")
    skus = t.part.select(F.lit("sku").alias("kind"), pk.alias("id"), R.valid_sku(F.concat(F.lit("P"), pk), F.col("p_retailprice") - 905).alias("valid"))
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    ok = F.col("o_orderkey").cast("string")
    orders = t.orders.join(counts, "o_orderkey", "left").select(
        F.lit("order").alias("kind"), ok.alias("id"), R.valid_order(ok, F.col("o_custkey").cast("string"), F.coalesce("n", F.lit(0)), F.col("o_totalprice")).alias("valid"))
    return accounts.unionByName(skus).unionByName(orders)


def _token():
    k = F.col("c_custkey")
    return F.when(k % 6 == 0, F.lit(None).cast("string")).when(k % 4 == 0, F.lit("Bearer_1")).when(k % 5 == 0, F.concat(F.lit("Token__"), "c_name")).otherwise(F.concat(F.lit("Bearer_"), "c_name"))


_TOKEN_SQL = "CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 'Bearer_1' WHEN c_custkey % 5 = 0 THEN 'Token__' || c_name ELSE 'Bearer_' || c_name END"


@query("p13_token_shape", f"SELECT c_custkey, coalesce(length(tok) >= 10 AND starts_with(tok, 'Bearer_'), false) AS valid FROM (SELECT c_custkey, {_TOKEN_SQL} AS tok FROM customer)")
def token_shape(t):
    return t.customer.select("c_custkey", R.token_shape(_token()).alias("valid"))


_NOW = "2024-01-15 00:00:00"


@query("p14_ttl_expiry", f"SELECT event_id, TIMESTAMP '{_NOW}' <= ts + to_seconds(86400 * (1 + user_id % 14)) AS live FROM events")
def ttl_expiry(t):
    ttl = F.make_interval(secs=(86400 * (1 + F.col("user_id") % 14)).cast("decimal(18,6)"))
    return t.events.select("event_id", (F.lit(_NOW).cast("timestamp_ntz") <= F.col("ts") + ttl).alias("live"))


_CHANNEL_SQL = "CASE event_type WHEN 'click' THEN 'email' WHEN 'view' THEN 'sms' WHEN 'purchase' THEN 'webhook' ELSE event_type END"


def messages(t):
    channel = F.when(F.col("event_type") == "click", "email").when(F.col("event_type") == "view", "sms").when(F.col("event_type") == "purchase", "webhook").otherwise(F.col("event_type"))
    return t.events.select("event_id", F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@mail.example")).alias("recipient"), channel.alias("channel"),
                           F.when(F.col("event_id") % 3 == 0, F.lit("high")).alias("priority"), F.concat(F.lit("Event "), F.col("event_id").cast("string")).alias("subject"),
                           (F.col("event_id") % 7 == 0).alias("failed"))


@query("p15_dispatch_history", f"""
SELECT event_id, 'user' || CAST(user_id AS VARCHAR) || '@mail.example' AS recipient, CASE {_CHANNEL_SQL} WHEN 'email' THEN 'SendGridGateway' WHEN 'sms' THEN 'TwilioGateway' WHEN 'webhook' THEN 'HTTPPostGateway' ELSE 'UnknownGateway' END AS gateway FROM events WHERE event_id % 7 <> 0""")
def dispatch_history(t):
    """Sent messages by recipient, with the gateway that carried them."""
    return messages(t).where("not failed").select("event_id", "recipient", R.gateway(F.col("channel")).alias("gateway"))


@query("f20_notification_header", """
SELECT event_id, '[' || CASE WHEN event_id % 3 = 0 THEN 'HIGH' ELSE 'NORMAL' END || '] To: user' || CAST(user_id AS VARCHAR) || '@mail.example | Subject: Event ' || CAST(event_id AS VARCHAR) AS header FROM events""")
def notification_header(t):
    return messages(t).select("event_id", R.header(F.col("priority"), F.col("recipient"), F.col("subject")).alias("header"))


@query("t10_retry_queue", """
SELECT 'user' || CAST(user_id AS VARCHAR) || '@mail.example' AS recipient, count(*) AS queued, count(*) FILTER (event_type <> 'signup') AS delivered FROM events WHERE event_id % 7 = 0 GROUP BY ALL""")
def retry_queue(t):
    """Queued messages are tried once more; signups have no subject to send and fail again."""
    again = messages(t).where("failed").withColumn("subject", F.when(F.col("channel") != "signup", F.col("subject")))
    sent = R.header(F.col("priority"), F.col("recipient"), F.col("subject")).isNotNull()
    return again.groupBy("recipient").agg(F.count(F.lit(1)).alias("queued"), F.count_if(sent).alias("delivered"))


@query("p18_session_validity", f"""
SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0 AND TIMESTAMP '2024-01-01 00:00:00' + to_seconds(3600 * (c_custkey % 48)) >= TIMESTAMP '2024-01-02 00:00:00' AND c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def session_validity(t):
    k = F.col("c_custkey")
    sessions = t.customer.select(k, F.concat(F.lit("Bearer_"), "c_name").alias("token"),
                                 (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(secs=(3600 * (k % 48)).cast("decimal(18,6)"))).alias("expires_at"),
                                 F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.array(F.lit("viewer"), F.lit("admin"))).otherwise(F.array(F.lit("viewer"))).alias("roles"))
    revoked = t.customer.where("c_custkey % 9 = 0").select(F.concat(F.lit("Bearer_"), "c_name").alias("token"))
    return R.live_sessions(sessions, revoked, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), "admin").select("c_custkey")


@query("u6_keyed_table", """
WITH m AS (SELECT id, max(ord) FILTER (op = 'insert') AS born, max(ord) FILTER (op = 'delete') AS gone FROM change_log GROUP BY id),
s AS (SELECT c.*, m.born FROM change_log c JOIN m USING (id) WHERE born IS NOT NULL AND (gone IS NULL OR gone < born) AND ord >= born)
SELECT id, arg_max(status, ord) FILTER (status IS NOT NULL) AS status, arg_max(amount, ord) FILTER (amount IS NOT NULL) AS amount, max(born) AS created_ord, max(ord) AS updated_ord FROM s GROUP BY id""")
def keyed_table(t):
    return R.latest_records(t.change_log)


@query("j14_incident_status", """
SELECT incident_id, CASE WHEN bool_or(action = 'STATE_TRANSITION' AND output_summary IN ('COMPLETED', 'FAILED', 'PENDING_APPROVAL')) THEN 'completed' WHEN bool_or(action = 'PIPELINE_HALTED') THEN 'error' ELSE 'running' END AS status FROM telemetry GROUP BY incident_id""")
def incident_status(t):
    """A pipeline that ends in FAILED still delivered its summary; only a halt before any end is an error."""
    tel = t.telemetry
    results = tel.where("action = 'STATE_TRANSITION' and output_summary in ('COMPLETED', 'FAILED', 'PENDING_APPROVAL')")
    return R.incident_status(tel.select("incident_id").distinct(), results, tel.where("action = 'PIPELINE_HALTED'"))


@query("j15_scan_failure_lookup", """
WITH f AS (SELECT CAST(log_id AS VARCHAR) AS scan_id, failure_id, test_name FROM d_run_failures),
a AS (SELECT CAST(CASE WHEN event_id % 19 = 0 THEN event_id + 1000000000 ELSE event_id END AS VARCHAR) AS scan_id, CASE event_type WHEN 'error' THEN 'python-2' WHEN 'purchase' THEN 'cpp-1' ELSE 'javascript-1' END AS failure_id FROM events)
SELECT a.scan_id, a.failure_id, f.test_name, CASE WHEN a.scan_id NOT IN (SELECT CAST(log_id AS VARCHAR) FROM run_logs) THEN 'no scan' WHEN f.test_name IS NULL THEN 'no failure' ELSE 'found' END AS answer FROM a LEFT JOIN f ON f.scan_id = a.scan_id AND f.failure_id = a.failure_id""")
def scan_failure_lookup(t):
    from cilens.operators import logs as L

    found = L.run_failures(t.run_logs).select(F.col("log_id").cast("string").alias("scan_id"), "failure_id", "test_name")
    unknown = F.when(F.col("event_id") % 19 == 0, F.col("event_id") + 1_000_000_000).otherwise(F.col("event_id"))
    asked = t.events.select(unknown.cast("string").alias("scan_id"), F.when(F.col("event_type") == "error", "python-2").when(
        F.col("event_type") == "purchase", "cpp-1").otherwise("javascript-1").alias("failure_id"))
    return R.scan_lookup(asked, t.run_logs.select(F.col("log_id").cast("string").alias("scan_id")), found)
