"""Billing, stock and metric queries."""

from pyspark.sql import functions as F

from cilens import rules
from cilens.operators import commerce as C, metrics as M
from cilens.plans.records import _TOKEN_SQL, _token
from cilens.operators.records import token_shape
from cilens.plans.registry import cte, query
from cilens.session import cut_lineage
from cilens.streaming import stock as S

STATES = ("CA", "NY", "tx ", "FL", "WA", "IL", "MA", "NC", "GA", "OH", "PA", "ZZ")
COUPONS = ("SAVE10", "save20", "ENTERPRISE50", "ENTERPRISE100", "BOGUS")
PLANS = ("starter", "Pro", "enterprise", "custom", "free")


def pick(values, number):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _pick_sql(values, number):
    return f"([{', '.join(repr(v) for v in values)}])[({number}) % {len(values)} + 1]"


_STATE = _pick_sql(STATES, "c_nationkey")
_RATE = f"CASE upper(trim(state)) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.TAX_RATES.items()) + " ELSE 0.05 END"
_HOME = "CASE " + " ".join(f"WHEN upper(trim(state)) IN ({', '.join(repr(s) for s in v)}) THEN '{k}'" for k, v in rules.WAREHOUSES.items()) + " ELSE 'WH_MAIN' END"
_PLAN = lambda c: f"CASE lower({c}) WHEN 'starter' THEN 29.00 WHEN 'pro' THEN 99.00 WHEN 'enterprise' THEN 499.00 WHEN 'custom' THEN 1499.00 ELSE 29.00 END"
_TIER = "CASE WHEN quantity >= 100 THEN 0.20 WHEN quantity >= 50 THEN 0.15 WHEN quantity >= 10 THEN 0.10 ELSE 0.00 END"
cte("d_headers", f"""
SELECT o_orderkey AS order_id, {_STATE} AS state, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {_pick_sql(COUPONS, 'o_orderkey')} END AS coupon FROM orders JOIN customer ON o_custkey = c_custkey""")
cte("d_sums", """
SELECT l_orderkey AS order_id, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,4)) * CAST(l_quantity AS DECIMAL(10,0))) AS DECIMAL(20,4)) AS subtotal, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1""")
cte("d_invoices", f"""
WITH a AS (SELECT h.order_id, state, upper(coalesce(coupon, '')) AS coupon, coalesce(subtotal, 0)::DECIMAL(20,4) AS subtotal, coalesce(quantity, 0) AS quantity FROM d_headers h LEFT JOIN d_sums USING (order_id)),
b AS (SELECT *, CAST(subtotal * CAST({_TIER} AS DECIMAL(3,2)) AS DECIMAL(22,6)) + CASE coupon WHEN 'SAVE10' THEN CAST(round(subtotal * 0.10::DECIMAL(3,2), 2) AS DECIMAL(22,6)) WHEN 'SAVE20' THEN CAST(round(subtotal * 0.20::DECIMAL(3,2), 2) AS DECIMAL(22,6)) WHEN 'ENTERPRISE50' THEN least(subtotal, 50) WHEN 'ENTERPRISE100' THEN least(subtotal, 100) ELSE 0 END AS discount FROM a),
c AS (SELECT *, greatest(0, subtotal - discount)::DECIMAL(24,6) AS taxable FROM b),
d AS (SELECT *, round(taxable * CAST({_RATE} AS DECIMAL(6,5)), 2) AS tax FROM c)
SELECT order_id, CAST(round(subtotal, 2) AS DOUBLE) AS subtotal, CAST(round(discount, 2) AS DOUBLE) AS discount, CAST(round(taxable, 2) AS DOUBLE) AS taxable_amount, CAST(tax AS DOUBLE) AS tax_amount, CAST(round(taxable + tax, 2) AS DOUBLE) AS total FROM d""")


def headers(t):
    homes = t.customer.select(F.col("c_custkey").alias("o_custkey"), pick(STATES, F.col("c_nationkey")).alias("state"))
    coupon = F.when(F.col("o_orderkey") % 7 != 0, pick(COUPONS, F.col("o_orderkey")))
    return t.orders.select("o_custkey", F.col("o_orderkey").alias("order_id"), coupon.alias("coupon")).join(homes, "o_custkey").drop("o_custkey")


def items(t):
    return t.lineitem.select(F.col("l_orderkey").alias("order_id"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))


def invoices(t):
    return C.invoices(items(t), headers(t))


@query("a12_invoice_total", "SELECT * FROM d_invoices")
def invoice_total(t):
    return invoices(t)


@query("a13_order_total", """
SELECT l_orderkey AS order_id, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(20,4))) * 1.0625::DECIMAL(6,4), 4) AS DOUBLE) AS order_total, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,4)) * CAST(l_quantity AS DECIMAL(10,0))) AS DOUBLE) AS cart_total FROM lineitem GROUP BY 1""")
def order_total(t):
    return items(t).groupBy("order_id").agg(
        F.round(F.sum(C.money("price")).cast("decimal(24,4)") * F.lit("1.0625").cast("decimal(6,4)"), 4).cast("double").alias("order_total"),
        F.sum(C.money("price") * F.col("quantity").cast("decimal(10,0)")).cast("double").alias("cart_total"))


@query("a14_inventory_valuation", """
SELECT CAST(round(sum((available_qty + sku % 5) * CAST(unit_cost AS DECIMAL(18,4))), 2) AS DOUBLE) AS valuation FROM stock""")
def inventory_valuation(t):
    units = (F.col("available_qty") + F.col("sku") % 5).cast("decimal(18,0)")
    return t.stock.agg(F.round(F.sum(units * F.col("unit_cost").cast("decimal(18,4)")), 2).cast("double").alias("valuation"))


cte("d_tokens", f"SELECT o_orderkey AS order_id, o_orderdate AS ts, coalesce(length(tok) >= 10 AND starts_with(tok, 'Bearer_'), false) AS auth FROM orders JOIN (SELECT c_custkey, {_TOKEN_SQL} AS tok FROM customer) ON c_custkey = o_custkey")
cte("d_wants", "SELECT order_id, sku, sum(qty) AS qty, row_number() OVER (PARTITION BY sku ORDER BY any_value(d.ts), order_id) AS p FROM stock_requests q JOIN d_tokens d USING (order_id) WHERE auth GROUP BY order_id, sku")


# an order is settled as soon as it is first in line for all its products; then the next ones step forward
@query("a18_transactions", """
WITH RECURSIVE w(kind, id, val, line) USING KEY (kind, id) AS (
 SELECT 0 AS kind, sku AS id, CAST(max(coalesce(available_qty, -1)) AS BIGINT) AS val, CAST(1 AS BIGINT) AS line FROM d_wants LEFT JOIN stock USING (sku) GROUP BY sku
 UNION
 (WITH s AS (SELECT id AS sku, val, line FROM recurring.w WHERE kind = 0),
  h AS (SELECT order_id, count(*) AS n, bool_and(qty <= val) AS ok FROM d_wants JOIN s ON s.sku = d_wants.sku AND p = line GROUP BY order_id),
  r AS (SELECT order_id, ok FROM h JOIN (SELECT order_id, count(*) AS n FROM d_wants GROUP BY order_id) USING (order_id, n))
  SELECT 1, order_id, CAST(ok AS BIGINT), 0 FROM r
  UNION ALL SELECT 0, d.sku, s.val - CASE WHEN ok THEN qty ELSE 0 END, s.line + 1 FROM r JOIN d_wants d USING (order_id) JOIN s ON s.sku = d.sku)),
x AS (SELECT d.order_id, d.ts, auth, coalesce(val = 1, true) AS ok, total, last FROM d_tokens d JOIN d_invoices i USING (order_id) LEFT JOIN (SELECT id, val FROM w WHERE kind = 1) k ON k.id = d.order_id LEFT JOIN (SELECT order_id, max(ts) AS last FROM stock_requests GROUP BY 1) z ON z.order_id = d.order_id)
SELECT count(*) AS transactions, count(*) FILTER (NOT auth) AS auth_failures, count(*) FILTER (auth AND NOT ok) AS inventory_rejections, count(*) FILTER (auth AND ok) AS succeeded,
 CAST(sum(CAST(total AS DECIMAL(20,2))) FILTER (auth AND ok) AS DOUBLE) AS revenue, round(avg(epoch_ms(last) - epoch_ms(ts)) FILTER (auth AND ok), 3) AS latency_ms, CAST(max(epoch_ms(last) - epoch_ms(ts)) FILTER (auth AND ok) AS BIGINT) AS slowest_ms FROM x""")
def transactions(t):
    """Outcome of every order: token first, then stock that earlier orders have left for all its lines, then billing.

    A transaction lasts from its order to its last line.
    """
    tokens = t.customer.select(F.col("c_custkey").alias("o_custkey"), token_shape(_token()).alias("auth"))
    runs = cut_lineage(t.orders.select(F.col("o_orderkey").alias("order_id"), "o_custkey", F.col("o_orderdate").alias("ts")).join(tokens, "o_custkey").drop("o_custkey"))
    granted = C.settle(runs.where("auth"), t.stock_requests, t.stock)
    last = t.stock_requests.groupBy("order_id").agg(F.max("ts").alias("last"))
    millis = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    done = runs.join(granted, "order_id", "left").join(last, "order_id", "left").join(invoices(t).select("order_id", "total"), "order_id")
    good = F.col("auth") & F.col("granted")
    took = F.when(good, millis("last") - millis("ts"))
    return done.agg(F.count(F.lit(1)).alias("transactions"), F.count_if(~F.col("auth")).alias("auth_failures"), F.count_if(F.col("auth") & ~F.col("granted")).alias("inventory_rejections"),
                    F.count_if(good).alias("succeeded"), F.sum(F.when(good, F.col("total").cast("decimal(20,2)"))).cast("double").alias("revenue"),
                    F.round(F.avg(took), 3).alias("latency_ms"), F.max(took).alias("slowest_ms"))


@query("j17_default_lookup", f"""
SELECT c_custkey, CAST({_RATE} AS DOUBLE) AS tax_rate, CAST({_PLAN('plan')} AS DOUBLE) AS plan_rate, {_HOME} AS warehouse FROM (SELECT c_custkey, {_STATE} AS state, {_pick_sql(PLANS, 'c_custkey')} AS plan FROM customer)""")
def default_lookup(t):
    state, plan = pick(STATES, F.col("c_nationkey")), pick(PLANS, F.col("c_custkey"))
    return t.customer.select("c_custkey", C.tax_rate(state).cast("double").alias("tax_rate"), C.plan_rate(plan).cast("double").alias("plan_rate"), C.warehouse(state).alias("warehouse"))


@query("j18_tier_lookup", f"SELECT order_id, quantity, CAST({_TIER} AS DOUBLE) AS share, CAST(round(subtotal * CAST({_TIER} AS DECIMAL(3,2)), 2) AS DOUBLE) AS discount FROM d_sums")
def tier_lookup(t):
    sums = items(t).groupBy("order_id").agg(F.sum("quantity").alias("quantity"), F.sum(C.money("price") * F.col("quantity").cast("decimal(10,0)")).cast(C.MONEY).alias("subtotal"))
    share = C.tier_share(F.col("quantity"))
    return sums.select("order_id", "quantity", share.cast("double").alias("share"), F.round(F.col("subtotal") * share, 2).cast("double").alias("discount"))


@query("j19_availability", "SELECT order_id, line_no, sku, qty, ts::VARCHAR AS ts, coalesce(available_qty >= qty, false) AS available FROM stock_requests LEFT JOIN stock USING (sku)")
def availability(t):
    return C.available(t.stock_requests, t.stock).select("order_id", "line_no", "sku", "qty", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "available")


@query("f17_prorated_charge", f"""
SELECT c_custkey, CAST(round(greatest({_PLAN('np')} - {_PLAN('op')}, 0) * (c_custkey % 31) / 30.0 + 1e-9, 2) AS DOUBLE) AS charge FROM (SELECT c_custkey, {_pick_sql(PLANS, 'c_custkey')} AS op, {_pick_sql(PLANS, 'c_custkey // 5')} AS np FROM customer)""")
def prorated_charge(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", C.prorated(pick(PLANS, k), pick(PLANS, F.floor(k / 5)), k % 31).alias("charge"))


@query("f18_discount_and_division", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, CAST(round(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(5,4))), 4) AS DOUBLE) AS discounted,
 CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_quantity / (l_linenumber - 1) END AS quotient FROM lineitem""")
def discount_and_division(t):
    price, share = F.col("l_extendedprice").cast("decimal(18,4)"), F.col("l_discount").cast("decimal(5,4)")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", F.round(price * (F.lit(1) - share), 4).cast("double").alias("discounted"),
                             F.coalesce(F.try_divide(F.col("l_quantity"), F.col("l_linenumber") - 1), F.lit(0.0)).alias("quotient"))


@query("f19_nested_name", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 6 = 1 THEN 'Guest' ELSE 'Customer ' || CASE WHEN c_custkey % 2 = 0 THEN 'Even' ELSE 'Odd' END END AS name FROM customer""")
def nested_name(t):
    k = F.col("c_custkey")
    name = F.concat(F.lit("cUSTOMER "), F.when(k % 2 == 0, "even").otherwise("ODD"))
    record = F.when(k % 4 == 0, F.lit("{}")).when(k % 6 == 1, F.lit('{"profile": {"name": null}}')).otherwise(F.to_json(F.struct(F.struct(name.alias("name")).alias("profile"))))
    return t.customer.select(k, record.alias("record")).select("c_custkey", F.coalesce(F.initcap(F.get_json_object("record", "$.profile.name")), F.lit("Guest")).alias("name"))


@query("f21_reorder_products", "SELECT sku, available_qty FROM stock WHERE available_qty <= 10 * (sku % 20)")
def reorder_products(t):
    return t.stock.where(F.col("available_qty") <= rules.REORDER_THRESHOLD * (F.col("sku") % 20)).select("sku", "available_qty")


cte("d_stock_order", """
SELECT q.*, coalesce(s.available_qty, -1) AS available_qty, row_number() OVER (PARTITION BY sku ORDER BY ts, order_id, line_no, l_suppkey, l_extendedprice) AS p FROM stock_requests q LEFT JOIN stock s USING (sku)""")
_WALK = """WITH RECURSIVE w AS (SELECT sku, p, order_id, line_no, l_suppkey, l_extendedprice, ts, qty, qty <= available_qty AS granted, CASE WHEN qty <= available_qty THEN available_qty - qty ELSE available_qty END AS rest FROM d_stock_order WHERE p = 1
 UNION ALL SELECT d.sku, d.p, d.order_id, d.line_no, d.l_suppkey, d.l_extendedprice, d.ts, d.qty, d.qty <= w.rest, CASE WHEN d.qty <= w.rest THEN w.rest - d.qty ELSE w.rest END FROM w JOIN d_stock_order d ON d.sku = w.sku AND d.p = w.p + 1)"""


@query("t9_stock_reservation", _WALK + """
SELECT sku, order_id, line_no, qty, granted, CASE WHEN granted THEN 'RES_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END ELSE '' END AS reservation_id
FROM (SELECT *, row_number() OVER (PARTITION BY granted ORDER BY ts, order_id, line_no, l_suppkey, l_extendedprice, sku) AS n FROM w)""")
def stock_reservation(t):
    done = cut_lineage(S.reserve(t.stock_requests, t.stock))
    log = S.reservation_log(done).select("sku", "order_id", "line_no", "qty", "granted", "reservation_id")
    return log.unionByName(done.where("not granted").select("sku", "order_id", "line_no", "qty", "granted", F.lit("").alias("reservation_id")))


@query("t9_stock_release", _WALK + """
SELECT w.sku, CAST(w.reserved AS BIGINT) AS reserved, CAST(least(w.reserved, r.asked) AS BIGINT) AS released FROM (SELECT sku, sum(qty) AS reserved FROM w WHERE granted GROUP BY sku) w JOIN (SELECT sku, sum(qty) AS asked FROM stock_requests JOIN orders ON o_orderkey = order_id AND o_orderstatus = 'F' GROUP BY sku) r ON r.sku = w.sku""")
def stock_release(t):
    """Orders in status F give their lines back."""
    closed = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("order_id"))
    return S.release(S.reserve(t.stock_requests, t.stock), t.stock_requests.join(closed, "order_id").select("sku", "qty"))


# --- metrics -----------------------------------------------------------------------------

def points(t):
    return t.events.select(F.col("event_type").alias("name"), "ts", "event_id", "value")


@query("a15_percentile", "SELECT event_type AS name, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE rn = floor((n - 1) * 0.95::DOUBLE) + 1")
def percentile(t):
    return M.percentile_floor(points(t))


@query("a16_average", "SELECT event_type AS name, CAST(coalesce(sum(CAST(value AS DECIMAL(18,4))), 0) AS DOUBLE) / count(*) AS average FROM events GROUP BY 1")
def average(t):
    return points(t).groupBy("name").agg((F.coalesce(F.sum(F.col("value").cast("decimal(18,4)")), F.lit(0)).cast("double") / F.count(F.lit(1))).alias("average"))


_LAST5 = "(SELECT event_type AS name, sum(CAST(value AS DECIMAL(18,4))) AS s, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5 GROUP BY 1)"


@query("w5_moving_average", f"SELECT name, CAST(s AS DOUBLE) / n AS moving_average FROM {_LAST5}")
def moving_average(t):
    return M.latest_average(points(t)).withColumn("moving_average", F.col("moving_average").cast("double"))


@query("a17_metric_summary", f"""
SELECT a.name, CAST(round(CAST(s AS DOUBLE) / n + 1e-9, 2) AS DOUBLE) AS moving_average, round(p.value, 2) AS p95 FROM {_LAST5} a JOIN (SELECT event_type AS name, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE rn = floor((n - 1) * 0.95::DOUBLE) + 1) p USING (name)""")
def metric_summary(t):
    return M.summary(points(t))


@query("w6_outliers", """
WITH m AS (SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS s, CAST(sum(CAST(value AS DECIMAL(18,4)) * CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS ss FROM events GROUP BY 1),
k AS (SELECT event_type, n, s / n AS mean, sqrt(greatest(ss / n - (s / n) * (s / n), 0)) AS std FROM m)
SELECT event_type AS name, event_id, value, round(abs(value - mean) / std, 6) AS z FROM events JOIN k USING (event_type) WHERE n >= 5 AND std > 0 AND abs(value - mean) / std >= 3""")
def outliers(t):
    return M.outliers(points(t)).select("name", "event_id", "value", F.round("z", 6).alias("z"))


@query("w7_quota_usage", """
WITH u AS (SELECT provider, req_id, least(tokens, 240000) AS charge,
 count(*) OVER (PARTITION BY provider ORDER BY t_sec RANGE BETWEEN 59 PRECEDING AND 1 PRECEDING) AS rm, coalesce(sum(least(tokens, 240000)) OVER (PARTITION BY provider ORDER BY t_sec RANGE BETWEEN 59 PRECEDING AND 1 PRECEDING), 0) AS tm,
 count(*) OVER (PARTITION BY provider ORDER BY t_sec RANGE BETWEEN 86399 PRECEDING AND 1 PRECEDING) AS rd FROM api_requests)
SELECT provider, req_id, charge, rm AS requests_minute, CAST(tm AS BIGINT) AS tokens_minute, rd AS requests_day, rm >= 12 AS over_rpm, tm > 0 AND tm + charge > 240000 AS over_tpm, rd >= 480 AS over_rpd, rd + 1 = 384 AS daily_warning FROM u""")
def quota_usage(t):
    return M.quota_usage(t.api_requests)


@query("w12_span_duration", """
SELECT user_id AS trace_id, event_id AS span_id, coalesce((lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts)) / 1000, 0) AS duration_ms FROM events""")
def span_duration(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return M.span_durations(t.events.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), us.alias("us")))
