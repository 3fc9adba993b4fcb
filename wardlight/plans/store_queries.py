"""The small operators on stores, lists and forms, as-of joins and number readings over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.engine import catalog as c
from wardlight.functions import scalars as s
from wardlight.functions.sql_tokens import FUNCTIONS, KEYWORDS, sql_tokens
from wardlight.operators import audit, charts, privacy, routing, tables
from wardlight.plans.registry import LOGICAL_SQL, ORACLE, query
from wardlight.sources import stores
from wardlight.streaming.stateful import apply_billing


def _at(text: str):
    return F.lit(text).cast("timestamp")


# Personal data


@query("P1", "SELECT CAST(c_custkey AS VARCHAR) AS key, '[PHI REDACTED]' AS phone, CASE WHEN c_custkey % 2 = 0 THEN '[NATIONAL ID REDACTED]' ELSE CAST(c_custkey AS VARCHAR) END AS code, CASE WHEN c_custkey % 3 = 0 THEN '[NATIONAL ID REDACTED]' ELSE '0.5' END AS share, c_nationkey % 7 AS small FROM customer")
def scrubbed_numbers(spark, d):
    k = F.col("c_custkey")
    rows = c.table(spark, d, "customer").select(
        k.alias("key"),
        F.lit("555").alias("phone"),
        F.when(k % 2 == 0, F.lit(12345678901)).otherwise(k).alias("code"),
        F.when(k % 3 == 0, F.lit(98765432109.0)).otherwise(0.5).alias("share"),
        (F.col("c_nationkey") % 7).cast("int").alias("small"),
    )
    return privacy.scrub(rows, ["key"])


@query("P3", """WITH x AS (SELECT c_custkey AS k, 'id' || CAST(c_nationkey AS VARCHAR) AS mrn, CASE WHEN c_custkey % 4 = 0 THEN 'id' || CAST(c_nationkey AS VARCHAR) ELSE c_mktsegment END AS name FROM customer),
    v AS (SELECT mrn AS value, k * 2 AS p, false AS is_name FROM x UNION ALL SELECT name, k * 2 + 1, true FROM x), f AS (SELECT value, min(p) AS p, arg_min(is_name, p) AS is_name FROM v GROUP BY value),
    n AS (SELECT value, 'Patient-' || chr(CAST((row_number() OVER (ORDER BY p) - 1) % 26 + 65 AS INTEGER)) AS letter FROM f WHERE is_name)
    SELECT CAST(k AS VARCHAR) AS k, mrn LIKE 'id%' AS was_id, coalesce(n.letter, 'token') AS name FROM x LEFT JOIN n ON n.value = x.name""")
def shared_tokens(spark, d):
    """Names that were first seen as identifiers keep the identifiers' tokens."""
    code = F.concat(F.lit("id"), F.col("c_nationkey").cast("string"))
    rows = c.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), code.alias("mrn"), F.when(F.col("c_custkey") % 4 == 0, code).otherwise(F.col("c_mktsegment")).alias("name"))
    out = privacy.scrub(rows, ["k"])
    return out.select("k", F.col("mrn").startswith("PT-").alias("was_id"), F.when(F.col("name").startswith("PT-"), "token").otherwise(F.col("name")).alias("name"))


# Logs


@query("K2", "WITH p AS (SELECT seq, ts, user_id, rows_affected FROM audit WHERE rows_affected > 1000 OR (hour(ts) + 3) % 24 < 7 OR (hour(ts) + 3) % 24 > 22) SELECT strftime(ts, '%Y-%m-%d') AS day, seq AS \"eventId\", user_id AS \"userId\", concat_ws(',', CASE WHEN rows_affected > 1000 THEN 'BULK_EXPORT' END, CASE WHEN (hour(ts) + 3) % 24 < 7 OR (hour(ts) + 3) % 24 > 22 THEN 'OFF_HOURS' END) AS flags FROM p", "audit")
def anomaly_lines(spark, d):
    never = (60, 10**9)
    records = audit.anomaly_records(audit.anomalies(c.audit(spark, d), never, never, never))
    return records.select(F.left("timestamp", F.lit(10)).alias("day"), "eventId", "userId", F.array_join("flags", ",").alias("flags"))


@query("W9", "SELECT seq, reports, user_id, action FROM (SELECT seq, false AS reports, user_id, action FROM audit UNION ALL SELECT seq, true, user_id, 'QUERY_RUN' FROM audit WHERE rows_affected > 1000 OR (hour(ts) + 3) % 24 < 7 OR (hour(ts) + 3) % 24 > 22)", "audit")
def log_with_feedback(spark, d):
    never = (60, 10**9)
    log = c.audit(spark, d)
    return audit.with_feedback(log, audit.anomalies(log, never, never, never)).select("seq", "reports", "user_id", "action")


@query("K4", "SELECT seq, '\"' || action || '\",\"' || CAST(rows_affected AS VARCHAR) || '\",' AS line FROM audit", "audit")
def audit_csv(spark, d):
    log = c.audit(spark, d).select("seq", "action", "rows_affected", F.lit(None).cast("string").alias("detail"))
    return log.select("seq", stores.csv_line(["action", "rows_affected", "detail"], "").alias("line"))


@query("K9", "SELECT event_id, '[' || strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '.000Z] [' || CASE event_type WHEN 'error' THEN 'CRITICAL' ELSE 'INFO' END || '] webhook_received: ' || event_type || ' {\"id\":' || CAST(event_id AS VARCHAR) || ',\"customer\":' || CAST(user_id AS VARCHAR) || '}' AS line FROM events")
def billing_log(spark, d):
    e = c.table(spark, d, "events")
    level = F.when(F.col("event_type") == "error", "CRITICAL").otherwise("INFO")
    data = F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("customer"))
    return e.select("event_id", stores.billing_line(F.date_trunc("second", F.col("ts").cast("timestamp")), level, F.concat(F.lit("webhook_received: "), "event_type"), data).alias("line"))


@query("R5", """WITH e AS (SELECT user_id AS customer, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'payment_succeeded' WHEN 'error' THEN 'payment_failed' WHEN 'click' THEN 'subscription_updated' WHEN 'signup' THEN 'subscription_deleted' ELSE 'noted' END AS type,
      CASE WHEN event_id % 3 = 0 THEN 'tier' || CAST(event_id % 5 AS VARCHAR) END AS tier, CASE WHEN event_id % 7 = 0 THEN 'annual' END AS cycle FROM events),
    x AS (SELECT customer, arg_max(CASE type WHEN 'payment_succeeded' THEN 'active' WHEN 'payment_failed' THEN 'grace' ELSE 'suspended' END, seq) FILTER (type IN ('payment_succeeded', 'payment_failed', 'subscription_deleted')) AS status,
      arg_max(tier, seq) FILTER (type = 'subscription_updated' AND tier IS NOT NULL) AS tier, arg_max(cycle, seq) FILTER (type = 'subscription_updated' AND cycle IS NOT NULL) AS cycle FROM e GROUP BY customer)
    SELECT c_custkey AS customer, coalesce(x.status, 'trial') AS status, coalesce(x.tier, 'growth') AS tier, coalesce(x.cycle, 'monthly') AS cycle FROM customer LEFT JOIN x ON x.customer = c_custkey""")
def billed_licenses(spark, d):
    kind = F.create_map(*[F.lit(x) for kv in {"view": "payment_succeeded", "error": "payment_failed", "click": "subscription_updated", "signup": "subscription_deleted", "purchase": "noted"}.items() for x in kv])
    e = c.table(spark, d, "events").select(
        F.col("user_id").alias("customer"),
        kind[F.col("event_type")].alias("type"),
        F.col("ts").cast("timestamp").alias("at"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("tier"), (F.col("event_id") % 5).cast("string"))).alias("tier"),
        F.when(F.col("event_id") % 7 == 0, "annual").alias("cycle"),
    )
    held = c.table(spark, d, "customer").select(F.col("c_custkey").alias("customer"), F.lit("trial").alias("status"), F.lit(None).cast("timestamp").alias("grace_end"), F.lit("growth").alias("tier"), F.lit("monthly").alias("cycle"))
    return apply_billing(held, e).select("customer", "status", "tier", "cycle")


# Filters and lists


_BOARD = "o_orderstatus = 'F'"


@query("F7", f"SELECT 'orders' AS widget, count(*) AS n FROM orders WHERE {_BOARD} UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_quantity >= 30 UNION ALL SELECT 'units', count(*) FROM supplier")
def dashboard_filters(spark, d):
    widgets = {"orders": c.table(spark, d, "orders"), "lines": c.table(spark, d, "lineitem"), "units": c.table(spark, d, "supplier")}
    filters = [charts.Filter("o_orderstatus", "=", "F"), charts.Filter("l_quantity", ">=", 30), charts.Filter("s_name", "=", None)]
    counts = [data.agg(F.lit(name).alias("widget"), F.count("*").alias("n")) for name, data in charts.of_dashboard(widgets, filters).items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("F9", "SELECT event_id FROM events WHERE event_type <> 'view'")
def unread(spark, d):
    notes = c.table(spark, d, "events").select("event_id", (F.col("event_type") == "view").alias("read"))
    return notes.filter(~F.col("read")).select("event_id")


@query("F10", "SELECT column_name AS name, CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'date' ELSE 'text' END AS kind FROM (SELECT column_name, column_type AS data_type FROM (DESCRIBE SELECT * FROM orders))")
def column_kinds(spark, d):
    return spark.createDataFrame(c.column_kinds(c.table(spark, d, "orders").schema), "name string, kind string")


@query("F16", "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 1")
def offered(spark, d):
    k = F.col("c_custkey")
    t = c.table(spark, d, "customer").select("c_custkey", F.when(k % 3 == 0, "eclinics").when(k % 3 == 1, "telehealth").alias("catalog"))
    return t.filter(routing.in_catalog(F.col("catalog"), F.lit("eclinics"))).select("c_custkey")


@query("F18", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY o_orderkey LIMIT 1")
def point_lookup(spark, d):
    o = c.table(spark, d, "orders")
    least = o.agg(F.min("o_custkey")).first()[0]
    return tables.lookup(o, "o_custkey", least, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("F20", "SELECT c_custkey FROM customer WHERE contains('user' || CAST(c_custkey AS VARCHAR), 'b') OR contains(lower(c_mktsegment), 'b')")
def mention_candidates(spark, d):
    username = F.concat(F.lit("user"), F.col("c_custkey").cast("string"))
    return c.table(spark, d, "customer").filter(s.mention_candidate(username, F.col("c_mktsegment"), F.lit("b"))).select("c_custkey")


@query("F21", "SELECT 'All' AS asked, count(*) AS n FROM part UNION ALL SELECT 'Brand#1', count(*) FROM part WHERE p_brand = 'Brand#1'")
def templates_of(spark, d):
    items = c.table(spark, d, "part").withColumnRenamed("p_brand", "category")
    count = lambda asked: charts.of_category(items, asked).agg(F.lit(asked).alias("asked"), F.count("*").alias("n"))
    return count("All").unionByName(count("Brand#1"))


@query("F27", """SELECT event_id, concat_ws(',', CASE WHEN event_id % 2 = 0 THEN 'name' END, CASE WHEN event_id % 3 = 0 THEN 'value' END, CASE WHEN event_id % 5 = 0 THEN 'channels' END) AS alert,
    concat_ws(',', CASE WHEN event_id % 2 = 0 THEN 'name' END, CASE WHEN event_id % 5 = 0 THEN 'dashboards' END, CASE WHEN event_id % 7 = 0 THEN 'deliveries' END, CASE WHEN event_id % 7 <> 0 AND event_id % 3 = 0 THEN 'email' END) AS report FROM events""")
def form_errors(spark, d):
    k = F.col("event_id")
    some = lambda n, x: F.when(k % n == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(x)))
    name = F.when(k % 2 == 0, "  ").otherwise("n")
    alert = tables.alert_errors(name, F.when(k % 3 == 0, "1 percent").otherwise(F.col("value").cast("string")), some(5, "Email"))
    report = tables.report_errors(name, some(5, "ICU"), some(7, "Email"), F.when(k % 3 == 0, " ").otherwise("a@b.c"))
    return c.table(spark, d, "events").select("event_id", F.array_join(alert, ",").alias("alert"), F.array_join(report, ",").alias("report"))


@query("L5", "SELECT o_orderkey, 15 AS most FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15) UNION ALL SELECT o_orderkey, 50 FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)")
def first_rows(spark, d):
    o, order = c.table(spark, d, "orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    some = lambda n: tables.sample_rows(o, order, n).select("o_orderkey", F.lit(n).alias("most"))
    return some(15).unionByName(some(50))


@query("L7", "SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey, s_suppkey) - 1 AS place FROM supplier")
def ordered_widgets(spark, d):
    return tables.numbered(c.table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), ["s_nationkey", "s_suppkey"], "place").select("s_suppkey", "place")


@query("L8", "SELECT conv_id, turn, CASE WHEN (length(text) - length(replace(text, 'a', ''))) > (length(text) - length(replace(text, 'e', ''))) THEN 'telehealth' ELSE 'eclinics' END AS catalog FROM conversations")
def chosen_catalog(spark, d):
    score = lambda x: F.length("text") - F.length(F.replace("text", F.lit(x), F.lit("")))
    return c.table(spark, d, "conversations").select("conv_id", "turn", routing.catalog_choice(score("a"), score("e")).alias("catalog"))


@query("L10", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 40")
def by_header(spark, d):
    return tables.sorted_by(c.table(spark, d, "part"), "p_size", True, "p_partkey").limit(40).select("p_partkey", "p_size")


@query("U2_order", "SELECT id, row_number() OVER (ORDER BY source, position, id) - 1 AS position FROM (SELECT s_suppkey AS id, 0 AS source, -s_suppkey AS position FROM supplier UNION ALL SELECT c_custkey, 1, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier))")
def merged_in_order(spark, d):
    local = c.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (-F.col("s_suppkey")).cast("long").alias("position"))
    other = c.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("position"))
    return tables.in_order(local, other, "id").select("id", "position")


@query("U3_order", "SELECT id, segment, row_number() OVER (ORDER BY side, place, id) - 1 AS position FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment, 0 AS side, -c_custkey AS place FROM customer UNION ALL SELECT s_suppkey + 10000000, 'new', -1, NULL FROM supplier)")
def upserted_in_order(spark, d):
    held = c.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), (-F.col("c_custkey")).cast("long").alias("position"))
    new = held.filter("id % 3 = 0").select("id", F.lit("new").alias("segment")).unionByName(c.table(spark, d, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("id"), F.lit("new").alias("segment")))
    return tables.upsert_in_place(held, new, "id").select("id", "segment", "position")


# Joins, aggregates and readings


@query("J10", "SELECT a.event_id, b.event_id AS latest FROM events a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts WHERE a.event_type = 'purchase'")
def latest_view(spark, d):
    e = c.table(spark, d, "events")
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return tables.as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "view_id").select("event_id", "latest")


@query("A19", "SELECT o_orderstatus, quantile_disc(o_totalprice, 0.5) AS middle, quantile_disc(o_totalprice, 0.95) AS high, count(DISTINCT o_custkey) > 0 AS some FROM orders GROUP BY 1")
def percentiles(spark, d):
    """percentile_approx is exact up to its accuracy in distinct values; approx_count_distinct has 5 % of error."""
    p = F.percentile_approx("o_totalprice", [0.5, 0.95], 1_000_000)
    out = c.table(spark, d, "orders").groupBy("o_orderstatus").agg(p.alias("p"), F.approx_count_distinct("o_custkey", 0.05).alias("n"))
    return out.select("o_orderstatus", F.col("p")[0].alias("middle"), F.col("p")[1].alias("high"), (F.col("n") > 0).alias("some"))


@query("A21_clinical", """WITH v AS (SELECT DISTINCT Id, PatientId, AcceptanceDate, Status FROM acceptances),
    f AS (SELECT *, coalesce(date_diff('day', lag(AcceptanceDate) OVER (PARTITION BY PatientId ORDER BY AcceptanceDate, Id), AcceptanceDate) <= 30, false) AS again FROM v),
    a AS (SELECT AcceptanceDate AS at, CAST(count(*) AS DOUBLE) AS admissions, CAST(count(*) FILTER (again) AS DOUBLE) / count(*) AS readmissions, CAST(count(*) FILTER (Status = 'P') AS DOUBLE) AS ventilated, CAST(count(*) FILTER (Status = 'F') AS DOUBLE) AS mortality FROM f GROUP BY 1),
    l AS (SELECT AcceptanceDate AS at, CAST(sum(LengthOfStay) AS DOUBLE) / count(*) AS stay FROM acceptances GROUP BY 1)
    SELECT a."at" AS "at", u.metric, round(u.reading, 9) AS reading FROM a JOIN l ON l."at" = a."at", LATERAL (VALUES ('Daily Admissions', admissions), ('Readmission Rate', readmissions), ('Ventilator Count', ventilated), ('Mortality Flag Count', mortality), ('Average LOS (days)', stay)) AS u(metric, reading)""", "acceptances")
def clinical_metrics(spark, d):
    return charts.clinical_readings(c.acceptances(spark, d)).withColumn("reading", F.round("reading", 9))


@query("A21_beds", "SELECT u.Id AS unit, 100.0 * count(a.Id) / max(Capacity) AS reading FROM units u LEFT JOIN acceptances a ON a.UnitId = u.Id AND a.AcceptanceDate <= DATE '2001-07-18' AND a.DischargeDate > DATE '2001-07-18' GROUP BY 1", "acceptances units")
def beds(spark, d):
    return charts.occupancy(c.units(spark, d), c.acceptances(spark, d), "2001-07-18")


@query("A21_waits", "WITH f AS (SELECT user_id, CAST(ts AS DATE) AS \"at\", min(ts) AS arrived, min(ts) FILTER (event_type = 'click') AS served FROM events GROUP BY 1, 2) SELECT \"at\", sum(CAST(epoch_us(served) - epoch_us(arrived) AS DOUBLE)) / count(*) / 60000000 AS reading FROM f WHERE served IS NOT NULL GROUP BY 1")
def waits(spark, d):
    return charts.waiting_minutes(c.table(spark, d, "events"), "user_id", "ts", F.col("event_type") == "click")


# Texts


@query("P10_short", "WITH x AS (SELECT event_id, event_type, CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 60000000.0) AS BIGINT) AS m FROM events) SELECT event_id, CASE WHEN event_type = 'signup' THEN 'Never' WHEN m < 60 THEN CAST(m AS VARCHAR) || 'm ago' WHEN m < 1440 THEN CAST(m // 60 AS VARCHAR) || 'h ago' ELSE CAST(m // 1440 AS VARCHAR) || 'd ago' END AS ago FROM x")
def short_ages(spark, d):
    then = F.when(F.col("event_type") != "signup", F.col("ts").cast("timestamp"))
    return c.table(spark, d, "events").select("event_id", s.short_age(then, _at("2024-01-31")).alias("ago"))


@query("P10_due", "WITH x AS (SELECT event_id, ts, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 00:00:00')) / 60000000.0) AS BIGINT) AS m FROM events) SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'Overdue' WHEN m < 60 THEN 'in ' || CAST(m AS VARCHAR) || 'm' WHEN m < 1440 THEN 'in ' || CAST(m // 60 AS VARCHAR) || 'h' ELSE 'in ' || CAST(m // 1440 AS VARCHAR) || 'd' END AS due FROM x")
def dues(spark, d):
    return c.table(spark, d, "events").select("event_id", s.due_in(F.col("ts").cast("timestamp"), _at("2024-01-15")).alias("due"))


@query("P14", "SELECT o_orderkey, '00:00:' || lpad(CAST(o_orderkey * 37 // 1000 AS VARCHAR), CAST(greatest(2, length(CAST(o_orderkey * 37 // 1000 AS VARCHAR))) AS INTEGER), '0') || '.' || lpad(CAST(o_orderkey * 37 % 1000 // 10 AS VARCHAR), 2, '0') AS took FROM orders")
def timers(spark, d):
    return c.table(spark, d, "orders").select("o_orderkey", s.elapsed(F.col("o_orderkey") * 37).alias("took"))


@query("P15", "SELECT conv_id, turn, left(text, 300) AS detail, left(text, 200) AS short FROM conversations")
def clipped(spark, d):
    return c.table(spark, d, "conversations").select("conv_id", "turn", s.clipped(F.col("text")).alias("detail"), s.clipped(F.col("text"), 200).alias("short"))


@query("P17", "SELECT o_orderkey, '$' || format('{:,}', o_orderkey // 100) || '.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS amount, o_custkey * 12 - o_orderkey AS saving FROM orders")
def amounts(spark, d):
    k = F.col("o_orderkey")
    return c.table(spark, d, "orders").select("o_orderkey", s.money(k).alias("amount"), s.annual_saving(F.col("o_custkey"), k).alias("saving"))


@query("P18", "SELECT 'o_orderkey' AS x, 'o_custkey' AS y, CAST(sum(o_custkey) AS DOUBLE) AS total FROM orders")
def default_axes(spark, d):
    data = c.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    x, y = charts.axes(data.columns)
    return charts.big_number(data, y).select(F.lit(x).alias("x"), F.lit(y).alias("y"), "total")


@query("P19", "SELECT conv_id, turn, array_to_string(string_split(regexp_replace(role || ' @Ann_1, see' || left(text, 20) || '@bob!', '(@[A-Za-z0-9_]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), '|') AS parts FROM conversations")
def mention_parts(spark, d):
    text = F.concat("role", F.lit(" @Ann_1, see"), F.left("text", F.lit(20)), F.lit("@bob!"))
    return c.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(s.mention_parts(text), "|").alias("parts"))


@query("S10", "SELECT t AS name, column_name AS field, CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT', 'SMALLINT') THEN 'numeric' WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'date' ELSE 'text' END AS kind FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS t, column_name, column_type AS data_type FROM (DESCRIBE {t})" for t in ("customer", "orders", "part", "events")) + ")")
def registry(spark, d):
    """The static table of datasets, with the kinds of their columns."""
    rows = [(t, *x) for t in ("customer", "orders", "part", "events") for x in c.column_kinds(c.table(spark, d, t).schema)]
    return spark.createDataFrame(rows, "name string, field string, kind string")


@query("P21", "SELECT string_agg(line, chr(10) ORDER BY n) AS text FROM (" + " UNION ALL ".join(f"SELECT {n} AS n, '{t}(' || (SELECT string_agg(column_name, ', ') FROM (DESCRIBE {t})) || ')' AS line" for n, t in enumerate(("customer", "orders", "part"))) + ")")
def schema_texts(spark, d):
    text = "\n".join(c.schema_text(c.table(spark, d, t).schema, t) for t in ("customer", "orders", "part"))
    return spark.createDataFrame([(text,)], "text string")


@query("Q1", None)
def token_counts(spark, d):
    """Tokens by class of statements made of the conversations' words; compared with an independent tokenizer in the tests."""
    text = F.concat(F.lit('SELECT count(*) FROM "t" WHERE x = \''), F.replace("text", F.lit("'"), F.lit(" ")), F.lit("' AND y >= 12.5 -- end"))
    kinds = c.table(spark, d, "conversations").select(F.explode(sql_tokens(text)).alias("t"))
    return kinds.groupBy(F.col("t.kind").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("t.value")).alias("chars"))


assert len(FUNCTIONS) == 36 and len(set(KEYWORDS)) == len(KEYWORDS)
# Words of names are code points in order; h = h * 31 + c, or h * 33 xor c, by 32 bits.
_codes = "list_prepend(CAST({} AS BIGINT), list_transform(regexp_extract_all({}, '(?s).'), lambda x: CAST(ord(x) AS BIGINT)))"
_signed = "CASE WHEN {0} >= 2147483648 THEN {0} - 4294967296 ELSE {0} END"
ORACLE["P2"] = f"WITH x AS (SELECT c_custkey, list_reduce({_codes.format(0, 'c_name')}, lambda h, v: (h * 31 + v) & 4294967295) AS h FROM customer) SELECT c_custkey, 'PT-' || printf('%08X', abs({_signed.format('h')})) AS token FROM x"
ORACLE["P5"] = f"SELECT c_custkey, lower(to_base(list_reduce({_codes.format(5381, chr(99) + '_name || chr(124) || c_mktsegment')}, lambda h, v: xor((h * 33) & 4294967295, v)), 36)) AS key FROM customer"
ORACLE["P7"] = (
    f"WITH x AS (SELECT c_custkey, list_reduce({_codes.format(0, 'c_name')}, lambda h, v: v - h + ({_signed.format('((h * 32) & 4294967295)')})) AS h FROM customer) "
    f"SELECT c_custkey, [{', '.join(repr(x) for x in s.PALETTE)}][CAST(abs(h) % 8 + 1 AS INTEGER)] AS color FROM x"
)
# Lines are chained 64 at a time: a step of the recursion sees one part of the log.
_previous = "CASE WHEN done[-1] IS NULL THEN repeat('0', 64) ELSE sha256(done[-1]) END"
_line = f"""body[1] || {_previous} || '","hash":"' || sha256({_previous} || body[1] || {_previous} || '"}}') || '"}}'"""
ORACLE["H1"] = f"""WITH RECURSIVE {LOGICAL_SQL['audit']}, b AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS pos, '{{"id":' || CAST(seq AS VARCHAR) || ',"timestamp":"' || regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '\\.?0+$', '') || '","action":"' || action || '","rowsAffected":' || CAST(rows_affected AS VARCHAR) || ',"previousHash":"' AS body FROM audit),
    c AS (SELECT pos // 64 AS part, list([body] ORDER BY pos) AS bodies FROM b GROUP BY 1),
    r(part, lines) AS (SELECT CAST(-1 AS BIGINT), [CAST(NULL AS VARCHAR)] UNION ALL
      SELECT c.part, list_reduce(list_prepend([lines[-1]], bodies), lambda done, body: list_append(done, {_line}))[2:] FROM r JOIN c ON c.part = r.part + 1)
    SELECT CAST(part * 64 + i AS BIGINT) AS pos, line FROM (SELECT part, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM r WHERE part >= 0)"""
