"""Queries of parsing, constraints, diagrams and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalars import micros, rounded
from tessera.functions.scalars import delta32 as wrapped
from tessera.operators import checks
from tessera.sources import logs
from tessera.sources.tables import UPDATES_SQL as U
from tessera.sources.tables import table, updates
from tessera.streaming import events as st

HOUR, DAY = 3_600_000_000, 86_400_000_000


def json_props_parse(spark, sf):
    e = table(spark, sf, "events").withColumn("p", F.from_json("props", "k INT, missing STRING"))
    return e.select("event_id", F.col("p.k").alias("k"), F.col("p.missing").isNull().alias("absent"), F.size(F.json_object_keys("props")).alias("keys"))


JSON = "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract(props, '$.missing') IS NULL AS absent, len(json_keys(props))::INTEGER AS keys FROM events"


def url_parts(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.expr("try_parse_url(url, 'PROTOCOL')").alias("scheme"), F.expr("try_parse_url(url, 'HOST')").alias("host"), F.expr("try_parse_url(url, 'PATH')").alias("path"))


URL = "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages"


def _raw(spark, sf):
    """Orders as text, some values missing and some broken."""
    o = table(spark, sf, "orders")
    price = F.when(F.col("o_orderkey") % 11 == 0, "").when(F.col("o_orderkey") % 13 == 0, "n/a").otherwise(F.col("o_totalprice").cast("decimal(20,2)").cast("string"))
    return o.select(F.col("o_orderkey").cast("string").alias("id"), price.alias("amount"), F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_custkey").cast("string")).alias("customer"), F.col("o_custkey").cast("string").alias("customer_old"), "o_orderstatus")


RULES = {"key": (["id"], "BIGINT"), "price": (["amount"], "DECIMAL(20,2)"), "cust": (["customer", "customer_old"], "BIGINT"), "region": (["region"], "STRING")}


def mapped_records(spark, sf):
    good, _ = logs.mapped(_raw(spark, sf), RULES)
    return good.select("key", F.col("price").cast("double").alias("price"), "s_price", "cust", "s_region", "o_orderstatus")


MAPPED = """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 11 <> 0 THEN round(o_totalprice, 2) END AS price, CASE WHEN o_orderkey % 11 = 0 THEN 3 ELSE 0 END AS s_price, o_custkey AS cust, 3 AS s_region, o_orderstatus FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 <> 0"""


def quarantined_records(spark, sf):
    _, bad = logs.mapped(_raw(spark, sf), RULES)
    return bad.select("id", "amount", "_quarantine")


QUARANTINED = "SELECT o_orderkey::VARCHAR AS id, 'n/a' AS amount, 'price' AS _quarantine FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0"


def cef_records(spark, sf):
    """Events written as CEF lines and read back."""
    e = updates(spark, sf)
    line = F.concat(F.lit("<13>host CEF:0|Acme|Probe|1.0|"), F.col("k").cast("string"), F.lit(r"|a\|b|"), (F.col("k") % 10).cast("string"), F.lit("|suser="), F.col("entity").cast("string"), F.lit(" act="), F.col("kind"), F.lit(" done msg=x"))
    c = e.select("seq", *logs.cef(line))
    return c.select("seq", "vendor", F.col("signature").cast("bigint").alias("k"), "name", F.col("severity").cast("int").alias("severity"), F.col("extension")["suser"].cast("bigint").alias("entity"), F.col("extension")["act"].alias("act"))


CEF = f"WITH {U} SELECT seq, 'Acme' AS vendor, k, 'a|b' AS name, (k % 10)::INTEGER AS severity, entity, kind || ' done' AS act FROM u"


def syslog_records(spark, sf):
    e = updates(spark, sf)
    head = F.concat(F.lit("<"), F.pmod("k", F.lit(192)).cast("string"), F.lit(">"))
    new = F.concat(head, F.lit("1 2024-01-01T00:00:00Z h1 app "), F.col("entity").cast("string"), F.lit(" - - it is "), F.col("kind"))
    old = F.concat(head, F.lit("Jan  1 00:00:00 h2 cron["), F.col("entity").cast("string"), F.lit("]: it is "), F.col("kind"))
    line = F.when(F.col("seq") % 3 == 0, new).when(F.col("seq") % 3 == 1, old).otherwise("broken")
    return e.select("seq", *logs.syslog(line)).drop("time")


SYSLOG = f"""WITH {U} SELECT seq, CASE WHEN seq % 3 < 2 THEN (k // 8)::INTEGER END AS facility, CASE WHEN seq % 3 < 2 THEN (k % 8)::INTEGER END AS severity, CASE seq % 3 WHEN 0 THEN 'h1' WHEN 1 THEN 'h2' END AS host,
  CASE seq % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'cron' END AS program, CASE WHEN seq % 3 < 2 THEN entity::VARCHAR END AS pid, CASE WHEN seq % 3 < 2 THEN 'it is ' || kind END AS message, CASE WHEN seq % 3 = 2 THEN 'not syslog' END AS _quarantine FROM u"""


def counter_deltas(spark, sf):
    """A counter of 32 bits that starts near its end."""
    from pyspark.sql import Window

    w = Window.partitionBy("entity").orderBy("us", "seq")
    u = updates(spark, sf).withColumn("counter", F.pmod(F.lit(4294967000) + F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1 << 32)))
    return u.select("seq", wrapped(F.col("counter"), F.lag("counter").over(w)).alias("delta"))


DELTA32 = f"WITH {U} SELECT seq, CASE WHEN lag(seq) OVER w IS NOT NULL THEN k END AS delta FROM u WINDOW w AS (PARTITION BY entity ORDER BY us, seq)"


def physics_residuals(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    rules = {"price_per_unit": "l_extendedprice / l_quantity - 2 * p_retailprice", "discount_below_tax": "l_discount - l_tax", "returned_is_final": "CASE WHEN l_returnflag = 'R' THEN CAST(l_linestatus = 'O' AS INT) END"}
    return checks.residuals(li, rules, ["l_linestatus"]).select("l_linestatus", "rule", "checked", "broken", rounded(F.col("mean_excess")).alias("mean_excess"), rounded(F.col("largest")).alias("largest"))


PHYSICS = """WITH r AS (SELECT l_linestatus, unnest(['price_per_unit', 'discount_below_tax', 'returned_is_final']) AS rule, unnest([l_extendedprice / l_quantity - 2 * p_retailprice, l_discount - l_tax, CASE WHEN l_returnflag = 'R' THEN (l_linestatus = 'O')::INT::DOUBLE END]) AS x FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_linestatus, rule, count(x) AS checked, count(x) FILTER (x > 0) AS broken, round(avg(x) FILTER (x > 0), 6) AS mean_excess, round(max(x) FILTER (x > 0), 6) AS largest FROM r GROUP BY 1, 2"""


def _diagram(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderpriority", micros("o_orderdate").alias("birth"), (micros("o_orderdate") + DAY * (1 + F.col("o_custkey") % 30)).alias("death"))


def betti_curve(spark, sf):
    return checks.betti_curve(_diagram(spark, sf), ["o_orderpriority"], "birth", "death")


DIAGRAM = f"d AS (SELECT o_orderpriority, epoch_us(o_orderdate) AS birth, epoch_us(o_orderdate) + {DAY} * (1 + o_custkey % 30) AS death FROM orders)"
BETTI = f"WITH {DIAGRAM}, e AS (SELECT o_orderpriority, birth AS t, 1 AS d FROM d UNION ALL SELECT o_orderpriority, death, -1 FROM d), s AS (SELECT o_orderpriority, t, sum(d) AS d FROM e GROUP BY 1, 2) SELECT o_orderpriority, t, (sum(d) OVER (PARTITION BY o_orderpriority ORDER BY t))::BIGINT AS alive FROM s"


def diagram_summary(spark, sf):
    d = _diagram(spark, sf).withColumns({"birth": F.col("birth") / DAY, "death": F.col("death") / DAY})
    return checks.diagram_summary(d, ["o_orderpriority"], "birth", "death").select("o_orderpriority", "n", *(rounded(F.col(c)).alias(c) for c in ("total", "largest", "entropy")))


DIAGRAM_SUMMARY = f"WITH {DIAGRAM}, l AS (SELECT o_orderpriority, (death - birth) / {DAY} AS l FROM d) SELECT o_orderpriority, count(*) AS n, round(sum(l), 6) AS total, round(max(l), 6) AS largest, round(ln(sum(l)) - sum(l * ln(l)) / sum(l), 6) AS entropy FROM l GROUP BY 1"


def trigger_audit(spark, sf):
    u = updates(spark, sf).select((F.col("us") - F.when(F.col("k") < 90, F.pmod("us", F.lit(60_000_000))).otherwise(0)).alias("t"), F.when(F.col("kind") == "error", "priority").otherwise("cadence").alias("what"))
    return checks.trigger_audit(u, "t", "what", 60_000_000, 1)


AUDIT = f"""WITH {U}, a AS (SELECT us - CASE WHEN k < 90 THEN us % 60000000 ELSE 0 END AS t, CASE WHEN kind = 'error' THEN 'priority' ELSE 'cadence' END AS what FROM u)
SELECT (SELECT count(*) FROM a WHERE what = 'cadence' AND t % 60000000 <> 0) AS off_grid, (SELECT count(*) FROM (SELECT t // 60000000 FROM a WHERE what = 'priority' GROUP BY 1 HAVING count(*) > 1)) AS crowded"""


def stream_tumbling(spark, sf):
    return st.all_available(st.tumbling(st.event_stream(spark, sf), ["event_type"], "6 hours", "1 hour", "value"), "tumbling").withColumn("total", rounded(F.col("total")))


STREAM = "s AS (SELECT *, epoch_us(ts) AS us FROM events)"
STREAM_TUMBLING = f"WITH {STREAM} SELECT event_type, us // {6 * HOUR} * {6 * HOUR} AS start, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY 1, 2 HAVING us // {6 * HOUR} * {6 * HOUR} + {6 * HOUR} <= (SELECT (max(us) // 1000) * 1000 - {HOUR} FROM s)".replace("HAVING us //", "HAVING min(us) //")


def stream_sliding(spark, sf):
    return st.all_available(st.sliding(st.event_stream(spark, sf), ["event_type"], "12 hours", "6 hours", "1 hour"), "sliding")


STREAM_SLIDING = f"WITH {STREAM}, w AS (SELECT event_type, unnest([us // {6 * HOUR}, us // {6 * HOUR} - 1]) * {6 * HOUR} AS start FROM s) SELECT event_type, start, count(*) AS n FROM w WHERE start + {12 * HOUR} <= (SELECT (max(us) // 1000) * 1000 - {HOUR} FROM s) GROUP BY 1, 2"


def stream_sessions(spark, sf):
    return st.all_available(st.sessions(st.event_stream(spark, sf), ["user_id"], "2 hours", "1 hour"), "sessions")


STREAM_SESSIONS = f"""WITH {STREAM}, g AS (SELECT user_id, us, CASE WHEN us - lag(us) OVER w < {2 * HOUR} THEN 0 ELSE 1 END AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY us)), i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT user_id, min(us) AS start, max(us) + {2 * HOUR} AS stop, count(*) AS n FROM i GROUP BY user_id, i HAVING max(us) + {2 * HOUR} <= (SELECT (max(us) // 1000) * 1000 - {HOUR} FROM s)"""


def stream_late_rows(spark, sf):
    s = st.event_stream(spark, sf).withColumn("turn", (F.pmod("event_id", F.lit(97)) * 100_000_000 + F.col("event_id")))
    return st.all_available(st.tag_late(s, "user_id", "turn"), "late").select("user_id", "us", "lateness")


STREAM_LATE = f"WITH {STREAM} SELECT user_id, us, greatest(0, coalesce(max(us) OVER (PARTITION BY user_id ORDER BY event_id % 97 * 100000000 + event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - us, 0)) AS lateness FROM s"

QUERIES = {f.__name__: f for f in (
    json_props_parse, url_parts, mapped_records, quarantined_records, cef_records, syslog_records, counter_deltas, physics_residuals, betti_curve, diagram_summary, trigger_audit, stream_tumbling,
    stream_sliding, stream_sessions, stream_late_rows,
)}
ORACLE = {
    "json_props_parse": JSON, "url_parts": URL, "mapped_records": MAPPED, "quarantined_records": QUARANTINED, "cef_records": CEF, "syslog_records": SYSLOG, "counter_deltas": DELTA32,
    "physics_residuals": PHYSICS, "betti_curve": BETTI, "diagram_summary": DIAGRAM_SUMMARY, "trigger_audit": AUDIT, "stream_tumbling": STREAM_TUMBLING, "stream_sliding": STREAM_SLIDING,
    "stream_sessions": STREAM_SESSIONS, "stream_late_rows": STREAM_LATE,
}
