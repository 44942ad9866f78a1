"""Queries of bounds, label shares and stationarity, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalars import floor_div, rounded
from tessera.operators import audit
from tessera.plans.scores import mapped_labels
from tessera.plans.scores import MAPPED as LABELS_SQL
from tessera.sources.tables import UPDATES_SQL as U
from tessera.sources.tables import updates

HOUR, LAGS = 3_600_000_000, 6


def error_bounds(spark, sf):
    """How well k tells the kind of an event, by status."""
    out = audit.error_bounds(updates(spark, sf), "k", "kind", ["status"])
    return out.select("status", "n", "classes", *(rounded(F.col(c)).alias(c) for c in ("bits", "error", "fano", "hellman_raviv", "coefficient")))


BOUNDS = f"""WITH RECURSIVE {U}, c AS (SELECT status, k, kind, count(*) AS n FROM u WHERE kind IS NOT NULL GROUP BY 1, 2, 3),
g AS (SELECT status, sum(m) AS n, sum(best) AS best, sum(m * ln(m) - i) / sum(m) AS nats FROM (SELECT status, k, sum(n) AS m, max(n) AS best, sum(n * ln(n)) AS i FROM c GROUP BY 1, 2) GROUP BY 1),
l AS (SELECT status, count(*) AS classes, sum(m * ln(m)) AS own FROM (SELECT status, kind, sum(n) AS m FROM c GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT status, n, classes, best, greatest(0, nats) / ln(2) AS bits, greatest(0, ln(n) - own / n - greatest(0, nats)) AS shared FROM g JOIN l USING (status)),
f AS (SELECT status, 0 AS step, 0.0::DOUBLE AS lo, (1 - 1.0 / classes)::DOUBLE AS hi FROM b UNION ALL
  SELECT status, step + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT f.*, (lo + hi) / 2 AS mid, -((lo + hi) / 2 * log2((lo + hi) / 2) + (1 - (lo + hi) / 2) * log2(1 - (lo + hi) / 2)) + (lo + hi) / 2 * log2(classes - 1) >= bits AS ok FROM f JOIN b USING (status) WHERE step < 50 AND classes > 1))
SELECT status, n::BIGINT AS n, classes, round(bits, 6) AS bits, round(1 - best / n, 6) AS error, round(CASE WHEN classes > 1 AND bits > 0 THEN hi ELSE 0 END, 6) AS fano, round(bits / 2, 6) AS hellman_raviv,
round(sqrt(1 - exp(-2 * shared)), 6) AS coefficient FROM b JOIN f USING (status) WHERE step = 50 OR classes = 1"""


def label_shares(spark, sf):
    """Shares of what is malicious, harmless and not known among the events of each user."""
    out = audit.label_shares(mapped_labels(spark, sf).join(updates(spark, sf).select("seq", "entity"), "seq"), "entity", "malicious")
    return out.select("entity", "n", *(rounded(F.col(c)).alias(c) for c in ("malicious", "harmless", "unknown")))


SHARES = f"""WITH m AS ({LABELS_SQL}), x AS (SELECT user_id AS entity, malicious FROM m JOIN events ON seq = event_id)
SELECT entity, count(*) AS n, round(avg((malicious IS NOT DISTINCT FROM 1)::INT), 6) AS malicious, round(avg((malicious IS NOT DISTINCT FROM 0)::INT), 6) AS harmless, round(avg((malicious IS NULL)::INT), 6) AS unknown FROM x GROUP BY 1"""


def alerts_per_day(spark, sf):
    """Alerts are events with a value over 100; a user is a network."""
    out = audit.alerts_per_day(updates(spark, sf), F.coalesce(F.col("value") > 100, F.lit(False)), "us", ["entity"], ["kind"])
    return out.select("kind", "alerts", rounded(F.col("days")).alias("days"), rounded(F.col("per_day")).alias("per_day"))


ALERTS = f"""WITH {U}, d AS (SELECT kind, sum(span) / 86400000000 AS days FROM (SELECT kind, entity, max(us) - min(us) AS span FROM u GROUP BY 1, 2) GROUP BY 1)
SELECT kind, alerts, round(days, 6) AS days, round(alerts / nullif(days, 0), 6) AS per_day FROM (SELECT kind, sum(coalesce(value > 100, false)::INT)::BIGINT AS alerts FROM u GROUP BY 1) JOIN d USING (kind)"""


def kpss(spark, sf):
    """Stationarity of the events an hour, by kind."""
    hours = updates(spark, sf).groupBy("kind", floor_div("us", HOUR).alias("hour")).agg(F.count("*").cast("double").alias("x"))
    return audit.kpss(hours, "hour", "x", ["kind"], LAGS).select("kind", "n", rounded(F.col("kpss")).alias("kpss"))


_LAGGED = ", ".join(f"e * lag(e, {j}) OVER w AS l{j}" for j in range(1, LAGS + 1))
_AROUND = " + ".join(f"2 * (1 - {j} / {LAGS + 1}::DOUBLE) * coalesce(sum(l{j}), 0)" for j in range(1, LAGS + 1))
KPSS = f"""WITH {U}, h AS (SELECT kind, us // {HOUR} AS hour, count(*)::DOUBLE AS x FROM u GROUP BY 1, 2), d AS (SELECT kind, hour, x - avg(x) OVER (PARTITION BY kind) AS e FROM h),
r AS (SELECT kind, e, sum(e) OVER w AS s, {_LAGGED} FROM d WINDOW w AS (PARTITION BY kind ORDER BY hour))
SELECT kind, count(*) AS n, round(sum(s * s) / nullif(count(*) * (sum(e * e) + {_AROUND}), 0), 6) AS kpss FROM r GROUP BY 1"""


def label_violations(spark, sf):
    return audit.label_violations(mapped_labels(spark, sf), "seq")


VIOLATIONS = f"""WITH m AS ({LABELS_SQL}) SELECT 'malicious' AS rule, count(*) FILTER (malicious NOT IN (0, 1)) AS violations FROM m UNION ALL SELECT 'stage', count(*) FILTER (stage NOT BETWEEN -1 AND 14) FROM m
UNION ALL SELECT 'unmapped', count(*) FILTER (NOT mapped AND malicious IS NOT NULL) FROM m UNION ALL SELECT 'stage_of_harmless', count(*) FILTER (stage >= 0 AND malicious = 0) FROM m
UNION ALL SELECT 'no_key', count(*) FILTER (seq IS NULL) FROM m UNION ALL SELECT 'repeated_key', coalesce(sum(n) FILTER (n > 1), 0)::BIGINT FROM (SELECT seq, count(*) AS n FROM m WHERE seq IS NOT NULL GROUP BY 1)"""


def clipped_values(spark, sf):
    return updates(spark, sf).select("seq", rounded(audit.signed_log1p_clip(F.col("value") - 50, 3.5)).alias("x"))


CLIPPED = f"WITH {U} SELECT seq, round(greatest(-3.5, least(3.5, sign(value - 50) * ln(1 + abs(value - 50)))), 6)::DOUBLE AS x FROM u WHERE value IS NOT NULL UNION ALL SELECT seq, NULL FROM u WHERE value IS NULL"

QUERIES = {f.__name__: f for f in (error_bounds, label_shares, alerts_per_day, kpss, label_violations, clipped_values)}
ORACLE = {"error_bounds": BOUNDS, "label_shares": SHARES, "alerts_per_day": ALERTS, "kpss": KPSS, "label_violations": VIOLATIONS, "clipped_values": CLIPPED}
