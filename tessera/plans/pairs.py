"""Queries of pairs by two orders: rank correlation, distances, and survival with censoring weights, with their SQL."""

from pyspark.sql import functions as F

from tessera.functions.scalars import rounded
from tessera.operators import dominance as d
from tessera.sources.tables import UPDATES_SQL as U
from tessera.sources.tables import table, updates

GRID = [float(t) for t in range(30, 391, 30)]
TIMES = [60.0, 120.0, 240.0, 360.0]


def _r(df, keys, *values):
    return df.select(*keys, *(rounded(F.col(v)).alias(v) for v in values))


def kendall_tau(spark, sf):
    """Whether an event's value goes with its count, by kind."""
    return _r(d.kendall(updates(spark, sf), "value", "k", ["kind"]), ["kind", "agree", "disagree", "tied_x", "tied_y"], "tau")


KENDALL = f"""WITH {U}, x AS (SELECT kind, value, k, count(*) AS n FROM u WHERE value IS NOT NULL AND k IS NOT NULL GROUP BY 1, 2, 3), p AS (
  SELECT a.kind, sum(CASE WHEN a.k < b.k THEN a.n * b.n ELSE 0 END)::BIGINT AS agree, sum(CASE WHEN a.k > b.k THEN a.n * b.n ELSE 0 END)::BIGINT AS disagree FROM x a JOIN x b ON a.kind = b.kind AND a.value < b.value GROUP BY 1
), tx AS (SELECT kind, sum(n * (n - 1) / 2) AS t, sum(n) AS m FROM (SELECT kind, value, sum(n) AS n FROM x GROUP BY 1, 2) GROUP BY 1), ty AS (SELECT kind, sum(n * (n - 1) / 2) AS t FROM (SELECT kind, k, sum(n) AS n FROM x GROUP BY 1, 2) GROUP BY 1)
SELECT kind, agree, disagree, tx.t::BIGINT AS tied_x, ty.t::BIGINT AS tied_y, round((agree - disagree) / (sqrt(m * (m - 1) / 2 - tx.t) * sqrt(m * (m - 1) / 2 - ty.t)), 6) AS tau FROM p JOIN tx USING (kind) JOIN ty USING (kind)"""


def ordinal_pairs(spark, sf):
    """Whether orders of a customer that cost more come later."""
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("g"), F.col("o_totalprice").alias("p"), F.datediff(F.col("o_orderdate"), F.lit("1995-01-01")).alias("day"))
    return _r(d.ordinal_agreement(o, "p", "day", ["g"]), ["g", "agree", "counted"], "share")


ORDINAL = """WITH o AS (SELECT o_custkey % 50 AS g, o_totalprice AS p, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS day FROM orders)
SELECT a.g, sum((a.p < b.p)::INT)::BIGINT AS agree, count(*) AS counted, round(avg((a.p < b.p)::INT), 6) AS share FROM o a JOIN o b ON a.g = b.g AND a.day < b.day GROUP BY 1"""


def distance_correlation(spark, sf):
    e = updates(spark, sf).withColumn("g", F.col("entity") % 8)
    return _r(d.distance_correlation(e, "value", "k", ["g"]), ["g", "n"], "dcov2", "dcor", "corrected")


DISTANCE = f"""WITH {U}, x AS (
  SELECT entity % 8 AS g, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS x, (k - avg(k) OVER w) / stddev_pop(k) OVER w AS y FROM u WHERE value IS NOT NULL AND k IS NOT NULL WINDOW w AS (PARTITION BY entity % 8)
), r AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY x, y) AS i, x, y FROM x), p AS (SELECT a.g, a.i, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM r a JOIN r b ON a.g = b.g),
s AS (SELECT g, i, sum(dx) AS ax, sum(dy) AS ay, sum(dx * dy) AS sxy, sum(dx * dx) AS sxx, sum(dy * dy) AS syy FROM p GROUP BY 1, 2),
t AS (SELECT g, count(*)::DOUBLE AS n, sum(sxy) AS sxy, sum(sxx) AS sxx, sum(syy) AS syy, sum(ax * ay) AS txy, sum(ax * ax) AS txx, sum(ay * ay) AS tyy, sum(ax) AS a, sum(ay) AS b FROM s GROUP BY 1),
v AS (SELECT g, n, sxy / n**2 - 2 * txy / n**3 + a * b / n**4 AS vxy, sxx / n**2 - 2 * txx / n**3 + a * a / n**4 AS vxx, syy / n**2 - 2 * tyy / n**3 + b * b / n**4 AS vyy,
  sxy / (n * (n - 3)) - 2 * txy / (n * (n - 2) * (n - 3)) + a * b / (n * (n - 1) * (n - 2) * (n - 3)) AS uxy, sxx / (n * (n - 3)) - 2 * txx / (n * (n - 2) * (n - 3)) + a * a / (n * (n - 1) * (n - 2) * (n - 3)) AS uxx,
  syy / (n * (n - 3)) - 2 * tyy / (n * (n - 2) * (n - 3)) + b * b / (n * (n - 1) * (n - 2) * (n - 3)) AS uyy FROM t)
SELECT g, n::BIGINT AS n, round(vxy, 6) AS dcov2, round(sqrt(greatest(vxy, 0) / sqrt(vxx * vyy)), 6) AS dcor, round(uxy / sqrt(uxx * uyy), 6) AS corrected FROM v"""


def _censored(spark, sf):
    """Days from order to the first shipment, censored at 400 days and for a third of the customers, with a predicted curve."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("ship"))
    days = F.abs(F.datediff(F.col("ship"), F.col("o_orderdate")))
    risk = (F.col("o_custkey") * 7919 % 1009).cast("double") / 1009
    o = table(spark, sf, "orders").join(li, "o_orderkey").select(F.col("o_orderpriority").alias("q"), F.least(days, F.lit(400)).cast("double").alias("days"), ((days <= 400) & (F.col("o_custkey") % 3 > 0)).alias("event"), risk.alias("risk"))
    return o.withColumn("curve", F.array(*(F.exp(-F.lit(t / 400) * (0.5 + F.col("risk"))) for t in GRID)))


CENSORED = """x AS (SELECT o_orderpriority AS q, least(d, 400)::DOUBLE AS days, d <= 400 AND o_custkey % 3 > 0 AS event, (o_custkey * 7919 % 1009) / 1009.0::DOUBLE AS risk
  FROM (SELECT *, abs(date_diff('day', o_orderdate::DATE, ship::DATE)) AS d FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)),
c AS (SELECT q, days, sum(event::INT) AS e, count(*) AS n FROM x GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY q ORDER BY days DESC) AS risk FROM c),
h AS (SELECT q, days, 1 - CASE WHEN risk > e THEN (n - e) / (risk - e) ELSE 0 END AS kg, 1 - e / risk AS ks FROM r),
km AS (SELECT q, days, product(kg) OVER w AS g, product(ks) OVER w AS s, coalesce(product(kg) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS gl FROM h WINDOW w AS (PARTITION BY q ORDER BY days)),
y AS (SELECT x.*, CASE WHEN gl > 1e-12 THEN 1 / gl ELSE 0 END AS w FROM x JOIN km USING (q, days))"""


def uno_c(spark, sf):
    return _r(d.uno_c(_censored(spark, sf), "risk", "days", "event", ["q"], 300.0).withColumn("weight", F.round("weight", 3)), ["q"], "weight", "c")


UNO = f"""WITH {CENSORED}, a AS (SELECT q, days, risk, sum(w * w) FILTER (event AND days < 300) AS e, count(*) AS n FROM y GROUP BY 1, 2, 3)
SELECT a.q, round(sum(a.e * b.n), 3) AS weight, round(sum(a.e * b.n * CASE WHEN b.risk < a.risk THEN 1 WHEN b.risk = a.risk THEN 0.5 ELSE 0 END) / sum(a.e * b.n), 6) AS c FROM a JOIN a b ON a.q = b.q AND b.days > a.days WHERE a.e > 0 GROUP BY 1"""


def brier_ipcw(spark, sf):
    return _r(d.brier_ipcw(_censored(spark, sf), "curve", GRID, "days", "event", ["q"], TIMES), ["q", "t"], "brier")


BRIER_CTE = """z AS (SELECT t, y.*, CASE WHEN t < 30 THEN 1 ELSE exp(-floor(t / 30) * 30 / 400 * (0.5 + risk)) END AS s FROM y, {times}),
b AS (SELECT q, t, count(*) AS n, sum(CASE WHEN days <= t AND event THEN w * s * s ELSE 0 END) AS d, sum(CASE WHEN days > t OR (days = t AND NOT event) THEN (1 - s) ** 2 ELSE 0 END) AS a FROM z GROUP BY 1, 2),
k AS (SELECT q, t, n, d, a, coalesce((SELECT arg_max(g, days) FROM km WHERE km.q = b.q AND km.days < b.t), 1) AS g FROM b)"""
BRIER = f"WITH {CENSORED}, {BRIER_CTE.format(times='(VALUES (60.0::DOUBLE), (120.0), (240.0), (360.0)) v(t)')} SELECT q, t, round((d + a / g) / n, 6) AS brier FROM k"


def integrated_brier(spark, sf):
    return _r(d.integrated_brier(_censored(spark, sf), "curve", GRID, "days", "event", ["q"], 365.0), ["q"], "integrated")


INTEGRATED = f"""WITH {CENSORED}, {BRIER_CTE.format(times='(SELECT unnest([0.0, 30, 60, 90, 120, 150, 180, 210, 240, 270, 300, 330, 360, 365]::DOUBLE[]) AS t)')},
f AS (SELECT q, t, (d + a / g) / n AS s FROM k), p AS (SELECT q, t, (t - lag(t) OVER w) * (s + lag(s) OVER w) / 2 AS p FROM f WINDOW w AS (PARTITION BY q ORDER BY t)) SELECT q, round(sum(p) / 365, 6) AS integrated FROM p GROUP BY q"""


def dynamic_auc(spark, sf):
    return _r(d.dynamic_auc(_censored(spark, sf), F.col("risk"), "days", "event", ["q"], TIMES), ["q", "t"], "auc", "decrement")


DYNAMIC = f"""WITH {CENSORED}, v(t) AS (VALUES (60.0::DOUBLE), (120.0), (240.0), (360.0)), m AS (
  SELECT q, t, risk, sum(CASE WHEN days <= t AND event THEN w ELSE 0 END) AS c, sum((days > t OR (days = t AND NOT event))::INT) AS l FROM y, v GROUP BY 1, 2, 3
), a AS (SELECT a.q, a.t, sum(a.c * b.l * CASE WHEN b.risk < a.risk THEN 1 WHEN b.risk = a.risk THEN 0.5 ELSE 0 END) / sum(a.c * b.l) AS auc FROM m a JOIN m b ON a.q = b.q AND a.t = b.t GROUP BY 1, 2),
s AS (SELECT a.q, a.t, auc, coalesce((SELECT arg_max(s, days) FROM km WHERE km.q = a.q AND km.days <= a.t), 1) AS s FROM a)
SELECT q, t, round(auc, 6) AS auc, round(coalesce(lag(s) OVER (PARTITION BY q ORDER BY t), 1) - s, 6) AS decrement FROM s"""

QUERIES = {q.__name__: q for q in (kendall_tau, ordinal_pairs, distance_correlation, uno_c, brier_ipcw, integrated_brier, dynamic_auc)}
ORACLE = {
    "kendall_tau": KENDALL, "ordinal_pairs": ORDINAL, "distance_correlation": DISTANCE, "uno_c": UNO, "brier_ipcw": BRIER, "integrated_brier": INTEGRATED, "dynamic_auc": DYNAMIC,
}
