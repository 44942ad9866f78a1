"""Queries of entities over time, forecasts and models, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.functions.scalars import micros, rounded
from tessera.operators import entities as en
from tessera.operators import forecast as fc
from tessera.operators import ranking
from tessera.plans.sequences import SERIES, _series
from tessera.sources.tables import UPDATES_SQL as U
from tessera.sources.tables import table, updates

HOUR, DAY = 3_600_000_000, 86_400_000_000


def _r(df, keep, *names):
    return df.select(*keep, *(rounded(F.col(n)).alias(n) for n in names))


def entity_table(spark, sf):
    return en.entity_table(updates(spark, sf), "entity", "us")


ENTITY = f"WITH {U} SELECT entity, min(us) AS first_seen, max(us) AS last_seen, count(*) AS updates FROM u GROUP BY 1"


def relation_table(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", micros("l_shipdate").alias("us"), F.when(F.col("l_linenumber") < 7, F.col("l_quantity").cast("bigint")).alias("size"))
    return en.relation_table(li, "l_suppkey", "l_partkey", "us", "size")


RELATION = """WITH l AS (SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, l_suppkey <= l_partkey AS f, epoch_us(l_shipdate) AS us, CASE WHEN l_linenumber < 7 THEN l_quantity::BIGINT END AS size FROM lineitem)
SELECT a, b, min(us) AS first_seen, max(us) AS last_seen, count(*) AS updates, sum(f::INT)::BIGINT AS updates_fwd, sum((NOT f)::INT)::BIGINT AS updates_bwd,
  CASE WHEN count(*) FILTER (f) = count(size) FILTER (f) THEN coalesce(sum(size) FILTER (f), 0)::BIGINT END AS size_fwd, CASE WHEN count(*) FILTER (NOT f) = count(size) FILTER (NOT f) THEN coalesce(sum(size) FILTER (NOT f), 0)::BIGINT END AS size_bwd FROM l GROUP BY 1, 2"""


def state_changes(spark, sf):
    return en.changes(updates(spark, sf), ["entity"], ["us", "seq"], "kind").select("entity", "us", "kind")


CHANGES = f"WITH {U} SELECT entity, us, kind FROM (SELECT *, lag(kind) OVER (PARTITION BY entity ORDER BY us, seq) AS was FROM u) WHERE kind IS DISTINCT FROM was"


def silences(spark, sf):
    return en.silences(updates(spark, sf), ["entity"], "us", DAY)


SILENCES = f"WITH {U} SELECT entity, us, gap FROM (SELECT *, lead(us) OVER (PARTITION BY entity ORDER BY us) - us AS gap FROM u) WHERE gap > {DAY}"


def patient_zero(spark, sf):
    return en.first_suspects(updates(spark, sf), "entity", "us", "value", 300.0, 10)


PATIENT_ZERO = f"WITH {U} SELECT entity, min(us) FILTER (value >= 300) AS first_alert, max(value) AS best FROM u GROUP BY entity ORDER BY first_alert NULLS LAST, best DESC, entity LIMIT 10"


def host_windows(spark, sf):
    return _r(en.host_windows(updates(spark, sf), "entity", "us", DAY, "kind", ["click", "error", "purchase"], "value", "k"), ["entity", "g", "n_click", "n_error", "n_purchase", "peers"], "total", "least", "largest")


HOSTS = f"""WITH {U} SELECT entity, us // {DAY} AS g, {', '.join(f"sum((kind = '{k}')::INT)::BIGINT AS n_{k}" for k in ('click', 'error', 'purchase'))}, count(DISTINCT k) AS peers, round(sum(value), 6) AS total, round(min(value), 6) AS least, round(max(value), 6) AS largest FROM u GROUP BY 1, 2"""


def log_time_cells(spark, sf):
    return _r(en.log_time_cells(updates(spark, sf), ["entity"], "us", 1706745600000000, HOUR, "value"), ["entity", "level", "cell", "n", "latest"], "mean")


CELLS = f"""WITH {U}, l AS (SELECT *, greatest(0, floor(log2(greatest((1706745600000000 - us)::DOUBLE, 1.0) / {HOUR})) + 1)::INTEGER AS level FROM u WHERE us <= 1706745600000000)
SELECT entity, level, floor(us / ({HOUR} * pow(2.0, greatest(level - 1, 0))))::BIGINT AS cell, count(*) AS n, max(us) AS latest, round(avg(value), 6) AS mean FROM l GROUP BY 1, 2, 3"""


def category_codes(spark, sf):
    return en.category_codes(updates(spark, sf), "k", 5, 50)


CODES = f"WITH {U}, c AS (SELECT k, count(*) AS n FROM u GROUP BY k HAVING count(*) >= 5) SELECT k, n, row_number() OVER (ORDER BY n DESC, k)::INTEGER AS code FROM c ORDER BY n DESC, k LIMIT 50"


def path_distance(spark, sf):
    """Edit distance between the whole paths of each user and of the next user."""
    return whole_path_distance(spark, sf)


def whole_path_distance(spark, sf):
    """Edit distance between the whole paths of each user and of the next user."""
    p = en.paths(updates(spark, sf).withColumn("l", F.substring("kind", 1, 1)), ["entity"], ["us", "seq"], "l")
    q = p.select((F.col("entity") - 1).alias("entity"), F.col("path").alias("other"))
    return p.join(q, "entity").select("entity", "path", F.levenshtein("path", "other").cast("bigint").alias("distance"))


WHOLE_PATHS = f"""WITH {U}, p AS (SELECT entity, string_agg(substr(kind, 1, 1), '' ORDER BY us, seq) AS path FROM u GROUP BY 1)
SELECT a.entity, a.path, levenshtein(a.path, b.path)::BIGINT AS distance FROM p a JOIN p b ON b.entity = a.entity + 1"""


def horizon_scores(spark, sf):
    """Forecasts of an event within 12 steps, from a constant hazard by user; some rows are censored."""
    u = updates(spark, sf)
    p = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda j: 1 - F.pow(1 - (F.col("k") % 10 + 1) / 50.0, j))
    rows = u.select("kind", p.alias("p"), F.when(F.col("seq") % 3 == 0, F.col("seq") % 17 + 1).alias("event_step"), (F.col("seq") % 13).alias("observed"))
    return _r(fc.horizon_scores(rows, "p", "event_step", "observed", ["kind"], 12), ["kind", "k", "n"], "brier", "mean_p", "observed", "crps")


HORIZON = f"""WITH {U}, r AS (SELECT kind, (k % 10 + 1) / 50.0 AS h, CASE WHEN seq % 3 = 0 THEN seq % 17 + 1 END AS e, seq % 13 AS o, unnest(range(1, 13)) AS j FROM u),
x AS (SELECT kind, j, 1 - pow(1 - h, j) AS p, coalesce(e <= j, false)::INT AS y, list_sum(list_transform(range(1, j + 1), lambda i: pow(1 - pow(1 - h, i) - coalesce(e <= i, false)::INT, 2))) AS c FROM r WHERE coalesce(e <= j, false) OR o >= j)
SELECT kind, j::INTEGER AS k, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS observed, round(avg(c), 6) AS crps FROM x GROUP BY 1, 2"""


def weighted_quantile(spark, sf):
    return fc.weighted_quantile(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"], 0.9)


WEIGHTED = """WITH r AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS c, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS t FROM lineitem)
SELECT l_returnflag, min(v) AS quantile FROM r WHERE c >= 0.9 * t * (1 - 1e-12) GROUP BY 1"""


def upper_tail_mean(spark, sf):
    return _r(fc.upper_tail_mean(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"], 0.05), ["l_returnflag"], "mean").withColumn("mean", F.round("mean", 3))


TAIL_MEAN = """WITH g AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag) AS t, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS c FROM g),
p AS (SELECT l_returnflag, v, greatest(0, least(w, 0.05 * t - (t - c))) AS p FROM r) SELECT l_returnflag, round(sum(p * v) / sum(p), 3) AS mean FROM p GROUP BY 1"""


def periodogram(spark, sf):
    return _r(fc.periodogram(_series(spark, sf), ["kind"], "bin", "n", [6, 12, 24, 168]), ["kind", "period"], "power", "share")


PERIODOGRAM = f"""WITH {U}, {SERIES}, d AS (SELECT kind, bin, n - avg(n) OVER (PARTITION BY kind) AS d, count(*) OVER (PARTITION BY kind) AS c FROM s), x AS (SELECT kind, p AS period, d, c, (bin % p) * {2 * math.pi!r} / p AS a FROM d, (SELECT unnest([6, 12, 24, 168]) AS p))
SELECT kind, period, round((pow(sum(d * cos(a)), 2) + pow(sum(d * sin(a)), 2)) / max(c), 6) AS power, round((pow(sum(d * cos(a)), 2) + pow(sum(d * sin(a)), 2)) / max(c) / sum(d * d), 6) AS share FROM x GROUP BY 1, 2"""


def smoothed_series(spark, sf):
    return _r(fc.smoothed(_series(spark, sf), ["kind"], "bin", "n", 3.0, 9), ["kind", "bin"], "trend", "residual")


_W = [math.exp(-0.5 * (i / 3.0) ** 2) for i in range(10)]
SMOOTHED = f"""WITH {U}, {SERIES}, t AS (SELECT kind, bin, n, ({' + '.join(f'coalesce({w!r} * lag(n, {i}) OVER w, 0)' for i, w in enumerate(_W))}) / ({' + '.join(f'CASE WHEN lag(n, {i}) OVER w IS NULL THEN 0 ELSE {w!r} END' for i, w in enumerate(_W))}) AS trend FROM s WINDOW w AS (PARTITION BY kind ORDER BY bin))
SELECT kind, bin, round(trend, 6) AS trend, round(n - trend, 6) + 0.0::DOUBLE AS residual FROM t"""


def standardised(spark, sf):
    return _r(fc.standardised(updates(spark, sf).select("seq", "value", F.col("k").cast("double").alias("k")), ["value", "k"]), ["seq"], "value", "k")


STANDARDISED = f"WITH {U}, m AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk FROM u) SELECT seq, round(coalesce((value - mv) / sv, 0), 6) + 0.0::DOUBLE AS value, round((k - mk) / sk, 6) + 0.0::DOUBLE AS k FROM u, m"


def ridge_coefficients(spark, sf):
    li = table(spark, sf, "lineitem")
    return _r(fc.ridge(li, ["l_quantity", "l_discount"], "l_extendedprice", 10.0), ["feature"], "coefficient").withColumn("coefficient", F.round("coefficient", 3))


RIDGE = """WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_extendedprice) AS my, var_pop(l_quantity) + 10.0 / count(*) AS a, var_pop(l_discount) + 10.0 / count(*) AS b, covar_pop(l_quantity, l_discount) AS c,
  covar_pop(l_quantity, l_extendedprice) AS p, covar_pop(l_discount, l_extendedprice) AS q FROM lineitem), t AS (SELECT *, (p * b - q * c) / (a * b - c * c) AS x, (q * a - p * c) / (a * b - c * c) AS y FROM s)
SELECT unnest(['intercept', 'l_quantity', 'l_discount']) AS feature, round(unnest([my - x * ma - y * mb, x, y]), 3) AS coefficient FROM t"""


def logistic_detector(spark, sf):
    """Returned line items from quantity, price and discount; trained before 1999, ranked afterwards."""
    li = table(spark, sf, "lineitem").select("l_shipdate", "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"), "l_discount", (F.col("l_returnflag") == "R").cast("double").alias("y"))
    model = fc.logistic(li.filter("year(l_shipdate) < 1999"), ["l_quantity", "price", "l_discount"], "y")
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(li.filter("year(l_shipdate) >= 1999")).select(F.year("l_shipdate").alias("year"), F.round(vector_to_array("probability")[1], 9).alias("score"), "y")
    return _r(ranking.ranking(scored, "score", "y", ["year"]), ["year", "positives", "negatives"], "auroc", "average_precision")


QUERIES = {f.__name__: f for f in (
    entity_table, relation_table, state_changes, silences, patient_zero, host_windows, log_time_cells, category_codes, path_distance, whole_path_distance, horizon_scores, weighted_quantile, upper_tail_mean, periodogram,
    smoothed_series, standardised, ridge_coefficients, logistic_detector,
)}
ORACLE = {
    "entity_table": ENTITY, "relation_table": RELATION, "state_changes": CHANGES, "silences": SILENCES, "patient_zero": PATIENT_ZERO, "host_windows": HOSTS, "log_time_cells": CELLS,
    "category_codes": CODES, "path_distance": WHOLE_PATHS, "whole_path_distance": WHOLE_PATHS, "horizon_scores": HORIZON, "weighted_quantile": WEIGHTED, "upper_tail_mean": TAIL_MEAN, "periodogram": PERIODOGRAM, "smoothed_series": SMOOTHED,
    "standardised": STANDARDISED, "ridge_coefficients": RIDGE,
}
