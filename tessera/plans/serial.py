"""Queries of tests of dependent series and clusters, with their SQL where it can express them."""

from pyspark.sql import functions as F

from tessera.functions.scalars import rounded
from tessera.operators import serial as t
from tessera.operators.series import indexed
from tessera.sources.tables import UPDATES_SQL as U
from tessera.sources.tables import updates


def pacf(spark, sf):
    x = indexed(updates(spark, sf), ["kind"], ["us", "seq"], "value")
    return t.partial_autocorrelations(x, ["kind"], 12).select("kind", "lag", rounded(F.col("partial")).alias("partial"))


def kpss_automatic(spark, sf):
    """Whether the counts of each kind keep to a trend."""
    x = indexed(updates(spark, sf), ["kind"], ["us", "seq"], "k")
    return t.kpss_test(x, ["kind"], "ct").select("kind", "n", "lags", *(rounded(F.col(c)).alias(c) for c in ("statistic", "p")))


def _losses(spark, sf):
    """Losses of two forecasts of a value: the number in the event's properties, and 50."""
    d = F.abs(F.col("value") - F.col("k")) - F.abs(F.col("value") - 50)
    return updates(spark, sf).withColumn("d", d).withColumn("unit", F.col("entity") % 10)


def diebold_mariano(spark, sf):
    x = indexed(_losses(spark, sf), ["kind", "unit"], ["us", "seq"], "d")
    return t.equal_forecasts(x, ["kind"], ["unit"], 3).select("kind", "n", *(rounded(F.col(c)).alias(c) for c in ("mean", "z", "corrected")))


DM = f"""WITH {U}, x AS (SELECT kind, entity % 10 AS unit, us, seq, abs(value - k) - abs(value - 50) AS d FROM u WHERE value IS NOT NULL AND k IS NOT NULL),
e AS (SELECT *, d - avg(d) OVER (PARTITION BY kind, unit) AS e FROM x), l AS (SELECT *, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2 FROM e WINDOW w AS (PARTITION BY kind, unit ORDER BY us, seq)),
s AS (SELECT kind, unit, count(*) AS n, sum(d) AS total, sum(e * e) + 2 * (2 / 3.0::DOUBLE) * coalesce(sum(e * e1), 0) + 2 * (1 / 3.0::DOUBLE) * coalesce(sum(e * e2), 0) AS v FROM l GROUP BY 1, 2),
g AS (SELECT kind, sum(n)::BIGINT AS n, sum(total) / sum(n) AS mean, sum(v) AS v FROM s GROUP BY 1)
SELECT kind, n, round(mean, 6) AS mean, round(mean * n / sqrt(v), 6) AS z, round(mean * n / sqrt(v) * sqrt((n + 1 - 6 + 6.0::DOUBLE / n) / n), 6) AS corrected FROM g"""


def cluster_flips(spark, sf):
    """Whether one of the forecasts is better, flipping whole users."""
    out = t.cluster_flips(_losses(spark, sf), "d", "entity", ["kind"], 240, 7)
    return out.select("kind", "n", "clusters", *(rounded(F.col(c)).alias(c) for c in ("mean", "p")))


_S = ", ".join(f"sum(CASE WHEN (h >> {r}) & 1 = 1 THEN -d ELSE d END) AS s{r}" for r in range(60))
_FAR = " + ".join(f"(abs(s{r}) >= abs(t) - 1e-9)::INT" for r in range(60))
FLIPS = f"""WITH {U}, c AS (SELECT kind, entity, sum(abs(value - k) - abs(value - 50)) AS d, count(*) AS n FROM u WHERE value IS NOT NULL AND k IS NOT NULL GROUP BY 1, 2),
b AS (SELECT kind, b, d, ('0x' || substr(md5('7:' || b || ':' || entity), 1, 15))::BIGINT AS h FROM c, range(4) q(b)), g AS (SELECT kind, b, sum(d) AS t, {_S} FROM b GROUP BY 1, 2), p AS (SELECT kind, (sum({_FAR}) + 1) / 241 AS p FROM g GROUP BY 1)
SELECT kind, sum(n)::BIGINT AS n, count(*) AS clusters, round(sum(d) / sum(n), 6) AS mean, round(any_value(p), 6) AS p FROM c JOIN p USING (kind) GROUP BY kind"""


def paired_effect(spark, sf):
    out = t.paired_effect(_losses(spark, sf), "d", ["kind"])
    return out.select("kind", "n", *(rounded(F.col(c)).alias(c) for c in ("mean", "dz", "hedges")))


EFFECT = f"""WITH {U}, x AS (SELECT kind, abs(value - k) - abs(value - 50) AS d FROM u WHERE value IS NOT NULL AND k IS NOT NULL), s AS (SELECT kind, count(*) AS n, avg(d) AS mean, avg(d) / stddev_samp(d) AS dz FROM x GROUP BY 1)
SELECT kind, n, round(mean, 6) AS mean, round(dz, 6) AS dz, round(dz * (1 - 3 / (4 * (n - 1) - 1.0::DOUBLE)), 6) AS hedges FROM s"""

QUERIES = {q.__name__: q for q in (pacf, kpss_automatic, diebold_mariano, cluster_flips, paired_effect)}
ORACLE = {"diebold_mariano": DM, "cluster_flips": FLIPS, "paired_effect": EFFECT}
