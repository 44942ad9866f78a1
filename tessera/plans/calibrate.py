"""Queries of calibration over bins of equal mass, over several classes, and by a temperature, with their SQL."""

from pyspark.sql import functions as F

from tessera.functions.scalars import rounded
from tessera.operators import calibrate as c
from tessera.plans.evaluation import FORECASTS, _forecasts
from tessera.sources.tables import UPDATES_SQL as U
from tessera.sources.tables import updates

KINDS = ("click", "error", "purchase", "signup", "view")


def mass_calibration(spark, sf):
    return c.mass_calibration(_forecasts(spark, sf), "p", "y", ["part"], 15).select("part", *(rounded(F.col(x)).alias(x) for x in ("ece", "mce")))


RANKED = f"{FORECASTS}, v AS (SELECT part, p, count(*) AS n, sum(y) AS y FROM x GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY part ORDER BY p) AS cum, sum(n) OVER (PARTITION BY part) AS total FROM v)"
MASS = f"""WITH {RANKED}, b AS (SELECT part, least(14, cum * 15 // total) AS bin, sum(n) AS n, abs(sum(y) - sum(n * p)) AS g FROM r GROUP BY 1, 2)
SELECT part, round(sum(g) / sum(n), 6) AS ece, round(max(g / n), 6) AS mce FROM b GROUP BY 1"""


def sweep_calibration(spark, sf):
    return c.sweep_calibration(_forecasts(spark, sf), "p", "y", ["part"]).select("part", "bins", rounded(F.col("ece")).alias("ece"))


SWEEP = f"""WITH {RANKED}, t AS (SELECT r.*, k FROM r, range(2, 200) q(k)), b AS (SELECT part, k, least(k - 1, cum * k // total) AS bin, sum(n) AS n, sum(y) AS y, abs(sum(y) - sum(n * p)) AS g FROM t GROUP BY 1, 2, 3),
f AS (SELECT *, y / n < lag(y / n) OVER (PARTITION BY part, k ORDER BY bin) AS falls FROM b), bad AS (SELECT part, min(k) AS stop FROM (SELECT part, k FROM f GROUP BY 1, 2 HAVING bool_or(falls) OR count(*) < 2) GROUP BY 1),
one AS (SELECT part, 1 AS k, sum(n) AS n, abs(sum(y) - sum(n * p)) AS g FROM r GROUP BY 1)
SELECT part, k::INTEGER AS bins, round(sum(g) / sum(n), 6) AS ece FROM (SELECT part, k, n, g FROM b UNION ALL SELECT * FROM one) JOIN bad USING (part) WHERE k = greatest(stop - 1, 1) GROUP BY 1, 2"""


def _classes(spark, sf):
    """Chances of the five kinds of event from the number in its properties."""
    w = [1 + F.pmod(F.col("k") * (i + 1), F.lit(7)) for i in range(5)]
    u = updates(spark, sf).filter("k IS NOT NULL").withColumn("all", sum(w[1:], w[0]).cast("double"))
    label = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1
    return u.select((F.col("entity") % 3).alias("part"), F.array(*(x / F.col("all") for x in w)).alias("probs"), label.alias("label"))


def multiclass_calibration(spark, sf):
    out = c.multiclass(_classes(spark, sf), "probs", "label", ["part"], 10)
    return out.select("part", "n", *(rounded(F.col(x)).alias(x) for x in ("brier", "log_loss", "classwise", "adaptive")))


_W = [f"(1 + k * {i + 1} % 7)" for i in range(5)]
MULTICLASS = f"""WITH {U}, x AS (SELECT seq, entity % 3 AS part, list_position({list(KINDS)}, kind) - 1 AS label, [{', '.join(f'{w} / ({" + ".join(_W)})::DOUBLE' for w in _W)}] AS probs FROM u WHERE k IS NOT NULL),
e AS (SELECT seq, part, c, probs[c + 1] AS p, (c = label)::INT AS y FROM x, range(5) t(c)),
w AS (SELECT part, count(*) // 5 AS n, sum((p - y) ** 2) / (count(*) / 5) AS brier, sum(CASE WHEN y = 1 THEN -ln(p) END) / (count(*) / 5) AS log_loss FROM e GROUP BY 1),
b AS (SELECT part, c, least(9, floor(p * 10)) AS bin, abs(sum(y) - sum(p)) AS g, count(*) AS n FROM e GROUP BY 1, 2, 3), cw AS (SELECT part, avg(s) AS classwise FROM (SELECT part, c, sum(g) / sum(n) AS s FROM b GROUP BY 1, 2) GROUP BY 1),
v AS (SELECT part, c, p, count(*) AS n, sum(y) AS y FROM e GROUP BY 1, 2, 3), r AS (SELECT *, sum(n) OVER (PARTITION BY part, c ORDER BY p) AS cum, sum(n) OVER (PARTITION BY part, c) AS total FROM v),
m AS (SELECT part, c, least(9, cum * 10 // total) AS bin, abs(sum(y) - sum(n * p)) / sum(n) AS g FROM r GROUP BY 1, 2, 3), ad AS (SELECT part, avg(g) AS adaptive FROM m GROUP BY 1)
SELECT part, n::BIGINT AS n, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(classwise, 6) AS classwise, round(adaptive, 6) AS adaptive FROM w JOIN cw USING (part) JOIN ad USING (part)"""


def likeliest_temperature(spark, sf):
    return c.temperature(_forecasts(spark, sf), "p", "y", ["part"]).select("part", rounded(F.col("temperature"), 5).alias("temperature"))


QUERIES = {q.__name__: q for q in (mass_calibration, sweep_calibration, multiclass_calibration, likeliest_temperature)}
ORACLE = {"mass_calibration": MASS, "sweep_calibration": SWEEP, "multiclass_calibration": MULTICLASS}
