"""Queries of scores, restricted means and label tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalars import rounded
from tessera.operators import describe, labels, survival
from tessera.plans.evaluation import WAITS, _waits
from tessera.sources.tables import UPDATES_SQL as U
from tessera.sources.tables import updates

#: Members of a forecast, as multiples of a user's value.
FACTORS = (0.7, 0.85, 1.0, 1.2, 1.5)
#: raw label, malicious (null: not known), stage, family.
LABELS = (("click", 0, -1, "use"), ("View", 0, -1, "use"), ("  ERROR ", 1, 3, "fault"), ("purchase", None, -1, "trade"))


def restricted_mean(spark, sf):
    out = survival.restricted_mean(_waits(spark, sf), "days", "event", ["o_orderpriority"], 60.0)
    return out.select("o_orderpriority", rounded(F.col("rmst")).alias("rmst"))


RESTRICTED = f"""WITH {WAITS}, c AS (SELECT o_orderpriority AS q, days, sum(event::INT)::BIGINT AS e, count(*) AS n FROM x GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY q ORDER BY days DESC) AS a FROM c),
s AS (SELECT q, days, CASE WHEN min(1 - e / a) OVER w > 0 THEN exp(sum(CASE WHEN e < a THEN ln(1 - e / a) ELSE 0 END) OVER w) ELSE 0 END AS s FROM r WHERE e > 0 WINDOW w AS (PARTITION BY q ORDER BY days)),
l AS (SELECT q, days, s * (lead(days, 1, 60.0) OVER (PARTITION BY q ORDER BY days) - days) AS w FROM s WHERE days <= 60)
SELECT g.q AS o_orderpriority, round(coalesce(m.v, 60.0), 6)::DOUBLE AS rmst FROM (SELECT DISTINCT q FROM c) g LEFT JOIN (SELECT q, sum(w) + min(days) AS v FROM l GROUP BY 1) m USING (q)"""


def interquartile_mean(spark, sf):
    out = describe.trimmed_middle(updates(spark, sf).filter("value IS NOT NULL"), "value", ["kind"])
    return out.select("kind", "n", rounded(F.col("mean")).alias("mean"))


INTERQUARTILE = f"""WITH {U}, r AS (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM u WHERE value IS NOT NULL)
SELECT kind, max(n) AS n, round(avg(value), 6) AS mean FROM r WHERE i >= floor(n * 0.25 + 1e-9) AND i < n - floor(n * 0.25 + 1e-9) GROUP BY 1"""


def ensemble_crps(spark, sf):
    """Forecasts of a value by multiples of k, the number in the event's properties."""
    members = F.array(*(F.col("k").cast("double") * f for f in FACTORS))
    out = updates(spark, sf).filter("value IS NOT NULL AND k IS NOT NULL").withColumn("s", describe.ensemble_crps(members, F.col("value")))
    return out.groupBy("kind").agg(F.count("*").alias("n"), rounded(F.avg("s"), 5).alias("crps"))


_FAR = " + ".join(f"abs(k * {f}::DOUBLE - value)" for f in FACTORS)
_APART = " + ".join(f"abs(k * {a}::DOUBLE - k * {b}::DOUBLE)" for i, a in enumerate(FACTORS) for b in FACTORS[:i])
CRPS = f"WITH {U} SELECT kind, count(*) AS n, round(avg(({_FAR}) / 5 - ({_APART}) / 20), 5) AS crps FROM u WHERE value IS NOT NULL AND k IS NOT NULL GROUP BY 1"


def mapped_labels(spark, sf):
    mapping = spark.createDataFrame(LABELS, "raw string, malicious int, stage int, family string")
    return labels.mapped_labels(updates(spark, sf).select("seq", "kind"), "kind", mapping).select("seq", "kind", "malicious", "stage", "family", "mapped")


_ROWS = ", ".join(f"('{r.strip().lower()}', {'NULL' if m is None else m}, {s}, '{f}')" for r, m, s, f in LABELS)
MAPPED = f"WITH {U}, m(raw, malicious, stage, family) AS (VALUES {_ROWS}) SELECT seq, kind, malicious::INTEGER AS malicious, stage::INTEGER AS stage, family, (raw IS NOT NULL OR kind IS NULL) AS mapped FROM u LEFT JOIN m ON regexp_replace(lower(kind), '[^a-z0-9]+', '', 'g') = regexp_replace(raw, '[^a-z0-9]+', '', 'g')"

def paired_permutation(spark, sf):
    """Values against the numbers in the events' properties, by kind."""
    d = updates(spark, sf).withColumn("d", F.col("value") - F.col("k"))
    out = survival.sign_flips(d, "d", "seq", ["kind"], 5)
    return out.select("kind", "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("p")).alias("p"))


_FLIPS = ", ".join(f"sum(CASE WHEN (h >> {r}) & 1 = 1 THEN -d ELSE d END) AS s{r}" for r in range(60))
_AS_FAR = " + ".join(f"(abs(s{r}) >= abs(t) - 1e-9)::INT" for r in range(60))
FLIPS = f"""WITH {U}, x AS (SELECT kind, (value - k)::DOUBLE AS d, ('0x' || substr(md5('5:' || seq), 1, 15))::BIGINT AS h FROM u WHERE value IS NOT NULL AND k IS NOT NULL),
g AS (SELECT kind, count(*) AS n, sum(d) AS t, {_FLIPS} FROM x GROUP BY 1) SELECT kind, n, round(t / n, 6) AS mean, round(({_AS_FAR} + 1) / 61, 6) AS p FROM g"""

QUERIES = {f.__name__: f for f in (restricted_mean, interquartile_mean, ensemble_crps, mapped_labels, paired_permutation)}
ORACLE = {"restricted_mean": RESTRICTED, "interquartile_mean": INTERQUARTILE, "ensemble_crps": CRPS, "mapped_labels": MAPPED, "paired_permutation": FLIPS}
