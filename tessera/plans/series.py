"""Queries of time series and their resampling, with their SQL where it can express them."""

from pyspark.sql import functions as F

from tessera.functions.scalars import rounded
from tessera.operators import resampling as r
from tessera.operators import series as s
from tessera.sources.tables import UPDATES_SQL as U
from tessera.sources.tables import updates


def _series(spark, sf, value="value"):
    """Values of each kind of event, in the order of time."""
    return s.indexed(updates(spark, sf), ["kind"], ["us", "seq"], value)


S = f"{U}, s AS (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY us, seq) - 1 AS i, value AS v FROM u WHERE value IS NOT NULL)"


def dfa(spark, sf):
    """Fluctuations by scale, with the exponent."""
    f, fit = s.dfa(_series(spark, sf), ["kind"])
    return f.join(fit, "kind").select("kind", "scale", "scales", *(rounded(F.col(c)).alias(c) for c in ("fluctuation", "alpha", "error")))


DFA = f"""WITH {S}, m AS (SELECT kind, count(*) AS n, avg(v) AS mean FROM s GROUP BY 1),
p AS (SELECT kind, n, i, sum(v - mean) OVER (PARTITION BY kind ORDER BY i) AS y FROM s JOIN m USING (kind)),
sc AS (SELECT DISTINCT kind, n, round_even(8.0 * pow(floor(n * 0.25) / 8.0, k / 23.0), 0)::BIGINT AS scale FROM m, range(24) t(k)),
b AS (SELECT kind, scale, side, pos // scale AS box, (pos % scale)::DOUBLE AS t, y FROM (SELECT p.kind, scale, p.n, side, y, CASE WHEN side = 0 THEN i ELSE p.n - 1 - i END AS pos FROM p JOIN sc USING (kind), range(2) q(side)) WHERE pos // scale < n // scale),
r AS (SELECT kind, scale, regr_syy(y, t) - regr_sxy(y, t) ** 2 / regr_sxx(y, t) AS rss FROM b GROUP BY kind, scale, side, box),
f AS (SELECT kind, scale, sqrt(greatest(avg(rss) / scale, 0)) AS fluctuation FROM r GROUP BY 1, 2),
a AS (SELECT kind, count(*) AS scales, regr_slope(ln(fluctuation), ln(scale)) AS alpha, regr_syy(ln(fluctuation), ln(scale)) AS yy, regr_sxy(ln(fluctuation), ln(scale)) AS xy, regr_sxx(ln(fluctuation), ln(scale)) AS xx FROM f GROUP BY 1)
SELECT kind, scale, scales, round(fluctuation, 6) AS fluctuation, round(alpha, 6) AS alpha, round(sqrt((yy - xy ** 2 / xx) / (scales - 2) / xx), 6) AS error FROM f JOIN a USING (kind)"""


def adf(spark, sf):
    """Whether the values of a kind have a unit root, and whether their sums have."""
    x = _series(spark, sf).withColumn("what", F.lit("values"))
    from tessera.operators.ranks import running_totals

    sums = running_totals(x, "i", ["v"], ["kind"]).select("kind", "i", F.col("cum_v").alias("v"), F.lit("sums").alias("what"))
    return s.adf(x.unionByName(sums), ["kind", "what"]).select("kind", "what", "lags", "rows", *(rounded(F.col(c), 5).alias(c) for c in ("tau", "p", "critical")))


FREQUENCIES = [round(0.05 * k, 2) for k in range(1, 81)]


def lomb_scargle(spark, sf):
    """Power of each kind's values by cycles a day."""
    e = updates(spark, sf).withColumn("day", F.col("us") / 86_400_000_000.0)
    p = s.lomb_scargle(e, ["kind"], "day", "value", FREQUENCIES)
    return p.select("kind", "frequency", rounded(F.col("power"), 5).alias("power"))


LOMB = f"""WITH {U}, x AS (SELECT kind, (us - min(us) OVER (PARTITION BY kind)) / 86400000000.0 AS t, value - avg(value) OVER (PARTITION BY kind) AS y FROM u WHERE value IS NOT NULL),
f AS (SELECT unnest({FREQUENCIES}::DOUBLE[]) AS frequency), w AS (SELECT kind, frequency, 2 * pi() * frequency * t AS w, y FROM x, f),
a AS (SELECT kind, frequency, atan2(sum(sin(2 * w)), sum(cos(2 * w))) / 2 AS a FROM w GROUP BY 1, 2)
SELECT kind, frequency, round((sum(y * cos(w - a)) ** 2 / sum(cos(w - a) ** 2) + sum(y * sin(w - a)) ** 2 / sum(sin(w - a) ** 2)) / (2 * var_samp(y)), 5) AS power FROM w JOIN a USING (kind, frequency) GROUP BY 1, 2"""


def lomb_peak(spark, sf):
    """The highest power of each kind, and how likely noise has one."""
    e = updates(spark, sf).withColumn("day", F.col("us") / 86_400_000_000.0)
    p = s.false_alarm(s.lomb_scargle(e, ["kind"], "day", "value", FREQUENCIES), ["kind"], len(FREQUENCIES))
    return p.select("kind", "frequency", *(rounded(F.col(c), 5).alias(c) for c in ("power", "chance")))


PEAK = f"WITH p AS ({LOMB}) SELECT kind, arg_max(frequency, power) AS frequency, max(power) AS power, round(1 - pow(1 - exp(-max(power)), {len(FREQUENCIES)}), 5) AS chance FROM p GROUP BY kind"


def pelt(spark, sf):
    """Segments of each kind's counts per event."""
    return s.pelt(_series(spark, sf, "k"), ["kind"], "poisson", 12.0).select("kind", "start", "stop", rounded(F.col("cost"), 4).alias("cost"))


def bocpd(spark, sf):
    """Run lengths of each user's values."""
    x = s.indexed(updates(spark, sf), ["entity"], ["us", "seq"], "value")
    out = s.bocpd(x, ["entity"], "normal", 1 / 50)
    return out.select("entity", "i", "run", "changed", *(rounded(F.col(c)).alias(c) for c in ("chance", "mean_run")))


def block_lengths(spark, sf):
    return r.optimal_block_length(_series(spark, sf), ["kind"]).select("kind", "n", rounded(F.col("length"), 4).alias("length"))


def autocovariances(spark, sf):
    return r.autocovariances(_series(spark, sf), ["kind"], 20).select("kind", "lag", "n", rounded(F.col("covariance"), 5).alias("covariance"))


AUTOCOVARIANCES = f"""WITH {S}, e AS (SELECT kind, i, v - avg(v) OVER (PARTITION BY kind) AS e, count(*) OVER (PARTITION BY kind) AS n FROM s)
SELECT a.kind, (b.i - a.i)::INTEGER AS lag, a.n, round(sum(a.e * b.e) / a.n, 5) AS covariance FROM e a JOIN e b ON a.kind = b.kind AND b.i >= a.i AND b.i <= a.i + 20 GROUP BY 1, 2, 3"""


def jackknife_means(spark, sf):
    return r.jackknife_means(_series(spark, sf), ["kind"], 50).select("kind", "group", rounded(F.col("mean")).alias("mean"))


JACKKNIFE = f"""WITH {S}, n AS (SELECT kind, count(*) AS n, least(count(*), 50) AS g, sum(v) AS total FROM s GROUP BY 1),
p AS (SELECT s.kind, n, total, v, CASE WHEN i < (n % g) * (n // g + 1) THEN i // (n // g + 1) ELSE n % g + (i - (n % g) * (n // g + 1)) // (n // g) END::INTEGER AS "group" FROM s JOIN n USING (kind))
SELECT kind, "group", round((any_value(total) - sum(v)) / (any_value(n) - count(*)), 6) AS mean FROM p GROUP BY 1, 2"""


def stationary_interval(spark, sf):
    """Mean values of each kind with intervals that respect their order."""
    out = r.mean_interval(_series(spark, sf), ["kind"], 200)
    return out.select("kind", "method", "replicates", *(rounded(F.col(c)).alias(c) for c in ("estimate", "low", "high", "length")))


QUERIES = {q.__name__: q for q in (dfa, adf, lomb_scargle, lomb_peak, pelt, bocpd, block_lengths, autocovariances, jackknife_means, stationary_interval)}
ORACLE = {"dfa": DFA, "lomb_scargle": LOMB, "lomb_peak": PEAK, "autocovariances": AUTOCOVARIANCES, "jackknife_means": JACKKNIFE}
