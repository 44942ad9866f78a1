"""Tests of dependent series and of clusters: partial autocorrelation, stationarity with automatic lags, equal forecasts, flips of
whole clusters, and paired effects. All start from autocovariances by blocks or from sums by cluster."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import joined, ratio
from tessera.operators.ranks import running_totals
from tessera.operators.resampling import autocovariances
from tessera.operators.splits import hash_order
from tessera.sources.stored import stored

# Significance and critical value of a level's and of a trend's stationarity (Kwiatkowski et al., 1992).
KPSS = {"c": ((0.10, 0.347), (0.05, 0.463), (0.025, 0.574), (0.01, 0.739)), "ct": ((0.10, 0.119), (0.05, 0.146), (0.025, 0.176), (0.01, 0.216))}


def _schema(df: DataFrame, by: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema)


def partial_autocorrelations(series: DataFrame, by: list[str], lags: int) -> DataFrame:
    """(by, lag, partial): for each lag the last coefficient of the autoregression of that order, from Yule and Walker's equations
    of the autocorrelations (lags + 1 rows a series). NULL for constant series."""
    acov = autocovariances(series, by, lags)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        r = frame.sort_values("lag")["covariance"].to_numpy()
        out = []
        for k in range(1, len(r)):
            grid = np.abs(np.subtract.outer(np.arange(k), np.arange(k)))
            solved = np.linalg.lstsq(r[grid] / r[0], r[1 : k + 1] / r[0], rcond=None)[0][-1] if r[0] > 0 else None
            out.append({**{b: frame[b].iloc[0] for b in by}, "lag": k, "partial": solved})
        return pd.DataFrame(out, columns=[*by, "lag", "partial"]).astype({"partial": "Float64"})

    return acov.groupBy(*by).applyInPandas(run, f"{_schema(series, by)}lag int, partial double")


def kpss_test(series: DataFrame, by: list[str], trend: str = "c", lags: int | None = None) -> DataFrame:
    """Stationarity around a level (c) or a trend (ct): n, statistic, lags and p, which the published table bounds to 0.01 and 0.10.
    Lags are Newey and West's automatic choice (1994) unless they are given. Series below 10 rows, and those that the level or trend
    fits without rest, have NULL. Partial sums are running totals by ranges, autocovariances come by blocks."""
    m = series.groupBy(*by).agg(F.count("*").alias("n"), F.avg("v").alias("__a"), F.regr_slope(F.col("v"), F.col("i").cast("double")).alias("__b"), F.avg("i").alias("__i"))
    slope = F.coalesce("__b", F.lit(0.0)) if trend == "ct" else F.lit(0.0)
    rest = joined(series, m, by).select(*by, "i", (F.col("v") - F.col("__a") - slope * (F.col("i") - F.col("__i"))).alias("v"))
    rest = stored(rest, "kpss")
    sizes = rest.groupBy(*by).agg(F.count("*").alias("n"))
    longest = sizes.agg(F.max("n")).first()[0] or 1
    before = lambda n: int(4 * (n / 100) ** (2 / 9))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        g, n = frame.sort_values("lag")["covariance"].to_numpy(), int(frame["n"].iloc[0])
        g = g[: before(n) + 1]
        whole = g[0] + 2 * g[1:].sum()
        lag = int(1.1447 * ((2 * (np.arange(len(g)) * g).sum() / whole) ** 2 * n) ** (1 / 3)) if whole > 0 else 0
        return pd.DataFrame([{**{b: frame[b].iloc[0] for b in by}, "n": n, "lags": min(max(lag if lags is None else lags, 0), n - 1)}])

    chosen = autocovariances(rest, by, before(longest)).groupBy(*by).applyInPandas(choose, f"{_schema(series, by)}n long, lags int")
    chosen = stored(chosen, "kpss-lags")
    most = chosen.agg(F.max("lags")).first()[0] or 0
    acov = joined(autocovariances(rest, by, most).drop("n"), chosen, by).filter("lag <= lags")
    weight = F.when(F.col("lag") == 0, 1.0).otherwise(2 * (1 - F.col("lag") / (F.col("lags") + 1)))
    spread = acov.groupBy(*by).agg(F.max("n").alias("n"), F.max("lags").alias("lags"), F.sum(weight * F.col("covariance")).alias("__s2"), F.max(F.when(F.col("lag") == 0, F.col("covariance"))).alias("__v"))
    sums = running_totals(rest, "i", ["v"], by).groupBy(*by).agg(F.sum(F.col("cum_v") ** 2).alias("__sq"))
    out = joined(spread, sums, by)
    level = F.when((F.col("n") >= 10) & (F.col("__s2") > 0) & (F.col("__v") > 1e-20), F.col("__sq") / F.col("n") ** 2 / F.col("__s2"))
    table = KPSS[trend]
    p = F.when(F.col("statistic") <= table[0][1], table[0][0])
    for (a, x), (b, y) in zip(table, table[1:]):
        p = p.when(F.col("statistic") <= y, a + (F.col("statistic") - x) / (y - x) * (b - a))
    return out.withColumn("statistic", level).withColumn("p", F.when(F.col("statistic").isNotNull(), p.otherwise(table[-1][0]))).select(*by, "n", "statistic", "lags", "p")


def student_tail(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's t: the incomplete beta function by its continued fraction (Lentz)."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    if turned := x > (a + 1) / (a + b + 2):
        x, a, b = 1 - x, b, a
    c, d, f = math.inf, 1.0, 1.0
    for k in range(1, 400):
        m = k // 2
        step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) if k % 2 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / (1 + step * d or 1e-300), 1 + step / c or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
    return 1 - front * f if turned else front * f


def equal_forecasts(series: DataFrame, by: list[str], units: list[str], horizon: int = 1, lags: int | None = None) -> DataFrame:
    """Diebold and Mariano's test for each group: n, the mean difference of losses, its z with Newey and West's variance (Bartlett weights up
    to `lags`, horizon - 1 unless given), the small-sample correction of Harvey, Leybourne and Newbold, and p by Student's t.
    series: (by, units, i, v), v the difference of losses; units are independent series of a group. NULL without variance."""
    lags = horizon - 1 if lags is None else lags
    acov = autocovariances(series, [*by, *units], lags)
    weight = F.when(F.col("lag") == 0, 1.0).otherwise(2 * (1 - F.col("lag") / (lags + 1)))
    own = acov.groupBy(*by, *units).agg(F.max("n").alias("n"), F.sum(weight * F.col("covariance")).alias("s2"))
    whole = own.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("s2")).alias("__v"))
    mean = series.groupBy(*by).agg(F.avg("v").alias("mean"))
    n = F.col("n").cast("double")
    out = joined(whole, mean, by)
    z = F.when((F.col("__v") > 0) & (n >= 2), F.col("mean") * n / F.sqrt("__v"))
    out = out.withColumn("z", z).withColumn("corrected", F.col("z") * F.sqrt(F.greatest((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n, F.lit(0.0))))
    tail = F.udf(lambda t, k: None if t is None or k < 2 else student_tail(t, k - 1), "double")  # a row for each group
    return out.select(*by, "n", "mean", "z", "corrected", tail("corrected", "n").alias("p"))


def cluster_flips(df: DataFrame, difference: str, cluster: str, by: list[str], flips: int = 2000, seed: int = 0) -> DataFrame:
    """A paired test by group that flips the signs of whole clusters: n, clusters, the mean difference, and p, the share of `flips` random
    choices of signs, the real one counted too, whose mean is as far from 0. Rows are summed up by cluster; signs are
    bits of hashes of the cluster, 60 to a hash, so that choices are sums over clusters and independent of partitions."""
    d = F.col(difference).cast("double")
    sums = df.filter(d.isNotNull()).groupBy(*by, F.col(cluster).alias("__c")).agg(F.sum(d).alias("__d"), F.count("*").alias("__n"))
    sums = stored(sums, "cluster-sums")
    blocks = -(-flips // 60)
    each = sums.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    name = F.concat(F.col("__b").cast("string"), F.lit(":"), F.coalesce(F.col("__c").cast("string"), F.lit("")))
    bits = F.conv(F.substring(hash_order(name, seed), 1, 15), 16, 10).cast("bigint")
    each = each.withColumn("__bits", bits).groupBy(*by, "__b")
    chosen = each.agg(*(F.sum(F.when(F.expr(f"shiftright(__bits, {r}) & 1") == 1, -F.col("__d")).otherwise(F.col("__d"))).alias(f"__s{r}") for r in range(60)), F.sum("__d").alias("__t"))
    far = sum((F.when((F.abs(f"__s{r}") >= F.abs("__t") - 1e-9) & (F.col("__b") * 60 + r < flips), 1).otherwise(0) for r in range(1, 60)), F.when(F.abs("__s0") >= F.abs("__t") - 1e-9, 1).otherwise(0))
    p = chosen.groupBy(*by).agg(((F.sum(far) + 1) / (flips + 1)).alias("p"))
    whole = sums.groupBy(*by).agg(F.sum("__n").alias("n"), F.count("*").alias("clusters"), (F.sum("__d") / F.sum("__n")).alias("mean"))
    return joined(whole, p, by)


def paired_effect(df: DataFrame, difference: str, by: list[str]) -> DataFrame:
    """n, the mean of paired differences, Cohen's d_z (NULL below two rows and without spread), and Hedges's small-sample form of it."""
    d = F.col(difference).cast("double")
    s = df.filter(d.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("__s"))
    dz = ratio(F.col("mean"), F.col("__s"))
    return s.withColumn("dz", dz).select(*by, "n", "mean", "dz", (F.col("dz") * (1 - 3 / (4 * (F.col("n") - 1) - 1.0))).alias("hedges"))
