"""Forecasts and regression: horizons with censoring, step functions, weighted quantiles, spectra, linear models."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import ratio
from tessera.operators.ranks import running_totals


def horizon_scores(df: DataFrame, p: str, event_step: str, observed: str, by: list[str], most: int) -> DataFrame:
    """For each horizon k: Brier score, mean forecast and share of events over the rows whose outcome at k is known (the
    event is there by k, or k steps were observed), and the mean of the cumulative CRPS up to k. `p` is an array of the
    chances of an event by step 1, 2, ...; a null event_step is no event."""
    rows = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most))))
    happened = F.coalesce(F.col(event_step) <= F.col("k"), F.lit(False))
    known = rows.filter(happened | (F.col(observed) >= F.col("k"))).withColumn("y", happened.cast("double"))
    pk = F.element_at(p, F.col("k"))
    step = F.coalesce(F.col(event_step), F.lit(1 << 30))
    crps = F.aggregate(F.sequence(F.lit(1), F.col("k")), F.lit(0.0), lambda a, j: a + F.pow(F.element_at(p, j) - F.when(step <= j, 1.0).otherwise(0.0), F.lit(2.0)))
    return known.groupBy(*by, "k").agg(F.count("*").alias("n"), F.avg(F.pow(pk - F.col("y"), F.lit(2.0))).alias("brier"), F.avg(pk).alias("mean_p"), F.avg("y").alias("observed"), F.avg(crps).alias("crps"))


def skill(model: DataFrame, reference: DataFrame, by: list[str], score: str) -> DataFrame:
    """1 - model / reference."""
    r = reference.select(*by, F.col(score).alias("__r"))
    return model.join(r, by).select(*by, (1 - ratio(F.col(score), F.col("__r"))).alias("skill"))


def weighted_quantile(df: DataFrame, value: str, weight: str, by: list[str], q: float) -> DataFrame:
    """The least value at which the running weight reaches the share q of the total."""
    w = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*by, value).agg(F.sum(weight).alias("w"))
    run = running_totals(w, value, ["w"], by)
    return run.filter(F.col("cum_w") >= q * F.col("total_w") * (1 - 1e-12)).groupBy(*by).agg(F.min(value).alias("quantile"))


def upper_tail_mean(df: DataFrame, value: str, weight: str, by: list[str], share: float) -> DataFrame:
    """The mean of the largest `share` of the weight; the value at the edge counts in part."""
    w = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*by, value).agg(F.sum(weight).cast("double").alias("w"))
    run = running_totals(w, value, ["w"], by)
    above = F.col("total_w") - F.col("cum_w")
    part = F.greatest(F.lit(0.0), F.least(F.col("w"), share * F.col("total_w") - above))
    return run.withColumn("__p", part).groupBy(*by).agg(ratio(F.sum(F.col("__p") * F.col(value)), F.sum("__p")).alias("mean"))


def periodogram(series: DataFrame, by: list[str], index: str, value: str, periods: list[int]) -> DataFrame:
    """Power of a gapless series at given periods (in steps), by sums with sines and cosines: |sum|^2 / n after the mean is
    taken off, and its share of the total variation. Each row is sent to each of the (few) periods."""
    mean = series.groupBy(*by).agg(F.avg(value).alias("__m"))
    x = series.join(mean, by).withColumn("__d", F.col(value) - F.col("__m")).withColumn("period", F.explode(F.array(*map(F.lit, periods))))
    angle = F.pmod(F.col(index), F.col("period")) * (2 * math.pi) / F.col("period")
    agg = x.groupBy(*by, "period").agg(F.sum(F.col("__d") * F.cos(angle)).alias("c"), F.sum(F.col("__d") * F.sin(angle)).alias("s"), F.sum(F.col("__d") ** 2).alias("v"), F.count("*").alias("n"))
    power = (F.col("c") ** 2 + F.col("s") ** 2) / F.col("n")
    return agg.select(*by, "period", power.alias("power"), ratio(power, F.col("v")).alias("share"))


def smoothed(series: DataFrame, by: list[str], index: str, value: str, bandwidth: float, reach: int) -> DataFrame:
    """A causal Gaussian kernel mean over the last `reach` steps of a gapless series, and what is left of the value."""
    w = Window.partitionBy(*by).orderBy(index)
    top, bottom = F.lit(0.0), F.lit(0.0)
    for i in range(reach + 1):
        k = math.exp(-0.5 * (i / bandwidth) ** 2)
        x = F.lag(value, i).over(w)
        top, bottom = top + F.coalesce(k * x, F.lit(0.0)), bottom + F.when(x.isNotNull(), k).otherwise(0.0)
    return series.withColumn("trend", ratio(top, bottom)).withColumn("residual", F.col(value) - F.col("trend"))


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less its mean, over its population deviation (1 if that is 0); NULL becomes 0. The moments are one row."""
    m = df.agg(*(F.avg(c).alias(f"__m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"__s_{c}") for c in columns))
    joined = df.crossJoin(F.broadcast(m))  # a single row
    z = {c: F.coalesce((F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0), F.lit(0.0)) for c in columns}
    return joined.withColumns(z).select(df.columns)


def ridge(df: DataFrame, features: list[str], target: str, penalty: float) -> DataFrame:
    """Coefficients of ridge regression with an unpenalised intercept, from sums that Spark adds up: (k + 2)^2 numbers reach
    the driver, however many rows there are. Rows with a NULL are left out."""
    names = [*features, target]
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in names)).dropna()
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    s = rows.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in names), *(F.covar_pop(a, b).alias(f"v_{i}") for i, (a, b) in enumerate(pairs))).first()
    k = len(features)
    cov = np.zeros((k + 1, k + 1))
    for i, (a, b) in enumerate(pairs):
        cov[names.index(a), names.index(b)] = cov[names.index(b), names.index(a)] = s[f"v_{i}"] or 0.0
    mean = np.array([s[f"m_{c}"] or 0.0 for c in names])
    beta = np.linalg.solve(cov[:k, :k] + penalty / max(s["n"], 1) * np.eye(k), cov[:k, k]) if s["n"] else np.zeros(k)
    out = [("intercept", float(mean[k] - beta @ mean[:k])), *((f, float(b)) for f, b in zip(features, beta))]
    return df.sparkSession.createDataFrame(out, "feature string, coefficient double")


def logistic(train: DataFrame, features: list[str], label: str, penalty: float = 1e-3, multinomial: bool = False):
    """A fitted pipeline (absent values become 0) of L2-regularised logistic regression, binary or softmax."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import SQLTransformer, VectorAssembler

    filled = SQLTransformer(statement="SELECT *, " + ", ".join(f"coalesce(CAST(`{c}` AS DOUBLE), 0D) AS `__x_{c}`" for c in features) + " FROM __THIS__")
    vector = VectorAssembler(inputCols=[f"__x_{c}" for c in features], outputCol="__features")
    model = LogisticRegression(featuresCol="__features", labelCol=label, regParam=penalty, elasticNetParam=0.0, family="multinomial" if multinomial else "binomial", maxIter=100)
    return Pipeline(stages=[filled, vector, model]).fit(train)


def hazard_model(df: DataFrame, features: list[str], step: str, event: str, most: int, penalty: float = 1e-3):
    """Discrete-time hazards: logistic regression on person-periods, with the step as one more feature."""
    from tessera.operators.survival import risk_sets

    rows = risk_sets(df, step, event, most).withColumn("y", F.col("y").cast("double"))
    return logistic(rows, [*features, "k"], "y", penalty)


def isotonic(df: DataFrame, score: str, label: str) -> DataFrame:
    """Calibrated chances by isotonic regression, one row for each step of the fitted function (score, chance)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    cells = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.avg(F.col(label).cast("double")).alias("__y"), F.count("*").cast("double").alias("__w"))
    x = VectorAssembler(inputCols=[score], outputCol="__v").transform(cells)
    model = IsotonicRegression(featuresCol="__v", labelCol="__y", weightCol="__w").fit(x)
    steps = list(zip(map(float, model.boundaries), map(float, model.predictions)))
    return df.sparkSession.createDataFrame(steps, "score double, chance double")
