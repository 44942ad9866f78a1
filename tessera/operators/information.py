"""Entropies, mutual information and divergences from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import xlogx


def entropies(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Per group of counts: the plug-in entropy in nats, Miller and Madow's correction, Chao and Shen's estimate (whole
    counts; if all are single, one of them counts as two), and the number of symbols. Zero counts are left out."""
    rows = counts.filter(F.col(n) > 0)
    sums = rows.groupBy(*by).agg(F.sum(n).cast("double").alias("whole"), F.count("*").alias("m"), F.sum(F.when(F.col(n) == 1, 1.0).otherwise(0.0)).alias("f1"))
    sums = sums.withColumn("f1", F.when(F.col("f1") == F.col("whole"), F.col("whole") - 1).otherwise(F.col("f1")))
    joined = rows.join(sums, by) if by else rows.crossJoin(F.broadcast(sums))  # sums is a single row then
    p = F.col(n) / F.col("whole")
    cp = (1 - F.col("f1") / F.col("whole")) * p
    seen = 1 - F.pow(1 - cp, F.col("whole"))
    return joined.groupBy(*by).agg(
        F.max("m").alias("symbols"), F.max("whole").alias("total"), (-F.sum(xlogx(p))).alias("plugin"), (-F.sum(xlogx(p)) + (F.max("m") - 1) / (2 * F.max("whole"))).alias("miller_madow"),
        (-F.sum(F.when(cp > 0, cp * F.log(cp) / seen).otherwise(0.0))).alias("chao_shen"),
    )


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """I(x; y) = H(x) + H(y) - H(x, y) in nats, plug-in and with Miller and Madow's correction of each entropy."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    sets = rows.groupingSets([[x], [y], [x, y]], x, y).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    per = sets.groupBy("g").agg(F.sum("n").cast("double").alias("whole"), F.count("*").alias("m"), F.sum(xlogx(F.col("n").cast("double"))).alias("s"))
    h = F.log("whole") - F.col("s") / F.col("whole")
    sign = F.when(F.col("g") == 0, -1.0).otherwise(1.0)
    return per.agg(F.sum(sign * h).alias("mi"), F.sum(sign * (h + (F.col("m") - 1) / (2 * F.col("whole")))).alias("mi_miller_madow"))


def jensen_shannon(counts: DataFrame, symbol: str, p: str, q: str, by: list[str]) -> DataFrame:
    """Jensen-Shannon divergence in nats of two columns of counts over the same symbols; null if either is empty."""
    sums = counts.groupBy(*by).agg(F.sum(p).cast("double").alias("sum_p"), F.sum(q).cast("double").alias("sum_q"))
    joined = counts.join(sums, by)
    a, b = F.col(p) / F.col("sum_p"), F.col(q) / F.col("sum_q")
    js = F.greatest(F.lit(0.0), F.sum(-xlogx((a + b) / 2) + (xlogx(a) + xlogx(b)) / 2))
    return joined.filter("sum_p > 0 AND sum_q > 0").groupBy(*by).agg(js.alias("jsd"))


def information_coefficient(mi: Column) -> Column:
    return F.sqrt(1 - F.exp(-2 * mi))


def lagged_mutual_information(df: DataFrame, group: str, order: list[str], x: str, lags: list[int]) -> DataFrame:
    """Mutual information of a column with itself `lag` rows later in its group, one row for each lag."""
    from functools import reduce

    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(*order)
    later = df.withColumns({f"__l{k}": F.lead(x, k).over(w) for k in lags})
    parts = [mutual_information(later, x, f"__l{k}").select(F.lit(k).alias("lag"), "mi", "mi_miller_madow") for k in lags]
    return reduce(DataFrame.union, parts)
