"""Running totals, quantiles and ranks over an order of all rows, without a window over all rows.

Rows are first counted by value. Values are cut into ranges at approximate quantiles (a bounded list), each range is
summed up by itself, and the totals of the ranges before it, one row each, are added. So no task gets more than a range,
even where there is a single group or one value has most rows.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import joined

PART = "__part"


def ranged(df: DataFrame, value: str, parts: int | None = None) -> DataFrame:
    """df with the number of the range that its value is in; as many ranges as shuffle partitions, 1000 at most."""
    parts = parts or min(1000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    points = df.agg(F.percentile_approx(F.col(value).cast("double"), [i / parts for i in range(1, parts)] or [0.5], 20 * parts)).first()[0]
    inner = sorted(set(points or []))
    if not inner:
        return df.withColumn(PART, F.lit(0.0))
    cut = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="__v", outputCol=PART)
    return cut.transform(df.withColumn("__v", F.col(value).cast("double"))).drop("__v")


def running_totals(counts: DataFrame, value: str, sums: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds cum_<s> (up to and with this value, ascending) and total_<s> for each column s. counts has one row for each
    group and value; values are not null."""
    by = by or []
    rows = ranged(counts, value)
    within = Window.partitionBy(*by, PART).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = rows.groupBy(*by, PART).agg(*(F.sum(s).alias(f"__p_{s}") for s in sums))
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = parts.select(
        *by, PART, *(F.coalesce(F.sum(f"__p_{s}").over(before), F.lit(0)).alias(f"__b_{s}") for s in sums), *(F.sum(f"__p_{s}").over(whole).alias(f"total_{s}") for s in sums)
    )
    rows = joined(rows.withColumns({f"cum_{s}": F.sum(s).over(within) for s in sums}), offsets, [*by, PART])
    return rows.withColumns({f"cum_{s}": F.col(f"cum_{s}") + F.col(f"__b_{s}") for s in sums}).drop(PART, *(f"__b_{s}" for s in sums))


def value_counts(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*(by or []), value).agg(F.count("*").alias("n"))


def value_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """One row for each group and distinct value: n, mid-rank (ties share the mean of their ranks, from 1) and total_n."""
    ranked = running_totals(value_counts(df, value, by), value, ["n"], by)
    return ranked.withColumn("midrank", F.col("cum_n") - (F.col("n") - 1) / 2)


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles, linearly interpolated between order statistics, as one column for each name in probs."""
    return ranked_quantiles(running_totals(value_counts(df, value, by), value, ["n"], by), value, probs, by)


def ranked_quantiles(ranked: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """The same, of values that have been counted and have running totals of n."""
    x, below, upto, last = F.col(value).cast("double"), F.col("cum_n") - F.col("n"), F.col("cum_n"), F.col("total_n") - 1

    def at(rank: Column) -> Column:
        return F.max(F.when((below <= rank) & (rank < upto), x))

    out = []
    for name, p in probs.items():
        h = last * F.lit(float(p))
        out += [at(F.floor(h)).alias(f"__lo_{name}"), at(F.ceil(h)).alias(f"__hi_{name}"), F.max(h - F.floor(h)).alias(f"__f_{name}")]
    found = ranked.groupBy(*(by or [])).agg(*out)
    return found.select(*(by or []), *((F.col(f"__lo_{n}") + F.col(f"__f_{n}") * (F.col(f"__hi_{n}") - F.col(f"__lo_{n}"))).alias(n) for n in probs))
