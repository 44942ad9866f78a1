"""Changed copies of a table for robustness tests, all by hashes of keys, so that they don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.status import NOT_OBSERVABLE, NOT_SUPPLIED
from tessera.operators.splits import hash_order


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the key: the first 32 bits of its seeded MD5."""
    return F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def thinned(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """About `share` of the rows."""
    return df.filter(uniform(F.col(key), seed) < share)


def masked(df: DataFrame, key: str, value: str, status: str, share: float, seed: int = 0) -> DataFrame:
    """About `share` of the values become absent, with the status of something that wasn't supplied."""
    hit = uniform(F.col(key), seed) < share
    return df.withColumns({value: F.when(~hit, F.col(value)), status: F.when(hit, NOT_SUPPLIED).otherwise(F.col(status))})


def unobservable(df: DataFrame, where: str, value: str, status: str) -> DataFrame:
    """A regime that can't see a kind of rows: their values are absent as not observable."""
    hit = F.coalesce(F.expr(where), F.lit(False))
    return df.withColumns({value: F.when(~hit, F.col(value)), status: F.when(hit, NOT_OBSERVABLE).otherwise(F.col(status))})


def jittered(df: DataFrame, key: str, time: str, most: int, seed: int = 0) -> DataFrame:
    """Times moved by up to `most` either way."""
    move = F.floor((2 * uniform(F.col(key), seed) - 1) * most).cast("bigint")
    return df.withColumn(time, F.col(time) + move)


def repeated(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """About `share` of the rows twice; `copy` is 0 or 1."""
    times = F.when(uniform(F.col(key), seed) < share, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("copy", F.explode(times))


def node_balance(df: DataFrame, source: str, target: str, size: str) -> DataFrame:
    """Sizes into and out of each node, and the difference."""
    legs = df.select(F.col(source).alias("v"), F.col(size).alias("out"), F.lit(0).cast("double").alias("into")).unionAll(df.select(F.col(target).alias("v"), F.lit(0).cast("double").alias("out"), F.col(size).alias("into")))
    s = legs.groupBy("v").agg(F.sum("into").alias("into"), F.sum("out").alias("out"))
    return s.withColumn("balance", F.col("into") - F.col("out"))


def queue_statistics(df: DataFrame, by: list[str], arrival: str, departure: str, start: int, end: int) -> DataFrame:
    """Over [start, end): mean number present (L), arrival rate, mean stay of those that came within (W), and L less rate
    times W, which is what the edges of the window add."""
    inside = (F.col(arrival) >= start) & (F.col(arrival) < end)
    overlap = F.greatest(F.lit(0), F.least(F.col(departure), F.lit(end)) - F.greatest(F.col(arrival), F.lit(start)))
    stay = F.when(inside, F.col(departure) - F.col(arrival))
    s = df.groupBy(*by).agg((F.sum(overlap) / F.lit(float(end - start))).alias("present"), (F.sum(inside.cast("bigint")) / F.lit(float(end - start))).alias("rate"), F.avg(stay).alias("stay"))
    return s.withColumn("edge", F.col("present") - F.col("rate") * F.coalesce("stay", F.lit(0.0)))


def top_k_credit(df: DataFrame, probabilities: str, label: str, k: int) -> DataFrame:
    """Adds `credit`: the chance that the label (a place in the array, from 0) is among the k most likely ones if ties are
    broken at random, and `brier`, the sum of squared errors over classes."""
    p = F.element_at(probabilities, F.col(label) + 1)
    above = F.size(F.filter(probabilities, lambda x: x > p))
    equal = F.size(F.filter(probabilities, lambda x: x == p))
    credit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (k - above) / equal))
    squares = F.aggregate(probabilities, F.lit(0.0), lambda a, x: a + x * x)
    return df.withColumns({"credit": credit, "brier": squares - 2 * p + 1})
