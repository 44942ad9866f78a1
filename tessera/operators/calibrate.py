"""Calibration of forecasts from counts by value: bins of equal mass, several classes, and a temperature by maximum likelihood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import joined, ratio
from tessera.operators.ranks import running_totals
from tessera.sources.stored import stored


def _counts(df: DataFrame, p: str, label: str, by: list[str], times: str | None = None) -> DataFrame:
    """For each group and distinct forecast: n, the positives y, and the running total of n. A row counts `times` times."""
    if times:
        y = F.col(label).cast("double") * F.col(times)
        counts = df.filter(F.col(p).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(p).cast("double").alias("p")).agg(F.sum(times).alias("n"), F.sum(y).alias("y"))
        return stored(running_totals(counts, "p", ["n"], by), "forecasts")
    y = F.col(label).cast("double")
    counts = df.filter(F.col(p).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(p).cast("double").alias("p")).agg(F.count("*").alias("n"), F.sum(y).alias("y"))
    return stored(running_totals(counts, "p", ["n"], by), "forecasts")


def _mass_bin(bins: Column | int) -> Column:
    """The bin of a forecast where bins have equal mass: how many of the shares j / bins are reached with it. Ties share a bin."""
    b = F.lit(bins) if isinstance(bins, int) else bins
    return F.least(b - 1, F.expr("cum_n") * b / F.col("total_n")).cast("long")


def mass_calibration(df: DataFrame, p: str, label: str, by: list[str], bins: int) -> DataFrame:
    """The expected and the largest calibration error of each group over bins of equal mass."""
    cell = _counts(df, p, label, by).groupBy(*by, _mass_bin(bins).alias("bin")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("sp"), F.sum("y").alias("sy"))
    off = F.abs(F.col("sy") - F.col("sp"))
    return cell.groupBy(*by).agg(ratio(F.sum(off), F.sum("n").cast("double")).alias("ece"), F.max(off / F.col("n")).alias("mce"))


def sweep_calibration(df: DataFrame, p: str, label: str, by: list[str], most: int | None = None) -> DataFrame:
    """The calibration error over as many bins of equal mass as go without a frequency that falls, and their number (Roelofs et al., 2022).

    Numbers of bins are tried in rounds that double, all of a round and all groups at once, until each group has met a number whose
    frequencies fall (or `most`, or its number of rows). Only the counts are read again, and a round's bins are its numbers added up."""
    counts = _counts(df, p, label, by)
    cap = F.max("total_n") if most is None else F.least(F.max("total_n"), F.lit(most))
    left = stored(counts.groupBy(*by).agg(cap.alias("cap")), "sweep-left")
    found, first, last = None, 2, 8
    while not left.isEmpty():
        tried = joined(counts, left, by).withColumn("b", F.explode(F.sequence(F.lit(first), F.lit(last)))).filter("b <= cap")
        cell = tried.groupBy(*by, "b", _mass_bin(F.col("b")).alias("bin")).agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
        w = Window.partitionBy(*by, "b").orderBy("bin")
        falls = cell.withColumn("f", F.col("y") / F.col("n")).withColumn("falls", F.col("f") < F.lag("f").over(w))
        bad = falls.groupBy(*by, "b").agg((F.coalesce(F.max("falls"), F.lit(False)) | (F.count("*") < 2)).alias("bad")).filter("bad").groupBy(*by).agg(F.min("b").alias("stop"))
        state = stored(joined(left, bad, by, "left"), "sweep-state")
        ended = state.filter(F.col("stop").isNotNull() | (F.col("cap") <= last)).select(*by, F.greatest(F.coalesce(F.col("stop") - 1, F.col("cap")), F.lit(1)).cast("int").alias("bins"))
        found = ended if found is None else found.union(ended)
        left = stored(state.filter(F.col("stop").isNull() & (F.col("cap") > last)).select(*by, "cap"), "sweep-left")
        first, last = last + 1, 2 * last
    if found is None:
        return counts.select(*by, F.lit(1).alias("bins"), F.lit(0.0).alias("ece")).limit(0)
    cell = joined(counts, found, by).groupBy(*by, "bins", _mass_bin(F.col("bins")).alias("bin")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("sp"), F.sum("y").alias("sy"))
    return cell.groupBy(*by, "bins").agg(ratio(F.sum(F.abs(F.col("sy") - F.col("sp"))), F.sum("n").cast("double")).alias("ece"))


def multiclass(df: DataFrame, probs: str, label: str, by: list[str], bins: int) -> DataFrame:
    """Of forecasts for several classes (an array, and the index of the true class): n, the Brier score, the log loss (infinite where
    the true class had no chance), the mean over classes of each one's calibration error over `bins` of equal width, and over bins of equal mass
    the mean gap of the bins that hold something. Classes that are never there nor predicted are left out of the class mean."""
    rows = df.filter(F.col(probs).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(probs).alias("__q"), F.col(label).alias("__l")).agg(F.count("*").alias("__n"))
    rows, probs, label = stored(rows, "forecasts-told-apart"), "__q", "__l"  # equal rows once, before they are multiplied by the classes
    mean = lambda c: F.sum(c * F.col("__n")) / F.sum(F.when(c.isNotNull(), F.col("__n")))
    own = F.get(probs, F.col(label).cast("int"))
    square = F.aggregate(F.transform(probs, lambda q, i: F.pow(q - F.when(i == F.col(label), 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, b: a + b)
    whole = rows.groupBy(*by).agg(F.sum("__n").alias("n"), mean(square).alias("brier"), mean(F.when(own > 0, -F.log(own)).otherwise(float("inf"))).alias("log_loss"))
    each = rows.select(*by, "__n", F.posexplode(probs).alias("class", "p"), F.col(label).alias("__l")).withColumn("y", (F.col("class") == F.col("__l")).cast("int"))
    counts = _counts(each, "p", "y", [*by, "class"], "__n")
    gap = F.abs(F.sum("y") - F.sum(F.col("n") * F.col("p")))
    wide = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")
    by_class = counts.groupBy(*by, "class", wide).agg(gap.alias("__gap"), F.sum("n").alias("n"), F.sum("y").alias("y"), F.max("p").alias("p"))
    by_class = by_class.groupBy(*by, "class").agg((F.sum("__gap") / F.sum("n")).alias("ece"), F.sum("y").alias("y"), F.max("p").alias("p")).filter("y > 0 OR p > 0")
    classwise = by_class.groupBy(*by).agg(F.avg("ece").alias("classwise"))
    even = counts.groupBy(*by, "class", _mass_bin(bins).alias("bin")).agg((gap / F.sum("n")).alias("__gap")).groupBy(*by).agg(F.avg("__gap").alias("adaptive"))
    return joined(joined(whole, classwise, by), even, by)


def temperature(df: DataFrame, p: str, label: str, by: list[str], low: float = 0.05, high: float = 20.0, turns: int = 9) -> DataFrame:
    """The temperature of each group under which the labels are likeliest, between `low` and `high`: the logits are divided by it.

    The slope of the likelihood is monotone in 1 / temperature. Each turn looks at 15 places inside the bounds of every group at once, as sums
    of one aggregate over the counted forecasts, and keeps the sixteenth in which the slope changes its sign."""
    counts = _counts(df, p, label, by)
    q = F.least(F.greatest("p", F.lit(1e-12)), F.lit(1 - 1e-12))
    counts = stored(counts.select(*by, "n", "y", (F.log(q) - F.log1p(-q)).alias("z")), "logits")
    slope = lambda b: F.sum(F.col("z") * (F.col("n") / (1 + F.exp(-b * F.col("z"))) - F.col("y")))
    bounds = stored(counts.groupBy(*by).agg(slope(F.lit(1 / high)).alias("s0"), slope(F.lit(1 / low)).alias("s1")), "temperatures")
    known = F.when(F.col("s0") >= 0, F.lit(high)).when(F.col("s1") <= 0, F.lit(low))
    bounds = bounds.select(*by, known.alias("known"), F.lit(1 / high).alias("lo"), F.lit(1 / low).alias("hi"))
    for _ in range(turns):
        at = [F.col("lo") + (F.col("hi") - F.col("lo")) * j / 16 for j in range(1, 16)]
        rows = joined(counts, bounds, by).groupBy(*by, "known", "lo", "hi").agg(*(slope(b).alias(f"s{j}") for j, b in enumerate(at, 1)))
        below = sum(((F.col(f"s{j}") <= 0).cast("int") for j in range(1, 16)), F.lit(0))
        step = (F.col("hi") - F.col("lo")) / 16
        bounds = stored(rows.withColumn("k", below).select(*by, "known", (F.col("lo") + step * F.col("k")).alias("lo"), (F.col("lo") + step * (F.col("k") + 1)).alias("hi")), "temperatures")
    return bounds.select(*by, F.coalesce("known", 2 / (F.col("lo") + F.col("hi"))).alias("temperature"))
