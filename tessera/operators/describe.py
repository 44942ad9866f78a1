"""Descriptive statistics: class balance, robust summaries, histograms, frequent values, tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import joined, ratio, xlogx
from tessera.operators.ranks import quantiles, ranked_quantiles, running_totals, value_counts
from tessera.sources.stored import stored


def balance(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts of each pair, their share within the outer key, and the outer key's totals (null inner key)."""
    sets = df.groupingSets([[outer, inner], [outer]], outer, inner).agg(F.count("*").alias("n"), F.grouping(inner).cast("int").alias("total"))
    whole = F.max(F.when(F.col("total") == 1, F.col("n"))).over(Window.partitionBy(outer))
    return sets.withColumn("share", F.col("n") / whole)


def evenness(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Of the classes in each group: number, Shannon entropy (nats), Pielou's J (null for one class), effective number,
    Gini-Simpson index, and the ratio of the largest to the smallest class."""
    counts = df.groupBy(outer, inner).agg(F.count("*").alias("n"))
    n = F.sum("n")
    sums = counts.groupBy(outer).agg(F.count("*").alias("classes"), n.alias("n"), F.sum(xlogx(F.col("n").cast("double"))).alias("nlogn"), F.sum(F.col("n").cast("double") ** 2).alias("sq"), (F.max("n") / F.min("n")).alias("imbalance"))
    h = F.log(F.col("n").cast("double")) - F.col("nlogn") / F.col("n")
    return sets_of(sums, outer, h)


def sets_of(sums: DataFrame, outer: str, h: Column) -> DataFrame:
    return sums.select(
        outer, "classes", "n", h.alias("shannon"), F.when(F.col("classes") > 1, h / F.log(F.col("classes").cast("double"))).alias("pielou"), F.exp(h).alias("effective"),
        (1 - F.col("sq") / (F.col("n").cast("double") ** 2)).alias("gini_simpson"), "imbalance",
    )


def robust_summary(df: DataFrame, value: str, by: list[str], trim: float = 0.1) -> DataFrame:
    """n, min, max, mean, sd (n - 1), quartiles, octile and quartile shape, MAD (times 1.4826) and the mean without the
    smallest and largest `trim` share of the rows of each group. NULL values are left out, null keys are groups; a group without
    values has no row. Rows are read once, to count them by value; everything else comes from the counts, which are put in order twice."""
    ranked = stored(running_totals(value_counts(df, value, by), value, ["n"], by), "ranked-values")
    x, n = F.col(value).cast("double"), F.col("n")
    cut = F.floor(F.col("total_n") * trim)
    kept = F.greatest(F.lit(0), F.least("cum_n", F.col("total_n") - cut) - F.greatest(F.col("cum_n") - n, cut))
    plain = ranked.groupBy(*by).agg(
        F.sum(n).alias("__n"), F.min(value).alias("min"), F.max(value).alias("max"), (F.sum(n * x) / F.sum(n)).alias("mean"), (F.sum(kept * x) / F.sum(kept)).alias("trimmed_mean")
    )
    plain = stored(joined(plain, ranked_quantiles(ranked, value, {f"o{i}": i / 8 for i in range(1, 8)}, by), by), "quantiles")
    off = joined(ranked.select(*by, value, "n"), plain.select(*by, "mean", "o4"), by)
    sd = off.groupBy(*by).agg(F.when(F.sum(n) > 1, F.sqrt(F.sum(n * (x - F.col("mean")) ** 2) / (F.sum(n) - 1))).alias("sd"))
    away = off.groupBy(*by, F.abs(x - F.col("o4")).alias("__away")).agg(F.sum(n).alias("n"))
    mad = ranked_quantiles(running_totals(away, "__away", ["n"], by), "__away", {"mad": 0.5}, by).withColumn("mad", 1.4826 * F.col("mad"))
    out = joined(joined(plain, sd, by), mad, by)
    o = {i: F.col(f"o{i}") for i in range(1, 8)}
    return out.select(
        *by, F.col("__n").alias("n"), "min", "max", "mean", "sd", o[2].alias("q1"), o[4].alias("median"), o[6].alias("q3"), (o[6] - o[2]).alias("iqr"), "mad", "trimmed_mean",
        ratio(o[6] + o[2] - 2 * o[4], o[6] - o[2]).alias("bowley"), ratio((o[7] - o[5]) + (o[3] - o[1]), o[6] - o[2]).alias("moors"),
    )


def histogram(df: DataFrame, value: str, by: list[str], most: int = 200) -> DataFrame:
    """Bins of equal width 2 * IQR * n**(-1/3) (Freedman and Diaconis), `most` at most; the last one is closed."""
    q = quantiles(df, value, {"q1": 0.25, "q3": 0.75}, by).join(df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")), by)
    width = 2 * (F.col("q3") - F.col("q1")) * F.pow(F.col("n").cast("double"), F.lit(-1 / 3))
    bins = F.when(width > 0, F.least(F.lit(most), F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / width)))).otherwise(1).cast("int")
    q = q.withColumn("bins", bins).withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    placed = df.filter(F.col(value).isNotNull()).join(q, by)
    at = F.when(F.col("width") > 0, F.least(F.col("bins") - 1, F.floor((F.col(value) - F.col("lo")) / F.col("width")))).otherwise(0)
    return placed.withColumn("bin", at.cast("int")).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.max("bins").alias("bins"))


def top_values(df: DataFrame, value: str, by: list[str], top: int) -> DataFrame:
    """The `top` most frequent values of each group (ties: the smaller value) and one row of the others, value null."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), value)
    ranked = counts.withColumn("r", F.row_number().over(order))
    code = F.when(F.col("r") <= top, F.col(value))
    return ranked.groupBy(*by, code.alias(value)).agg(F.sum("n").alias("n"))


def log_histogram(df: DataFrame, value: str, by: list[str], per_decade: int = 10) -> DataFrame:
    """Counts and densities in bins of equal width in log10, for positive values."""
    rows = df.filter(F.col(value) > 0).withColumn("bin", F.floor(F.log10(F.col(value)) * per_decade))
    counts = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    width = F.pow(F.lit(10.0), (F.col("bin") + 1) / per_decade) - F.pow(F.lit(10.0), F.col("bin") / per_decade)
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(*by)) * width))


def hill(df: DataFrame, value: str, by: list[str], k: int) -> DataFrame:
    """Hill's estimate of the tail index from the k largest values of each group; null where there are no k + 1."""
    top = df.filter(F.col(value) > 0).withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value)))).filter(F.col("r") <= k + 1)
    agg = top.groupBy(*by).agg(F.count("*").alias("m"), F.sum(F.when(F.col("r") <= k, F.log(value))).alias("s"), F.max(F.when(F.col("r") == k + 1, F.log(value))).alias("last"))
    return agg.select(*by, F.when(F.col("m") == k + 1, F.col("s") / k - F.col("last")).alias("gamma"))


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def correlation(df: DataFrame, x: Column, y: Column, by: list[str], level: float = 0.95) -> DataFrame:
    """Pearson's r over rows where both are present, with Fisher's interval (null below 4 rows)."""
    rows = df.select(*by, x.alias("x"), y.alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    agg = rows.groupBy(*by).agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
    z, half = F.atanh("r"), F.lit(normal_quantile(0.5 + level / 2)) / F.sqrt(F.col("n") - 3.0)
    ok = F.col("n") > 3
    return agg.select(*by, "n", "r", F.when(ok, F.tanh(z - half)).alias("lo"), F.when(ok, F.tanh(z + half)).alias("hi"))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson's r of mid-ranks over rows where both are present."""
    from tessera.operators.ranks import value_ranks

    rows = df.select(*by, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = rows.groupBy(*by, x, y).agg(F.count("*").alias("w"))
    rx, ry = (value_ranks(rows, c, by).select(*by, c, F.col("midrank").alias(f"r_{c}")) for c in (x, y))
    m = cells.join(rx, [*by, x]).join(ry, [*by, y]).withColumns({"a": F.col(f"r_{x}"), "b": F.col(f"r_{y}")})
    s = m.groupBy(*by).agg(F.sum("w").alias("n"), *(F.sum(F.col("w") * e).alias(k) for k, e in {"sa": F.col("a"), "sb": F.col("b"), "saa": F.col("a") ** 2, "sbb": F.col("b") ** 2, "sab": F.col("a") * F.col("b")}.items()))
    top = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    bottom = F.sqrt((F.col("saa") - F.col("sa") ** 2 / F.col("n")) * (F.col("sbb") - F.col("sb") ** 2 / F.col("n")))
    return s.select(*by, "n", ratio(top, bottom).alias("rho"))


def cramers_v(df: DataFrame, x: str, y: str) -> DataFrame:
    """Bias-corrected Cramer's V (Bergsma) of two columns, and chi-square."""
    cells = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("n"))
    rows, cols = (cells.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in (x, y))
    # chi2 = n * (sum of n_ij^2 / (n_i n_j) - 1), so that empty cells need no rows
    joined = cells.join(rows, x).join(cols, y)
    agg = joined.agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 2 / (F.col(f"n_{x}").cast("double") * F.col(f"n_{y}"))).alias("s"), F.countDistinct(x).alias("r"), F.countDistinct(y).alias("c"))
    phi2 = F.col("s") - 1
    adj = F.greatest(F.lit(0.0), phi2 - (F.col("r") - 1.0) * (F.col("c") - 1.0) / (F.col("n") - 1.0))
    rr, cc = (F.col(k) - (F.col(k) - 1.0) ** 2 / (F.col("n") - 1.0) for k in ("r", "c"))
    return agg.select("n", (phi2 * F.col("n")).alias("chi2"), F.sqrt(ratio(adj, F.least(rr - 1, cc - 1))).alias("v"))




def trimmed_middle(df: DataFrame, value: str, by: list[str], share: float = 0.25) -> DataFrame:
    """The mean of each group without its floor(share * n) least and as many largest values (share 0.25: interquartile
    mean), from counts by value. Of a value on a cut, the rows on the inner side count."""
    run = running_totals(value_counts(df, value, by), value, ["n"], by)
    cut = F.floor(F.col("total_n") * share + 1e-9)
    inside = F.least(F.col("cum_n"), F.col("total_n") - cut) - F.greatest(F.col("cum_n") - F.col("n"), cut)
    kept = run.withColumn("__k", F.greatest(inside, F.lit(0)))
    return kept.groupBy(*by).agg(F.max("total_n").alias("n"), (F.sum(F.col(value) * F.col("__k")) / F.sum("__k")).alias("mean"))


def ensemble_crps(members: Column, observed: Column) -> Column:
    """The fair continuous ranked probability score of an array of forecasts: the mean distance to what came, less half
    of the mean distance between two different members. Null for fewer than two members."""
    m = F.size(members)
    far = F.aggregate(members, F.lit(0.0), lambda s, x: s + F.abs(x - observed)) / m
    ordered = F.array_sort(members)
    # of sorted members, member i (from 0) stands in the differences 2 * i + 1 - m times more with plus than with minus
    spread = F.aggregate(F.zip_with(ordered, F.sequence(F.lit(0), m - 1), lambda x, i: x * (2 * i + 1 - m)), F.lit(0.0), lambda s, x: s + x)
    return F.when(m > 1, far - spread / (m * (m - 1)))
