"""How well scores rank: everything comes from the numbers of positive and negative rows of each distinct score."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import ratio
from tessera.operators.ranks import running_totals


def tie_groups(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Per group and distinct score: p and n, with running totals from the lowest score and totals. Rows with a null
    score or label are left out."""
    y = F.col(label).cast("int")
    counts = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.sum(y).cast("bigint").alias("p"), F.sum(1 - y).cast("bigint").alias("n"))
    return running_totals(counts, score, ["p", "n"], by)


def curve(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """For each threshold (a distinct score; rows at it or above are alerts): tp, fp, tpr, fpr, precision."""
    g = tie_groups(df, score, label, by)
    tp, fp = F.col("total_p") - F.col("cum_p") + F.col("p"), F.col("total_n") - F.col("cum_n") + F.col("n")
    g = g.withColumns({"tp": tp, "fp": fp})
    return g.select(*by, F.col(score).alias("threshold"), "p", "n", "tp", "fp", "total_p", "total_n", ratio(F.col("tp"), F.col("total_p")).alias("tpr"), ratio(F.col("fp"), F.col("total_n")).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def ranking(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """AUROC (ties count half), average precision, and the numbers of both classes; null without both."""
    c = curve(df, score, label, by)
    below = F.col("total_n") - F.col("fp")
    return c.groupBy(*by).agg(
        F.max("total_p").alias("positives"), F.max("total_n").alias("negatives"), ratio(F.sum(F.col("p") * (below + F.col("n") / 2)), F.max("total_p").cast("double") * F.max("total_n")).alias("auroc"),
        ratio(F.sum(F.col("p") * F.col("precision")), F.max("total_p")).alias("average_precision"),
    )


def delong(df: DataFrame, score: str, label: str, by: list[str], z: float = 1.959963984540054) -> DataFrame:
    """AUROC with DeLong's variance and an interval cut to [0, 1]."""
    c = curve(df, score, label, by)
    pos, neg = F.col("total_p").cast("double"), F.col("total_n").cast("double")
    v10 = (F.col("total_n") - F.col("fp") + F.col("n") / 2) / neg
    v01 = (F.col("tp") - F.col("p") + F.col("p") / 2) / pos
    x = c.filter("total_p > 1 AND total_n > 1").withColumns({"v10": v10, "v01": v01})
    a = x.groupBy(*by).agg(
        F.max("total_p").cast("double").alias("np"), F.max("total_n").cast("double").alias("nn"), F.sum(F.col("p") * F.col("v10")).alias("s10"), F.sum(F.col("p") * F.col("v10") ** 2).alias("q10"),
        F.sum(F.col("n") * F.col("v01")).alias("s01"), F.sum(F.col("n") * F.col("v01") ** 2).alias("q01"),
    )
    var = (F.col("q10") - F.col("s10") ** 2 / F.col("np")) / (F.col("np") - 1) / F.col("np") + (F.col("q01") - F.col("s01") ** 2 / F.col("nn")) / (F.col("nn") - 1) / F.col("nn")
    a = a.withColumns({"auroc": F.col("s10") / F.col("np"), "se": F.sqrt(F.greatest(var, F.lit(0.0)))})
    return a.select(*by, "auroc", "se", F.greatest(F.lit(0.0), F.col("auroc") - z * F.col("se")).alias("lo"), F.least(F.lit(1.0), F.col("auroc") + z * F.col("se")).alias("hi"))


def operating_point(df: DataFrame, score: str, label: str, by: list[str], fpr: float) -> DataFrame:
    """The lowest threshold whose false positive rate is at most `fpr`, with its rates; none: no threshold and rates 0."""
    c = curve(df, score, label, by)
    ok = F.col("fpr") <= fpr
    best = c.groupBy(*by).agg(F.min(F.when(ok, F.col("threshold"))).alias("threshold"), F.max(F.when(ok, F.col("tpr"))).alias("tpr"), F.max(F.when(ok, F.col("fpr"))).alias("fpr"))
    return best.fillna(0.0, ["tpr", "fpr"])


def best_threshold(df: DataFrame, score: str, label: str, by: list[str], criterion: str = "f1") -> DataFrame:
    """The highest threshold of largest F1 or Youden's J. The cut is midway to the next lower distinct score."""
    c = curve(df, score, label, by)
    value = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("total_p")) if criterion == "f1" else F.col("tpr") - F.col("fpr")
    c = c.withColumn("value", F.round(value, 12))
    best = c.groupBy(*by).agg(F.max(F.struct("value", "threshold")).alias("b")).select(*by, "b.value", F.col("b.threshold").alias("__t"))
    lower = c.join(best.select(*by, "__t"), by).filter("threshold < __t").groupBy(*by).agg(F.max("threshold").alias("__n")) if by else c.crossJoin(F.broadcast(best.select("__t"))).filter("threshold < __t").agg(F.max("threshold").alias("__n"))
    out = best.join(lower, by, "left") if by else best.crossJoin(lower)
    return out.select(*by, "value", ((F.col("__t") + F.coalesce("__n", "__t")) / 2).alias("cut"))


def conformal(df: DataFrame, score: str, label: str, by: list[str], alpha: str) -> DataFrame:
    """The k-th smallest score of negative rows, k = ceil((n + 1) (1 - alpha)), exactly; null (no alert) if k > n."""
    keep = 1 - Fraction(alpha)
    g = tie_groups(df, score, label, by).filter("n > 0")
    k = F.expr(f"((total_n + 1) * {keep.numerator} + {keep.denominator - 1}) div {keep.denominator}")
    g = g.withColumn("k", k)
    return g.groupBy(*by).agg(F.max("k").alias("k"), F.max("total_n").alias("negatives"), F.min(F.when(F.col("cum_n") >= F.col("k"), F.col(score))).alias("threshold"))


def partial_auroc(df: DataFrame, score: str, label: str, by: list[str], most: float) -> DataFrame:
    """Area under the ROC curve up to a false positive rate, and McClish's standardised form."""
    from tessera.operators.ranks import PART, ranged

    rows = ranged(curve(df, score, label, by), "threshold")
    # the segment that ends at a threshold starts at tp - p, fp - n
    t1, f1 = F.col("tpr"), F.col("fpr")
    t0, f0 = (F.col("tp") - F.col("p")) / F.col("total_p"), (F.col("fp") - F.col("n")) / F.col("total_n")
    end = F.least(f1, F.lit(most))
    t_end = t0 + F.when(f1 > f0, (t1 - t0) * (end - f0) / (f1 - f0)).otherwise(0.0)
    area = rows.drop(PART).withColumn("a", F.when(f0 < most, (end - f0) * (t0 + t_end) / 2).otherwise(0.0)).groupBy(*by).agg(F.sum("a").alias("area"))
    low = most * most / 2
    return area.withColumn("standardised", 0.5 * (1 + (F.col("area") - low) / (most - low)))


def rates(df: DataFrame, decision: str, label: str, by: list[str]) -> DataFrame:
    """Counts of the confusion matrix and its ratios; a ratio without a denominator is NULL."""
    d, y = F.expr(decision), F.col(label)
    c = df.groupBy(*by).agg(*(F.sum((e).cast("bigint")).alias(k) for k, e in {"tp": d & y, "fp": d & ~y, "fn": ~d & y, "tn": ~d & ~y}.items()))
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    f1 = F.when(precision.isNotNull() & recall.isNotNull(), ratio(2 * tp, 2 * tp + fp + fn))
    mcc = ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return c.select(
        *by, "tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), specificity.alias("specificity"), ratio(tn, tn + fn).alias("npv"), f1.alias("f1"),
        ratio(fp, fp + tn).alias("fpr"), ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), ((recall + specificity) / 2).alias("balanced"), mcc.alias("mcc"),
    )


def reliability(df: DataFrame, p: str, label: str, by: list[str], bins: int) -> DataFrame:
    """Equal-width bins of forecasts: rows, mean forecast, observed share."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)))
    return df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("observed"))


def calibration(df: DataFrame, p: str, label: str, by: list[str], bins: int) -> DataFrame:
    """Expected and maximal calibration error, Brier score and log loss (forecasts cut to [1e-12, 1 - 1e-12])."""
    r = reliability(df, p, label, by, bins).withColumn("gap", F.abs(F.col("mean_p") - F.col("observed")))
    ece = r.groupBy(*by).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))
    y, q = F.col(label).cast("double"), F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(p)))
    loss = df.groupBy(*by).agg(F.avg((F.col(p) - y) ** 2).alias("brier"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"))
    return ece.join(loss, by) if by else ece.crossJoin(loss)  # one row each


def brier_decomposition(df: DataFrame, p: str, label: str, by: list[str], bins: int) -> DataFrame:
    """reliability - resolution + uncertainty, with the variance and covariance within bins that make it exact."""
    y = F.col(label).cast("double")
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)))
    cells = df.groupBy(*by, b.alias("bin")).agg(F.count("*").cast("double").alias("n"), F.avg(p).alias("f"), F.avg(y).alias("o"), F.sum(F.col(p) ** 2).alias("ff"), F.sum(F.col(p) * y).alias("fo"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    cells = cells.withColumns({"whole": F.sum("n").over(w), "base": F.sum(F.col("n") * F.col("o")).over(w) / F.sum("n").over(w)})
    f, o, n = F.col("f"), F.col("o"), F.col("n")
    return cells.groupBy(*by).agg(
        (F.sum(n * (f - o) ** 2) / F.max("whole")).alias("reliability"), (F.sum(n * (o - F.col("base")) ** 2) / F.max("whole")).alias("resolution"), (F.max("base") * (1 - F.max("base"))).alias("uncertainty"),
        (F.sum(F.col("ff") - n * f**2) / F.max("whole")).alias("within_variance"), (2 * F.sum(F.col("fo") - n * f * o) / F.max("whole")).alias("within_covariance"),
    )
