"""What can be known at best: bounds of the error from counts by code and class, shares of labels, stationarity of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import ratio, slog1p, xlogx


def signed_log1p_clip(x: Column, clip: float) -> Column:
    """sign(x) * log(1 + |x|), within -clip and clip; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), slog1p(x))))


def fano_bound(bits: Column, classes: Column, steps: int = 50) -> Column:
    """The least error e with H(e) + e * log2(classes - 1) >= bits, by bisection between 0 and 1 - 1 / classes; 0 for one
    class."""
    top = 1 - 1 / classes.cast("double")
    bit = lambda p: -(xlogx(p) + xlogx(1 - p)) / F.log(F.lit(2.0))

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        enough = bit(mid) + mid * F.log2(F.greatest(classes - 1, F.lit(1)).cast("double")) >= bits
        return F.struct(F.when(enough, s["lo"]).otherwise(mid).alias("lo"), F.when(enough, mid).otherwise(s["hi"]).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), top.alias("hi")), halve, lambda s: s["hi"])
    return F.when((classes > 1) & (bits > 0), found).otherwise(0.0)


def nearest_bounds(error: Column, classes: Column) -> tuple[Column, Column]:
    """Bounds of the best error by that of the nearest neighbour (Cover and Hart): lower and upper."""
    k = classes.cast("double")
    lower = F.when(k > 1, (k - 1) / k * (1 - F.sqrt(F.greatest(F.lit(0.0), 1 - k / (k - 1) * error)))).otherwise(0.0)
    return lower, error


def error_bounds(df: DataFrame, code: str, label: str, by: list[str]) -> DataFrame:
    """By group: n, classes, the bits of the label that the code leaves open, the error of the most frequent label of each
    code, the bounds by Fano (lower) and by Hellman and Raviv (upper), and the information coefficient. Only counts by code
    and label are shuffled; rows without label or group are left out, a null code is a code. `by` names one column or more."""
    cells = df.filter(F.col(label).isNotNull()).groupBy(*by, code, label).agg(F.count("*").alias("n"))
    codes = cells.groupBy(*by, code).agg(F.sum("n").alias("m"), F.max("n").alias("best"), F.sum(xlogx(F.col("n").cast("double"))).alias("inner"))
    open_ = codes.groupBy(*by).agg(F.sum("m").alias("n"), F.sum("best").alias("best"), F.sum(xlogx(F.col("m").cast("double")) - F.col("inner")).alias("left"))
    labels = cells.groupBy(*by, label).agg(F.sum("n").alias("m")).groupBy(*by).agg(F.count("*").alias("classes"), F.sum(xlogx(F.col("m").cast("double"))).alias("own"))
    both = open_.join(labels, by)
    nats = F.greatest(F.lit(0.0), F.col("left") / F.col("n"))
    shared = F.greatest(F.lit(0.0), F.log(F.col("n").cast("double")) - F.col("own") / F.col("n") - nats)
    bits = nats / F.log(F.lit(2.0))
    return both.select(
        *by, "n", "classes", bits.alias("bits"), (1 - F.col("best") / F.col("n")).alias("error"), fano_bound(bits, F.col("classes")).alias("fano"), (bits / 2).alias("hellman_raviv"),
        F.sqrt(1 - F.exp(-2 * shared)).alias("coefficient"),
    )


def label_shares(df: DataFrame, source: str, malicious: str) -> DataFrame:
    """By source: rows, and the shares that are malicious (1), harmless (0) and not known (NULL)."""
    m = F.col(malicious)
    return df.groupBy(source).agg(
        F.count("*").alias("n"), F.avg(m.eqNullSafe(1).cast("int")).alias("malicious"), F.avg(m.eqNullSafe(0).cast("int")).alias("harmless"), F.avg(m.isNull().cast("int")).alias("unknown")
    )


def observed_days(df: DataFrame, us: str, networks: list[str], by: list[str]) -> DataFrame:
    """By group: the days between first and last row of each network, added up."""
    spans = df.filter(F.col(us).isNotNull()).groupBy(*by, *networks).agg((F.max(us) - F.min(us)).alias("span"))
    return spans.groupBy(*by).agg((F.sum("span") / 86_400_000_000).alias("days"))


def alerts_per_day(df: DataFrame, alert: Column, us: str, networks: list[str], by: list[str]) -> DataFrame:
    """By group, null keys and groups without any time included: alerts, days observed, and alerts a day (NULL without days)."""
    key = F.struct(*by).alias("__g")
    alerts = df.groupBy(key).agg(F.coalesce(F.sum(alert.cast("bigint")), F.lit(0)).alias("alerts"))
    out = alerts.join(observed_days(df, us, networks, by).select(key, "days"), "__g", "left")
    return out.select(*(F.col(f"__g.{c}").alias(c) for c in by), "alerts", "days", ratio(F.col("alerts"), F.col("days")).alias("per_day"))


def kpss(series: DataFrame, time: str, value: str, by: list[str], lags: int) -> DataFrame:
    """By group: n and the statistic of a level's stationarity: squared partial sums of what differs from the mean, over the
    long-run variance with Bartlett weights up to `lags`. series has one row for each group and step, as counts or means by
    step; rows are few beside what they are made of. NULL where the variance is zero."""
    w = Window.partitionBy(*by).orderBy(time)
    e = series.filter(F.col(value).isNotNull()).withColumn("__e", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))
    rows = e.withColumns({"__s": F.sum("__e").over(w.rowsBetween(Window.unboundedPreceding, 0)), **{f"__l{j}": F.col("__e") * F.lag("__e", j).over(w) for j in range(1, lags + 1)}})
    around = sum((2 * (1 - j / (lags + 1)) * F.coalesce(F.sum(f"__l{j}"), F.lit(0.0)) for j in range(1, lags + 1)), F.sum(F.col("__e") ** 2))
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("__s") ** 2).alias("__sq"), around.alias("__v"))
    return s.select(*by, "n", ratio(F.col("__sq"), F.col("n") * F.col("__v")).alias("kpss"))


def label_violations(df: DataFrame, key: str) -> DataFrame:
    """One row per invariant of a label table and the rows that break it: malicious is 0, 1 or NULL; stage is from -1 to 14;
    what isn't mapped states nothing; a stage says malicious; keys are there and single."""
    repeated = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    m, s = F.col("malicious"), F.col("stage")
    rules = {
        "malicious": ~m.isin(0, 1), "stage": ~s.between(-1, 14), "unmapped": ~F.col("mapped") & m.isNotNull(), "stage_of_harmless": (s >= 0) & (m == 0), "no_key": F.col(key).isNull(),
    }
    wide = df.agg(*(F.coalesce(count(c), F.lit(0)).alias(n) for n, c in rules.items()))
    long = wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules))).alias("r")).select("r.*")
    keys = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).agg(repeated.alias("violations"))
    return long.union(keys.select(F.lit("repeated_key").alias("rule"), "violations"))
