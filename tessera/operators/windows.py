"""Event-time windows and sequences: gaps, counts with true zeros, running deltas, bursts, triggers, sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import ceil_div, floor_div, ratio


def count_series(df: DataFrame, by: list[str], time: str, width: int) -> DataFrame:
    """Counts in bins of `width` from each key's first event to its last; bins without events are rows with 0."""
    ends = df.groupBy(*by).agg(F.min(time).alias("__lo"), F.max(time).alias("__hi"))
    spine = ends.select(*by, "__lo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(__hi - __lo) div {width}"))).alias("bin"))
    placed = df.join(ends.select(*by, "__lo"), by).groupBy(*by, F.expr(f"({time} - __lo) div {width}").alias("bin")).agg(F.count("*").alias("n"))
    return spine.drop("__lo").join(placed, [*by, "bin"], "left").fillna(0, ["n"])


def burstiness(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of the gaps between successive events of each key: number, mean, variation, B = (s - m) / (s + m), its form for
    finite samples (from 2 gaps), the correlation of neighbouring gaps (from 3), and the share of zero gaps. Population
    deviations."""
    w = Window.partitionBy(*by).orderBy(*order)
    gaps = df.withColumn("gap", (F.col(order[0]) - F.lag(order[0]).over(w)).cast("double")).withColumn("before", F.lag("gap").over(w)).filter("gap IS NOT NULL")
    first = F.col("before").isNotNull()
    agg = gaps.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"), F.avg((F.col("gap") == 0).cast("double")).alias("zero_share"),
        F.when(F.count("*") >= 3, F.corr(F.when(first, F.col("gap")), F.when(first, F.col("before")))).alias("memory"),
    )
    r, root = ratio(F.col("sd"), F.col("mean")), F.sqrt
    n = F.col("n").cast("double")
    finite = F.when(n >= 2, ratio(root(n + 1) * r - root(n - 1), (root(n + 1) - 2) * r + root(n - 1)))
    return agg.select(*by, "n", "mean", r.alias("cv"), ratio(F.col("sd") - F.col("mean"), F.col("sd") + F.col("mean")).alias("b"), finite.alias("b_finite"), "memory", "zero_share")


def flow_deltas(df: DataFrame, flow: list[str], order: list[str], total: str) -> DataFrame:
    """Adds `delta`, the increment of a running total in its flow: the first one keeps its total, a decrease is NULL."""
    before = F.lag(total).over(Window.partitionBy(*flow).orderBy(*order))
    diff = F.col(total) - F.coalesce(before, F.lit(0))
    return df.withColumn("delta", F.when(diff >= 0, diff))


def window_states(df: DataFrame, by: list[str], time: str, width: int, distinct: dict[str, str], sums: list[str], shares: dict[str, str]) -> DataFrame:
    """Per key and bin ((g - 1) * width, g * width]: rows, distinct values, sums that are NULL if any row's value is, and
    shares of a condition among the rows where it isn't NULL."""
    g = ceil_div(time, width)
    aggs = [F.count("*").alias("rows"), *(F.count_distinct(c).alias(n) for n, c in distinct.items())]
    aggs += [F.when(F.count(c) == F.count("*"), F.sum(c)).alias(f"sum_{c}") for c in sums]
    aggs += [F.avg(F.expr(e).cast("double")).alias(n) for n, e in shares.items()]
    return df.withColumn("g", g).groupBy(*by, "g").agg(*aggs)


def lagged_design(states: DataFrame, by: list[str], index: str, columns: list[str], lags: int) -> DataFrame:
    """Adds each column as it was 1..lags bins earlier; a bin that isn't there counts as absent (NULL)."""
    w = Window.partitionBy(*by).orderBy(index)
    out = states
    for c in columns:
        for k in range(1, lags + 1):
            # among the k rows before, the one that is exactly k bins earlier
            candidates = [F.when(F.lag(index, i).over(w) == F.col(index) - k, F.lag(c, i).over(w)) for i in range(1, k + 1)]
            out = out.withColumn(f"{c}_lag{k}", F.coalesce(*candidates))
    return out


def triggers(df: DataFrame, by: list[str], time: str, cadence: int) -> DataFrame:
    """The points of the grid k * cadence from each key's first event to its last."""
    ends = df.groupBy(*by).agg(F.min(time).alias("__a"), F.max(time).alias("__b")).select(*by, ceil_div("__a", cadence).alias("lo"), floor_div("__b", cadence).alias("hi"))
    return ends.filter("lo <= hi").select(*by, F.explode(F.sequence("lo", "hi")).alias("k")).withColumn(time, F.col("k") * cadence)


def next_position(df: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    """Adds the key of the next row in the same group, and the time until then."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({"next_key": F.lead(key).over(w), "next_dt": F.lead(order[0]).over(w) - F.col(order[0])})


def fans(df: DataFrame, source: str, target: str, time: str, width: int, least: int) -> DataFrame:
    """Episodes of one source without a gap of more than `width`, in which `least` different targets or more were met
    within a trailing closed window: first and last time, rows, and the time of the first such window. Self-touches are
    left out."""
    rows = df.filter(F.col(source) != F.col(target))
    w = Window.partitionBy(source).orderBy(time)
    new = F.coalesce(F.col(time) - F.lag(time).over(w) > width, F.lit(True)).cast("int")
    marked = rows.withColumn("__new", new).withColumn("episode", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    met = F.size(F.collect_set(target).over(Window.partitionBy(source, "episode").orderBy(time).rangeBetween(-width, 0)))
    seen = marked.withColumn("met", met)
    out = seen.groupBy(source, "episode").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"), F.max("met").alias("most"), F.min(F.when(F.col("met") >= least, F.col(time))).alias("since"))
    return out.filter("since IS NOT NULL").drop("episode")


def bounded_windows(df: DataFrame, source: str, order: list[str], entity: str, rows: int, entities: int) -> DataFrame:
    """Successive windows of each source of up to `rows` rows and `entities` different entities: a window closes before
    the row that would exceed either. Reads each source sorted, batch by batch; the state is one window's entities."""
    names = [source, *order]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, known, n, window = None, set(), 0, -1
        for frame in frames:
            numbers = []
            for s, e in zip(frame[source].tolist(), frame[entity].tolist()):
                if s != key:
                    key, known, n, window = s, set(), 0, 0
                elif n >= rows or len(known) + (e not in known) > entities:
                    known, n, window = set(), 0, window + 1
                known.add(e)
                n += 1
                numbers.append(window)
            frame["window"] = numbers
            yield frame[[*names, "window"]]

    kept = df.select(*names, entity)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(names).schema) + ", window bigint"
    return kept.repartition(source).sortWithinPartitions(*names).mapInPandas(run, schema)


def autocorrelation(series: DataFrame, by: list[str], index: str, value: str, lags: int) -> DataFrame:
    """Biased autocorrelations at 1..lags of gapless series, and Ljung and Box's Q up to that lag."""
    mean = series.groupBy(*by).agg(F.avg(value).alias("__m"), F.count("*").alias("__n"))
    dev = series.join(mean, by).withColumn("__d", F.col(value) - F.col("__m"))
    w = Window.partitionBy(*by).orderBy(index)
    products = dev.withColumns({f"p{k}": F.col("__d") * F.lag("__d", k).over(w) for k in range(1, lags + 1)})
    sums = products.groupBy(*by).agg(F.max("__n").alias("n"), F.sum(F.col("__d") ** 2).alias("c0"), *(F.coalesce(F.sum(f"p{k}"), F.lit(0.0)).alias(f"c{k}") for k in range(1, lags + 1)))
    long = sums.select(*by, "n", F.posexplode(F.array(*(ratio(F.col(f"c{k}"), F.col("c0")) for k in range(1, lags + 1)))).alias("i", "r")).withColumn("lag", F.col("i") + 1)
    upto = Window.partitionBy(*by).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    q = F.col("n") * (F.col("n") + 2.0) * F.sum(F.col("r") ** 2 / (F.col("n") - F.col("lag"))).over(upto)
    return long.withColumn("q", q).select(*by, "lag", "r", "q")


def aggregated_variance(series: DataFrame, by: list[str], index: str, value: str, blocks: list[int]) -> DataFrame:
    """Hurst exponent from the variance of block means: 1 + slope / 2 of log variance over log block size. Blocks that
    aren't full are left out; so are sizes with fewer than two blocks or no variance."""
    sized = series.withColumn("m", F.explode(F.array(*map(F.lit, blocks)))).withColumn("block", F.floor(F.col(index) / F.col("m")))
    means = sized.groupBy(*by, "m", "block").agg(F.avg(value).alias("mean"), F.count("*").alias("n")).filter("n = m")
    var = means.groupBy(*by, "m").agg(F.var_pop("mean").alias("v"), F.count("*").alias("k")).filter("k > 1 AND v > 0")
    return var.groupBy(*by).agg((1 + F.regr_slope(F.log("v"), F.log("m")) / 2).alias("hurst"), F.count("*").alias("sizes"))


def rolling(series: DataFrame, by: list[str], index: str, value: str, width: int) -> DataFrame:
    """Indicators of early warning over the last `width` values (null before they are there): variance, lag-1
    autocorrelation, skewness, Pearson kurtosis, and the slope of the trend."""
    w = Window.partitionBy(*by).orderBy(index)
    last = w.rowsBetween(1 - width, 0)
    rows = series.withColumns({"__b": F.lag(value).over(w), "__i": F.col(index).cast("double")})
    full = F.count(value).over(last) == width
    pairs = w.rowsBetween(2 - width, 0)
    a, b = F.col(value).cast("double"), F.col("__b").cast("double")
    n, sa, sb = F.lit(width - 1.0), F.sum(a).over(pairs), F.sum(b).over(pairs)
    spread = (n * F.sum(a * a).over(pairs) - sa * sa) * (n * F.sum(b * b).over(pairs) - sb * sb)
    ar1 = F.when(spread > 0, (n * F.sum(a * b).over(pairs) - sa * sb) / F.sqrt(F.abs(spread)))
    out = {
        "variance": F.var_samp(value).over(last), "ar1": ar1, "skew": F.skewness(value).over(last), "kurt": F.kurtosis(value).over(last) + 3,
        "slope": F.regr_slope(F.col(value).cast("double"), F.col("__i")).over(last),
    }
    return rows.withColumns({k: F.when(full, e) for k, e in out.items()}).select(*by, index, value, *out)


def trailing_window_entropy(df: DataFrame, by: list[str], symbol: str, time: str, cadence: int, width: int) -> DataFrame:
    """Plug-in entropy of the symbols in (t - width, t] at every point t of the cadence that has some. Each event is sent
    to the width / cadence points that see it, and counted there."""
    first, last = ceil_div(time, cadence), ceil_div(f"{time} + {width}", cadence) - 1
    seen = df.select(*by, symbol, F.explode(F.sequence(first, last)).alias("k"))
    counts = seen.groupBy(*by, "k", symbol).agg(F.count("*").cast("double").alias("c"))
    agg = counts.groupBy(*by, "k").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"))
    return agg.select(*by, "k", F.col("n").cast("bigint").alias("n"), (F.log("n") - F.col("s") / F.col("n")).alias("h"))
