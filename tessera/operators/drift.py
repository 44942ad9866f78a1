"""Drift between two sets of rows, and detectors of change along a series."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import ratio
from tessera.operators.ranks import quantiles, running_totals


def psi(df: DataFrame, value: str, current: str, by: list[str], bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability index of rows with `current` true against the others. Bins are cut at distinct inner
    quantiles of the reference; absent values are one more bin; shares are floored."""
    probs = {f"e{i}": i / bins for i in range(bins + 1)}
    q = quantiles(df.filter(~F.col(current)), value, probs, by)
    inner = F.array_sort(F.array_distinct(F.array(*probs)))
    q = q.select(*by, F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0))).alias("__inner"))
    place = F.when(F.col(value).isNull(), F.lit(-1)).otherwise(F.size(F.filter("__inner", lambda e: e <= F.col(value))))
    placed = df.join(q, by).groupBy(*by, place.alias("bin")).agg(F.sum(F.when(F.col(current), 0).otherwise(1)).alias("r"), F.sum(F.when(F.col(current), 1).otherwise(0)).alias("c"))
    whole = Window.partitionBy(*by)
    a, b = (F.greatest(F.lit(floor), F.col(k) / F.sum(k).over(whole)) for k in "rc")
    return placed.withColumn("t", (b - a) * F.log(b / a)).groupBy(*by).agg(F.sum("t").alias("psi"), F.count("*").alias("bins"))


def kolmogorov_smirnov(df: DataFrame, value: str, current: str, by: list[str]) -> DataFrame:
    """Two-sample statistic: the largest gap of the empirical distributions, and both sizes."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(F.when(F.col(current), 0).otherwise(1)).alias("r"), F.sum(F.when(F.col(current), 1).otherwise(0)).alias("c"))
    run = running_totals(counts, value, ["r", "c"], by)
    gap = F.abs(ratio(F.col("cum_r"), F.col("total_r")) - ratio(F.col("cum_c"), F.col("total_c")))
    return run.groupBy(*by).agg(F.max("total_r").alias("n_reference"), F.max("total_c").alias("n_current"), F.max(gap).alias("ks"))


def wasserstein(df: DataFrame, value: str, current: str, by: list[str]) -> DataFrame:
    """Wasserstein distance of order 1 between the two empirical distributions."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(F.when(F.col(current), 0).otherwise(1)).alias("r"), F.sum(F.when(F.col(current), 1).otherwise(0)).alias("c"))
    run = running_totals(counts, value, ["r", "c"], by)
    gap = F.abs(ratio(F.col("cum_r"), F.col("total_r")) - ratio(F.col("cum_c"), F.col("total_c")))
    # the integral of the gap by parts: each value adds gap * (next - value), which telescopes over ranges
    from tessera.operators.ranks import PART, ranged

    rows = ranged(run.withColumn("g", gap), value)
    order = Window.partitionBy(*by, PART).orderBy(value)
    inner = rows.withColumn("step", (F.lead(value).over(order) - F.col(value)) * F.col("g"))
    ends = inner.groupBy(*by, PART).agg(F.sum("step").alias("inside"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.max_by("g", value).alias("g_hi"))
    across = (F.lead("lo").over(Window.partitionBy(*by).orderBy(PART)) - F.col("hi")) * F.col("g_hi")
    return ends.withColumn("x", across).groupBy(*by).agg((F.coalesce(F.sum("inside"), F.lit(0.0)) + F.coalesce(F.sum("x"), F.lit(0.0))).alias("w1"))


def homogeneity(df: DataFrame, value: str, current: str, by: list[str], top: int = 50) -> DataFrame:
    """Chi-square of homogeneity over the `top` most frequent values and one cell of all others."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(F.when(F.col(current), 0).otherwise(1)).alias("r"), F.sum(F.when(F.col(current), 1).otherwise(0)).alias("c"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.col("r") + F.col("c")), value)))
    cells = ranked.groupBy(*by, F.when(F.col("rank") <= top, F.col(value)).alias("cell")).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    whole = Window.partitionBy(*by)
    n = F.col("r") + F.col("c")
    for k in "rc":
        cells = cells.withColumn(f"N{k}", F.sum(k).over(whole))
    expected = {k: n * F.col(f"N{k}") / (F.col("Nr") + F.col("Nc")) for k in "rc"}
    cells = cells.withColumn("t", sum((ratio((F.col(k) - expected[k]) ** 2, expected[k]) for k in "rc"), F.lit(0.0)))
    return cells.groupBy(*by).agg(F.sum("t").alias("chi2"), (F.count("*") - 1).alias("df"))


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: added up to 30, and by Euler and Maclaurin's series beyond (off by less than 1e-11), so that the
    work at a row doesn't grow with m."""
    n = m.cast("double")
    few = F.element_at(F.array(*(F.lit(math.fsum(1 / i for i in range(1, k + 1))) for k in range(1, 31))), F.greatest(F.least(m, F.lit(30)), F.lit(1)).cast("int"))
    return F.when(m <= 30, few).otherwise(F.log(n) + 0.57721566490153286 + 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4))


def fdr(df: DataFrame, p: str, family: list[str], method: str = "bh") -> DataFrame:
    """Adds `adjusted`: p-values adjusted by Benjamini and Hochberg, or Benjamini and Yekutieli ('by'), in each family of
    tests (a family is one report's tests). NULL stays NULL and isn't counted."""
    up = Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last())
    m = F.count(p).over(Window.partitionBy(*family))
    rank = F.row_number().over(up)
    raw = df.withColumns({"__m": m, "__rank": rank})
    factor = F.lit(1.0) if method == "bh" else harmonic(F.col("__m"))
    raw = raw.withColumn("__a", F.col(p) * F.col("__m") / F.col("__rank") * factor)
    down = Window.partitionBy(*family).orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("adjusted", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__a").over(down)))).drop("__m", "__rank", "__a")


def cusum(df: DataFrame, group: str, order: list[str], value: str, target: float, slack: float) -> DataFrame:
    """Two-sided CUSUM without restarts, in closed form: a running sum less its running minimum (with zero)."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    up = df.withColumns({"__u": F.sum(F.col(value) - target - slack).over(w), "__d": F.sum(target - slack - F.col(value)).over(w)})
    return up.withColumns({"up": F.col("__u") - F.least(F.lit(0.0), F.min("__u").over(w)), "down": F.col("__d") - F.least(F.lit(0.0), F.min("__d").over(w))}).drop("__u", "__d")


def _spans(x: np.ndarray, step) -> np.ndarray:
    """Alarms of a series, span by span: step(span) gives the alarms of a span up to and with the first one that restarts it, and
    nothing where it goes on. Spans grow while nothing happens."""
    out, at, size = [], 0, 256
    while at < len(x):
        found, ended = step(x[at : at + size])
        out.append(found)
        at, size = at + len(found), 256 if ended else 2 * size
    return np.concatenate(out) if out else np.zeros(0, np.int32)


class PageHinkley:
    """Two-sided test of Page and Hinkley: 1 or -1 for an alarm upwards or downwards (upwards is looked at first), else 0;
    every alarm restarts it. The mean includes the new value. Between alarms both sums and their extremes are running
    totals, so that a span of values is a few array operations."""

    def __init__(self, delta: float = 0.005, threshold: float = 50.0):
        self.delta, self.threshold, self.fresh = delta, threshold, (0, 0.0, 0.0, 0.0, 0.0, 0.0)
        self.state = self.fresh

    def scan(self, x: np.ndarray) -> np.ndarray:
        return _spans(x, self._step)

    def _step(self, x: np.ndarray) -> tuple[np.ndarray, bool]:
        n, total, up, down, low, high = self.state
        counts, totals = n + np.arange(1, len(x) + 1), total + np.cumsum(x)
        off = x - totals / counts
        ups, downs = up + np.cumsum(off - self.delta), down + np.cumsum(off + self.delta)
        lows, highs = np.minimum(low, np.minimum.accumulate(ups)), np.maximum(high, np.maximum.accumulate(downs))
        found = np.where(ups - lows > self.threshold, 1, np.where(highs - downs > self.threshold, -1, 0))
        if found.any():
            self.state = self.fresh
            return found[: int(found.astype(bool).argmax()) + 1], True
        self.state = (int(counts[-1]), totals[-1], ups[-1], downs[-1], lows[-1], highs[-1])
        return found, False


class DriftDetection:
    """Gama's drift detection on errors (0 or 1): 1 warning, 2 drift, else 0. A drift restarts the counts. The error level is the
    rate and its deviation; the least level so far, of `least` values or more, is what the present one is held against."""

    def __init__(self, least: int = 30, warning: float = 2.0, drift: float = 3.0):
        self.least, self.warning, self.drift, self.fresh = least, warning, drift, (0, 0.0, math.inf, math.inf)
        self.state = self.fresh

    def scan(self, x: np.ndarray) -> np.ndarray:
        return _spans(x, self._step)

    def _step(self, x: np.ndarray) -> tuple[np.ndarray, bool]:
        n, wrong, rate, deviation = self.state
        counts, errors = n + np.arange(1, len(x) + 1), wrong + np.cumsum(x)
        p = errors / counts
        s = np.sqrt(p * (1 - p) / counts)
        level = np.where(counts >= self.least, p + s, math.inf)
        before = np.minimum.accumulate(np.concatenate([[rate + deviation], level]))[:-1]
        best = np.maximum.accumulate(np.where(level < before, np.arange(len(x)), -1))  # where the least level was met last
        rates, deviations = np.where(best < 0, rate, p[best]), np.where(best < 0, deviation, s[best])
        full = counts >= self.least
        with np.errstate(invalid="ignore"):
            found = np.where(full & (p + s > rates + self.drift * deviations), 2, np.where(full & (p + s > rates + self.warning * deviations), 1, 0))
        if (found == 2).any():
            self.state = self.fresh
            return found[: int((found == 2).argmax()) + 1], True
        self.state = (int(counts[-1]), errors[-1], rates[-1], deviations[-1])
        return found, False


class Adwin:
    """Bifet and Gavalda's adaptive window: 1 where the window was cut. Old values are kept as sums over blocks whose
    sizes double, at most `buckets` of each size, so that memory grows with the logarithm of the window."""

    def __init__(self, delta: float = 0.002, buckets: int = 5):
        self.delta, self.buckets = delta, buckets
        self.blocks: list[tuple[int, float, float]] = []  # size, sum, sum of squares about the mean; newest last
        self.of_size: list[int] = []  # blocks of size 1, 2, 4, ...

    @staticmethod
    def _join(a, b):
        (n, s, v), (m, t, w) = a, b
        return n + m, s + t, v + w + (s / n - t / m) ** 2 * n * m / (n + m)

    def scan(self, x: np.ndarray) -> np.ndarray:
        out, at, size = np.zeros(len(x), np.int32), 0, 32
        while at < len(x):
            span, size = x[at : at + size], min(2 * size, 256)
            for v, near in zip(span.tolist(), self._near(span).tolist()):
                self._put(v)
                at += 1
                if near and self._cut():
                    out[at - 1], size = 1, 32
                    break
        return out

    def update(self, x: float) -> int:
        self._put(x)
        return self._cut()

    def _put(self, x: float) -> None:
        self.blocks.append((1, float(x), 0.0))
        level, younger = 0, 0
        while True:
            if level == len(self.of_size):
                self.of_size.append(0)
            self.of_size[level] += 1
            if self.of_size[level] <= self.buckets:
                return
            i = len(self.blocks) - younger - self.of_size[level]
            self.blocks[i : i + 2] = [self._join(self.blocks[i], self.blocks[i + 1])]
            self.of_size[level] -= 2
            younger, level = younger + self.of_size[level], level + 1

    def _cut(self) -> int:
        cut = 0
        while len(self.blocks) > 1 and self._differs():
            self.blocks.pop(0)
            self.of_size[-1] -= 1
            while self.of_size and not self.of_size[-1]:
                self.of_size.pop()
            cut = 1
        return cut

    def _near(self, x: np.ndarray) -> np.ndarray:
        """Where the window may differ once the next values, up to and with this one, have come and nothing was cut: the bound less what
        rounding may take, at every end of a block that there is now and at each of the next values. Blocks are only joined until
        then, so that no other end comes up."""
        size, part, within = np.array([(0, 0.0, 0.0), *self.blocks]).T
        n0, total, middle = size.sum(), part.sum(), part.sum() / max(size.sum(), 1)
        off = x - middle
        n, d = n0 + np.arange(1, len(x) + 1), total - n0 * middle + np.cumsum(off)
        squares = within.sum() + (size * (part / np.maximum(size, 1) - middle) ** 2).sum() + np.cumsum(off * off)
        spread, log = np.maximum(squares / n - (d / n) ** 2, 0)[:, None], np.log(2 * np.log(np.maximum(n, 2)) / self.delta)[:, None]
        m, s = np.concatenate([size.cumsum()[1:], n[:-1]]), np.concatenate([(part - size * middle).cumsum()[1:], d[:-1]])
        rest = n[:, None] - m
        use = (m >= 5) & (rest >= 5)
        rest[~use] = 1
        inverse = 1 / m + 1 / rest
        bound = np.sqrt(2 * spread * log * inverse) + (2 / 3 * log) * inverse
        apart = np.abs(s / m - (d[:, None] - s) / rest)
        return (use & ~(apart < bound * (1 - 1e-6) - 1e-9 * abs(middle))).any(axis=1)

    def _differs(self) -> bool:
        whole = functools.reduce(self._join, self.blocks)
        n, total = whole[0], whole[1]
        spread, log = whole[2] / n, math.log(2 * math.log(max(n, 2)) / self.delta)
        m = s = 0
        for size, part, _ in self.blocks[:-1]:
            m, s = m + size, s + part
            if m < 5 or n - m < 5:
                continue
            inverse = 1 / m + 1 / (n - m)
            if abs(s / m - (total - s) / (n - m)) > math.sqrt(2 * inverse * spread * log) + 2 / 3 * inverse * log:
                return True
        return False


def alarms(df: DataFrame, group: str, order: list[str], value: str, detector) -> DataFrame:
    """The rows of each series at which a sequential detector fires: group, the order columns, alarm. A series is sorted
    by Spark and read batch by batch, with the detector's state in between, so that memory doesn't grow with it."""
    kept = df.filter(F.col(value).isNotNull()).select(group, *order, F.col(value).cast("double").alias("__x"))
    columns = [group, *order]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for frame in frames:
            names, alarm, values = frame[group].tolist(), [], frame["__x"].to_numpy()
            starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in itertools.pairwise(starts):
                if state is None or names[a] != key:
                    key, state = names[a], detector()
                alarm.append(state.scan(values[a:b]))
            frame["alarm"] = np.concatenate(alarm).astype("int32")
            yield frame.loc[frame["alarm"] != 0, [*columns, "alarm"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(columns).schema) + ", alarm int"
    return kept.repartition(group).sortWithinPartitions(*columns).mapInPandas(run, schema)
