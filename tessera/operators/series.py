"""Time series: fluctuation analysis, unit roots, uneven periodograms, and change points. A series is (by, index 0, 1, ... , value)."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import joined, ratio
from tessera.operators.ranks import quantiles, running_totals
from tessera.sources.stored import stored

#: Rows of a series that one task takes at a time.
BLOCK = 1 << 16


def indexed(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows with a value, numbered from 0 in each series (one sort of a series by its order)."""
    i = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.filter(F.col(value).isNotNull()).select(*by, i.cast("bigint").alias("i"), F.col(value).cast("double").alias("v"))


def with_lags(series: DataFrame, by: list[str], lags: int, block: int = BLOCK) -> DataFrame:
    """Adds v1 .. v<lags>, the values before (NULL where there is none). A series is cut into blocks, each with the last rows of the
    block before it, so that no task gets a whole series."""
    near = F.when(F.pmod(F.col("i"), F.lit(block)) >= block - lags, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = series.withColumn("__late", F.explode(near)).withColumn("__block", F.floor(F.col("i") / block) + F.col("__late"))
    w = Window.partitionBy(*by, "__block").orderBy("i")
    return rows.withColumns({f"v{k}": F.lag("v", k).over(w) for k in range(1, lags + 1)}).filter("__late = 0").drop("__late", "__block")


def dfa(series: DataFrame, by: list[str], least: int = 8, share: float = 0.25, scales: int = 24) -> tuple[DataFrame, DataFrame]:
    """Detrended fluctuations: (by, scale, fluctuation), and alpha, its standard error and the number of scales of each series.

    The integrated series is a running total over ranges of the index. Boxes of every scale, from the start and from the end, are
    one aggregation of moments: what a line leaves of a box follows from them, so that no series or box is in a task. Series too
    short for a box of `least` have no rows."""
    m = series.groupBy(*by).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    low, high = float(max(least, 3)), F.floor(F.col("n") * share)
    steps = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(scales - 1)), lambda k: F.bround(low * F.pow(high / low, k / (scales - 1))).cast("bigint")))
    m = stored(m.filter(high >= low).withColumn("scales", steps), "dfa")
    run = joined(running_totals(series, "i", ["v"], by), m, by).withColumn("y", F.col("cum_v") - (F.col("i") + 1) * F.col("mean"))
    sides = F.posexplode(F.array(F.col("i"), F.col("n") - 1 - F.col("i"))).alias("side", "at")
    boxes = run.select(*by, "n", "i", "y", F.explode("scales").alias("scale")).select(*by, "n", "y", "scale", sides)
    boxes = boxes.withColumn("box", F.expr("at div scale")).filter("box < n div scale").withColumn("t", F.pmod(F.col("at"), F.col("scale")).cast("double"))
    left = F.regr_syy("y", "t") - F.regr_sxy("y", "t") ** 2 / F.regr_sxx("y", "t")
    rss = boxes.groupBy(*by, "scale", "side", "box").agg(left.alias("rss"))
    f = stored(rss.groupBy(*by, "scale").agg(F.sqrt(F.greatest(F.avg("rss") / F.col("scale"), F.lit(0.0))).alias("fluctuation")), "dfa-scales")
    x, y = F.log("scale"), F.log("fluctuation")
    fit = f.filter("fluctuation > 0").groupBy(*by).agg(F.regr_slope(y, x).alias("alpha"), F.regr_syy(y, x).alias("yy"), F.regr_sxy(y, x).alias("xy"), F.regr_sxx(y, x).alias("xx"), F.count("*").alias("m"))
    error = F.when(F.col("m") > 2, F.sqrt(F.greatest(F.col("yy") - F.col("xy") ** 2 / F.col("xx"), F.lit(0.0)) / (F.col("m") - 2) / F.col("xx")))
    return f, fit.select(*by, "alpha", error.alias("error"), F.col("m").alias("scales"))


# MacKinnon's response surfaces of the p-value (1994) without a trend, with a constant, and with constant and
# trend: the ends of its range, where its two polynomials meet, and their coefficients; and the 5 % critical value (2010).
SURFACES = {
    "n": (-19.04, math.inf, -1.04, (0.6344, 1.2378, 3.2496e-2), (0.4797, 9.3557e-1, -0.6999e-1, 3.3066e-2), (-1.94100, -0.2686, -3.365, 31.223)),
    "c": (-18.83, 2.74, -1.61, (2.1659, 1.4412, 3.8269e-2), (1.7339, 9.3202e-1, -1.2745e-1, -1.0368e-2), (-2.86154, -2.8903, -4.234, -40.040)),
    "ct": (-16.18, 0.7, -2.89, (3.2512, 1.6047, 4.9588e-2), (2.5261, 6.1654e-1, -3.7956e-1, -6.0285e-2), (-3.41049, -4.3904, -9.036, -45.374)),
}


def mackinnon(tau: float, trend: str) -> float:
    low, high, meet, small, large, _ = SURFACES[trend]
    if tau > high or tau < low:
        return float(tau > high)
    return NormalDist().cdf(sum(c * tau**k for k, c in enumerate(small if tau <= meet else large)))


def adf(series: DataFrame, by: list[str], trend: str = "c", criterion: str = "aic", lags: int | None = None) -> DataFrame:
    """Augmented Dickey and Fuller's test of each series: tau, p, the lags (chosen by AIC or BIC up to `lags`, or 12 (n / 100)^(1/4)
    of the longest series), the rows of the regression and the 5 % critical value. NULL where a series is too short or constant.

    The lagged design is made block by block inside tasks, some thousand rows of it at a time, and multiplied with itself there. A
    block gives the sums of the rows that every order has, and the few rows before as they are. All orders are solved from these."""
    counts = series.groupBy(*by).agg(F.count("*").alias("n"))
    if lags is None:
        lags = int(12 * ((counts.agg(F.max("n")).first()[0] or 1) / 100) ** 0.25)
    fixed = {"n": 0, "c": 1, "ct": 2}[trend]
    limit = F.greatest(F.least(F.floor(12 * F.pow(F.col("n") / 100, 0.25)), F.expr(f"(n - 1) div 2 - {fixed + 2}"), F.lit(lags)), F.lit(0)).cast("int")
    width, block = 2 + fixed + lags, max(BLOCK, lags + 2)
    at = F.expr(f"i div {block}")
    near = F.when(F.pmod(F.col("i"), F.lit(block)) >= block - lags - 2, F.array(at, at + 1)).otherwise(F.array(at))
    rows = joined(series, counts.withColumn("most", limit), by).select(*by, "n", "most", "i", F.col("v").cast("double").alias("v"), F.explode(near).alias("__block"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.select(*by).schema)

    def design(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        v, i, (n, most, b) = table.column("v").to_numpy(), table.column("i").to_numpy(), (table.column(c)[0].as_py() for c in ("n", "most", "__block"))
        steps = np.concatenate([np.zeros(lags + 1), np.diff(v)])  # steps[j + lags] is the last one of row j
        back = np.lib.stride_tricks.sliding_window_view(steps, lags + 1)[:, ::-1]
        own = np.flatnonzero((i >= b * block) & (i > 0))
        out, gram, size = [], np.zeros((width, width)), 0
        for use in np.array_split(own, -(-len(own) // 4096) or 1):
            x = np.column_stack([back[use, 0], v[use - 1], *([np.ones(len(use))] * (fixed > 0)), *([i[use] / n] * (fixed > 1)), back[use, 1:]])
            late = i[use] > most
            out += [(int(j) - 1, 1, r.tobytes()) for j, r in zip(i[use][~late], x[~late])]
            gram, size = gram + x[late].T @ x[late], size + int(late.sum())
        if size:
            out.append((most, size, gram.tobytes()))
        key = {c: pa.chunked_array([table.column(c).combine_chunks().take(pa.array([0] * len(out), pa.int64()))]) for c in by}
        ats, sizes, sums = zip(*out) if out else ((), (), ())
        return pa.table({**key, "n": pa.array([n] * len(out), pa.int64()), "most": pa.array([most] * len(out), pa.int32()), "at": pa.array(ats, pa.int32()), "rows": pa.array(sizes, pa.int64()), "sums": pa.array(sums, pa.binary())})

    named = f"{kinds}, " if by else ""
    sums = rows.groupBy(*by, "__block").applyInArrow(design, f"{named}n long, most int, at int, rows long, sums binary")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        most, at, size = int(frame["most"].iloc[0]), frame["at"].to_numpy(), frame["rows"].to_numpy()
        held = [np.frombuffer(x) for x in frame["sums"]]
        whole = sum((x.reshape(width, width) for x, k in zip(held, at) if k == most), np.zeros((width, width)))
        early = np.array([x for x, k in zip(held, at) if k < most]).reshape(-1, width)

        def fit(p: int, start: int):
            """Rest of the sum of squares, rows, tau of an order from the rows that have `start` differences before them."""
            use, keep = at >= start, [1, *range(2, 2 + fixed), *range(2 + fixed, 2 + fixed + p)]
            first = early[at[at < most] >= start]
            g, n = whole + first.T @ first, int(size[use].sum())
            scale = np.sqrt(np.diag(g)[keep])
            if n <= len(keep) or (scale == 0).any():
                return None
            inner = g[np.ix_(keep, keep)] / np.outer(scale, scale)
            inverse = np.linalg.pinv(inner, rcond=1e-13)
            beta = inverse @ (g[keep, 0] / scale)
            rest = g[0, 0] - 2 * beta @ (g[keep, 0] / scale) + beta @ inner @ beta
            error = math.sqrt(max(inverse[0, 0] * rest / (n - len(keep)), 0.0))
            return rest, n, (beta[0] / error if error > 0 else None), len(keep)

        out = {b: frame[b].iloc[0] for b in by} | {"tau": None, "p": None, "lags": None, "rows": None, "critical": None}
        total = int(frame["n"].iloc[0])
        if total - 1 - most >= fixed + most + 3:
            found = {p: fit(p, most) for p in range(most + 1)}
            cost = {p: f[1] * math.log(f[0] / f[1]) + f[3] * (2 if criterion == "aic" else math.log(f[1])) for p, f in found.items() if f and f[0] > 0}
            if cost:
                p = min(cost, key=lambda q: (cost[q], q))
                last = fit(p, p)
                if last and last[2] is not None:
                    n = last[1]
                    out |= {"tau": last[2], "p": mackinnon(last[2], trend), "lags": p, "rows": n, "critical": sum(c / n**k for k, c in enumerate(SURFACES[trend][5]))}
        return pd.DataFrame([out]).astype({"tau": "Float64", "p": "Float64", "lags": "Int64", "rows": "Int64", "critical": "Float64"})

    return sums.groupBy(*by).applyInPandas(solve, f"{named}tau double, p double, lags long, rows long, critical double")


def lomb_scargle(df: DataFrame, by: list[str], time: str, value: str, frequencies: list[float]) -> DataFrame:
    """Normalised power of unevenly sampled series at frequencies (cycles per unit of time); NULL below 3 rows and for a
    constant series. Sums of sines and cosines for every frequency are one aggregation, summed up before the shuffle; the phase
    that makes them orthogonal is solved afterwards from the same sums."""
    rows = df.filter(F.col(time).isNotNull() & F.col(value).isNotNull())
    m = rows.groupBy(*by).agg(F.min(time).alias("__t0"), F.avg(value).alias("__m"), F.var_samp(value).alias("__s2"), F.count("*").alias("n")).filter("n >= 3")
    x = joined(rows, m, by).select(*by, "n", "__s2", (F.col(time) - F.col("__t0")).cast("double").alias("t"), (F.col(value) - F.col("__m")).alias("y"), F.explode(F.array(*map(F.lit, map(float, frequencies)))).alias("frequency"))
    w = F.col("t") * F.col("frequency") * (2 * math.pi)
    s = x.withColumns({"c": F.cos(w), "s": F.sin(w)}).groupBy(*by, "n", "__s2", "frequency")
    s = s.agg(F.sum(F.col("y") * F.col("c")).alias("yc"), F.sum(F.col("y") * F.col("s")).alias("ys"), F.sum(F.col("c") ** 2).alias("cc"), F.sum(F.col("c") * F.col("s")).alias("cs"), F.sum(F.col("s") ** 2).alias("ss"))
    a = F.atan2(2 * F.col("cs"), F.col("cc") - F.col("ss")) / 2
    u, v = F.cos(a), F.sin(a)
    cos2 = F.col("cc") * u * u + 2 * F.col("cs") * u * v + F.col("ss") * v * v
    sin2 = F.col("ss") * u * u - 2 * F.col("cs") * u * v + F.col("cc") * v * v
    part = lambda top, base: F.when(base > 1e-12, top * top / base).otherwise(0.0)
    power = part(F.col("yc") * u + F.col("ys") * v, cos2) + part(F.col("ys") * u - F.col("yc") * v, sin2)
    return s.select(*by, "frequency", ratio(power, 2 * F.col("__s2")).alias("power"))


def false_alarm(powers: DataFrame, by: list[str], trials: int) -> DataFrame:
    """The highest power of each series, its frequency, and how likely noise has one as high among `trials` frequencies."""
    best = powers.groupBy(*by).agg(F.max(F.struct("power", (-F.col("frequency")).alias("f"))).alias("b"))
    return best.select(*by, (-F.col("b.f")).alias("frequency"), F.col("b.power").alias("power"), (-F.expm1(F.lit(float(trials)) * F.log1p(-F.exp(-F.col("b.power"))))).alias("chance"))


class Segments:
    """Optimal segmentation, value by value: the cheapest way to cut what has come so far, with the place of its last cut.

    A candidate for the last cut is the sums before it and the cost up to it. Once another way to here is as cheap without what
    may come, a candidate can go, but only after the shortest segment has passed, as until then no cut may be here."""

    FEW = 16

    def __init__(self, cost: str, penalty: float, least: int, spread: float):
        self.cost, self.penalty, self.least, self.spread = cost, penalty, least, spread
        self.t, self.s1, self.s2 = 0, 0.0, 0.0
        self.young = deque([(0, -penalty, 0.0, 0.0)])
        self.room, self.n, self.due = np.zeros((5, 64)), 0, math.inf  # place, cost, sums before it, when it goes; how many, and when the next one goes
        self.few: list[list[float]] | None = [] if cost == "poisson" else None  # the same as lists, while there are so few that arrays cost more

    def _costs(self, n, s1, s2):
        if self.cost == "mean":
            return (s2 - s1 * s1 / n) / self.spread
        if self.cost == "meanvar":
            return n * (np.log(2 * np.pi * np.maximum((s2 - s1 * s1 / n) / n, self.spread)) + 1)
        some = s1 > 0
        log = np.log(np.where(some, s1 / n, 1.0))
        return 2 * (s1 - s1 * log) if self.cost == "poisson" else 2 * n * (np.where(some, log, -np.inf) + 1)

    def add(self, x: float) -> tuple[int, float] | None:
        """The last cut and the cost of all up to and with x; None while no segment is long enough."""
        self.t, self.s1, self.s2 = self.t + 1, self.s1 + x, self.s2 + x * x
        if self.few is not None:
            if len(self.few) <= self.FEW and math.isfinite(self.s1):
                return self._add_to_few()
            self.n, self.due = len(self.few), min((c[4] for c in self.few), default=math.inf)
            self.room[:, : self.n], self.few = np.array(self.few).reshape(-1, 5).T, None
        while self.young and self.t - self.young[0][0] >= self.least:
            if self.n == self.room.shape[1]:
                self.room = np.hstack([self.room, np.zeros_like(self.room)])
            self.room[:, self.n] = (*self.young.popleft(), math.inf)
            self.n += 1
        if self.due <= self.t:
            left = self.room[:, : self.n].compress(self.room[4, : self.n] > self.t, axis=1)
            self.n = left.shape[1]
            self.room[:, : self.n] = left
            self.due = float(left[4].min()) if self.n else math.inf
        if not self.n:
            return None
        place, before, a, b, goes = self.room[:, : self.n]
        ways = before + self._costs(self.t - place, self.s1 - a, self.s2 - b)
        i = int(ways.argmin())
        best = float(ways[i]) + self.penalty
        lost = ways > best
        if lost.any():
            np.minimum(goes, self.t + self.least, out=goes, where=lost)
            self.due = min(self.due, self.t + self.least)
        self.young.append((self.t, best, self.s1, self.s2))
        cut = int(place[i])
        if self.cost == "poisson" and 2 * self.n <= self.FEW and math.isfinite(self.s1):
            self.few = self.room[:, : self.n].T.tolist()
        return cut, best

    def _add_to_few(self) -> tuple[int, float] | None:
        t, s1 = self.t, self.s1
        while self.young and t - self.young[0][0] >= self.least:
            self.few.append([*self.young.popleft(), math.inf])
        self.few = [c for c in self.few if c[4] > t]
        if not self.few:
            return None
        ways = []
        for place, before, a, _, _ in self.few:
            own = s1 - a
            ways.append(before + 2 * (own - own * (math.log(own / (t - place)) if own > 0 else 0.0)))
        least = min(ways)
        best, cut = least + self.penalty, self.few[ways.index(least)][0]
        for c, way in zip(self.few, ways):
            if way > best and c[4] == math.inf:
                c[4] = t + self.least
        self.young.append((t, best, s1, self.s2))
        return int(cut), best


def _spread(series: DataFrame, by: list[str], cost: str) -> DataFrame:
    """What a cost needs of the whole series: for means the variance by the median deviation of differences, for variances a floor."""
    if cost != "mean":
        return series.groupBy(*by).agg(F.count("*").alias("n"), (F.coalesce(F.var_pop("v"), F.lit(0.0)) * 1e-12).alias("spread"))
    d = with_lags(series, by, 1).filter("v1 IS NOT NULL").withColumn("d", F.col("v") - F.col("v1"))
    off = joined(d, quantiles(d, "d", {"m": 0.5}, by), by).withColumn("o", F.abs(F.col("d") - F.col("m")))
    mad = quantiles(off, "o", {"o": 0.5}, by)
    return joined(series.groupBy(*by).agg(F.count("*").alias("n")), mad, by, "left").select(*by, "n", ((F.col("o") / NormalDist().inv_cdf(0.75)) ** 2 / 2).alias("spread"))


def pelt(series: DataFrame, by: list[str], cost: str = "meanvar", penalty: float | None = None, least: int | None = None) -> DataFrame:
    """Where each series is cut so that costs of segments plus `penalty` for each are least: (by, start, stop, cost of the whole).
    Costs: mean, meanvar, poisson, exponential; the penalty is (parameters + 1) log n unless it's given. Series shorter than two
    segments have one.

    Each series is read sorted, batch by batch; what is held are the candidates that may still be the last cut. The cuts back
    from the end are found by joins that double their reach, so that nothing of the length of a series is in memory."""
    least = least or (3 if cost == "meanvar" else 2)
    base = stored(joined(series, _spread(series, by, cost), by), "segments")
    beta = F.lit(float(penalty)) if penalty is not None else F.log(F.col("n").cast("double")) * (3 if cost == "meanvar" else 2)
    kept = base.select(*by, "i", "v", F.greatest(F.col("spread"), F.lit(1e-300)).alias("spread"), beta.alias("beta"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.select(*by).schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for frame in frames:
            last, costs = [], []
            for *own, i, v, spread, beta in frame[[*by, "i", "v", "spread", "beta"]].itertuples(index=False, name=None):
                if i == 0 or own != key:
                    key, state = own, Segments(cost, beta, least, spread)
                found = state.add(v)
                last.append(found[0] if found else -1)
                costs.append(found[1] if found else math.nan)
            yield frame[by].assign(stop=frame["i"] + 1, start=last, cost=costs)

    back = kept.repartition(*by).sortWithinPartitions(*by, "i").mapInPandas(run, f"{kinds}, stop long, start long, cost double")
    back = stored(back, "segments-back")
    g = F.struct(*by)
    jump = back.filter("start > 0").select(g.alias("g"), F.col("stop").alias("at"), F.col("start").alias("to"))
    ends = base.groupBy(*by).agg(F.max("n").alias("stop")).select(g.alias("g"), F.col("stop").alias("at"))
    found = stored(ends, "segments-cuts")
    while True:
        more = found.join(jump, ["g", "at"]).select("g", F.col("to").alias("at"))
        grown = stored(found.union(more).distinct(), "segments-cuts")
        if grown.count() == found.count():
            break
        found = grown
        jump = stored(jump.join(jump.select("g", F.col("at").alias("to"), F.col("to").alias("__to")), ["g", "to"]).select("g", "at", F.col("__to").alias("to")), "segments-jump")
    total = back.select(g.alias("g"), F.col("stop").alias("at"), "cost", F.greatest("start", F.lit(0)).alias("start"))
    whole = ends.join(total, ["g", "at"]).select("g", F.col("cost").alias("whole"))
    out = found.join(total, ["g", "at"]).join(whole, "g")
    return out.select(*(F.col(f"g.{c}").alias(c) for c in by), "start", F.col("at").alias("stop"), F.when(~F.isnan("whole"), F.col("whole")).alias("cost"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: shifted up by ten, then Stirling's series."""
    shift = np.zeros_like(x)
    z = x.astype(float)
    for _ in range(10):
        shift += np.log(z)
        z = z + 1
    i = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i / 1680))) / z - shift


class RunLengths:
    """How long ago the last change was, as probabilities of each run length, value by value. What a run has seen is kept as its number,
    mean and squares (normal) or number and sum (poisson) by run length."""

    def __init__(self, model: str, hazard: float, middle: float, spread: float, drop: float, most: int | None):
        self.model, self.hazard, self.drop, self.most = model, hazard, drop, most
        self.prior = (middle, 1.0, 1.0, max(spread**2, 1e-12)) if model == "normal" else (max(middle, 0.5), 1.0)
        self.seen = np.array([self.prior]).T
        self.log = np.zeros(1)
        self.known = np.zeros((2, 0))

    def _shape_terms(self) -> np.ndarray:
        """The terms of the normal density that the run length alone decides: worked out once for each, and kept."""
        n = len(self.log)
        if n > self.known.shape[1]:
            shape = self.prior[2] + 0.5 * np.arange(max(64, 2 * n))
            self.known = np.array([log_gamma(shape + 0.5) - log_gamma(shape), shape + 0.5])
        return self.known[:, :n]

    def _density(self, x: float) -> np.ndarray:
        if self.model == "poisson":
            a, b = self.seen
            return log_gamma(x + a) - log_gamma(a) - math.lgamma(x + 1) + a * np.log(b / (b + 1)) - x * np.log(b + 1)
        mean, k, _, rate = self.seen
        wide = 2 * rate * (k + 1) / k  # degrees of freedom times the squared scale
        gamma, power = self._shape_terms()
        return gamma - 0.5 * np.log(np.pi * wide) - power * np.log1p((x - mean) ** 2 / wide)

    def add(self, x: float) -> tuple[float, int, float]:
        """The chance of a change right after x, the likeliest and the mean run length."""
        joint = self.log + self._density(x)
        top = joint.max()
        chance = np.exp(joint - top)
        chance = np.concatenate([[self.hazard * chance.sum()], (1 - self.hazard) * chance])
        chance /= chance.sum()
        if self.model == "poisson":
            a, b = self.seen
            grown = np.array([a + x, b + 1])
        else:
            mean, k, shape, rate = self.seen
            grown = np.array([mean + (x - mean) / (k + 1), k + 1, shape + 0.5, rate + k * (x - mean) ** 2 / (2 * (k + 1))])
        self.seen = np.column_stack([self.prior, grown])
        keep = len(chance) if self.most is None else min(len(chance), self.most)
        if self.drop:
            keep = max(1, min(keep, int((chance[::-1].cumsum()[::-1] >= self.drop).sum())))
        if keep < len(chance):
            chance, self.seen = chance[:keep] / chance[:keep].sum(), self.seen[:, :keep]
        with np.errstate(divide="ignore"):
            self.log = np.log(chance)
        return float(chance[0]), int(chance.argmax()), float(np.arange(len(chance)) @ chance)


def bocpd(series: DataFrame, by: list[str], model: str = "normal", hazard: float = 1 / 250, drop: float = 0.0, most: int | None = None) -> DataFrame:
    """At each value: the chance of a change right after it, the likeliest and the mean run length, and `changed`, the index at which
    a run began that has just become the likeliest (NULL elsewhere). Models: normal, poisson (whole numbers).

    Exact unless `drop` (the mass of long runs that is left out) or `most` (run lengths) say otherwise: without them the state
    grows with the series, as every run length stays possible. Priors are the median and the median deviation of the series."""
    middle = quantiles(series, "v", {"middle": 0.5}, by)
    off = joined(series, middle, by).withColumn("o", F.abs(F.col("v") - F.col("middle")))
    priors = joined(middle, quantiles(off, "o", {"o": 0.5}, by), by).withColumn("spread", F.col("o") / NormalDist().inv_cdf(0.75)).drop("o")
    kept = joined(series, priors, by).select(*by, "i", "v", "middle", "spread")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.select(*by).schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, before = None, None, 0
        for frame in frames:
            out = []
            for *own, i, v, mid, spread in frame[[*by, "i", "v", "middle", "spread"]].itertuples(index=False, name=None):
                if i == 0 or own != key:
                    key, state, before = own, RunLengths(model, hazard, mid, spread, drop, most), 0
                chance, likeliest, mean = state.add(v)
                out.append((chance, likeliest, mean, i - likeliest + 1 if i and likeliest < before and i - likeliest + 1 > 0 else None))
                before = likeliest
            found = pd.DataFrame(out, columns=["chance", "run", "mean_run", "changed"]).astype({"changed": "Int64"})
            yield pd.concat([frame[[*by, "i"]].reset_index(drop=True), found], axis=1)

    return kept.repartition(*by).sortWithinPartitions(*by, "i").mapInPandas(run, f"{kinds}, i long, chance double, run long, mean_run double, changed long")
