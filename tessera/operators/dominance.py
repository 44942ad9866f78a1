"""Pairs by two orders at once, n log n and without making a pair: how often, and with what weights, one row is before another
in x and below, level with or above it in y.

Rows are counted by (x, y) and cut into ranges of x. Pairs inside a range are counted in one task; pairs of different ranges meet
at one level of a merge tree over the ranges, where the left half's weights are summed up along y for the right half.
Both halves of a level are ranges of y again (`running_totals`), so that no task gets a level or a group."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import ratio
from tessera.operators.ranks import running_totals
from tessera.sources.stored import stored


def _cut(rows: DataFrame, x: str, parts: int) -> tuple[DataFrame, list[int], int]:
    """rows with __range, the ranges that hold one value only, and the number of ranges. A value at which several quantiles
    fall gets a range of its own: equal x make no pairs, so that such a range needs no task of its own either."""
    points = rows.agg(F.percentile_approx(F.col(x).cast("double"), [i / parts for i in range(1, parts)] or [0.5], 20 * parts)).first()[0] or []
    cuts: list[float] = []
    for p in points:
        if cuts and p == cuts[-1]:
            cuts.append(math.nextafter(p, math.inf))
        elif not cuts or p > cuts[-1]:
            cuts.append(p)
    cuts = [c for c in cuts if math.isfinite(c)]
    if not cuts:
        return rows.withColumn("__range", F.lit(0)), [], 1
    single = [i + 1 for i in range(len(cuts) - 1) if cuts[i + 1] == math.nextafter(cuts[i], math.inf)]
    cut = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__at", outputCol="__cut")
    out = cut.transform(rows.withColumn("__at", F.col(x).cast("double"))).withColumn("__range", F.col("__cut").cast("int")).drop("__at", "__cut")
    return out, single, len(cuts) + 1


def _within(x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each pair of columns the sums of left[i] * right[j] over x[i] < x[j]: y[i] < y[j], y[i] = y[j], and all. Two ranks
    of x meet at the highest bit in which they differ."""
    rank = np.unique(x, return_inverse=True)[1]
    level = np.unique(y, return_inverse=True)[1]
    out = np.zeros((3, left.shape[1]))
    for b in range(int(rank.max()).bit_length() if len(rank) else 0):
        block = rank >> (b + 1)
        order = np.lexsort((level, block))
        lower = (rank[order] >> b & 1 == 0)[:, None]
        put, ask = np.where(lower, left[order], 0), np.where(lower, 0, right[order])
        total = np.vstack([np.zeros(left.shape[1]), np.cumsum(put, axis=0)])
        g, v = block[order], level[order]
        new = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        first = np.repeat(new, np.diff(np.r_[new, len(g)]))
        last = np.repeat(np.r_[new[1:], len(g)], np.diff(np.r_[new, len(g)]))
        run = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
        low = np.repeat(run, np.diff(np.r_[run, len(g)]))
        high = np.repeat(np.r_[run[1:], len(g)], np.diff(np.r_[run, len(g)]))
        out += np.stack([(ask * (total[low] - total[first])).sum(0), (ask * (total[high] - total[low])).sum(0), (ask * (total[last] - total[first])).sum(0)])
    return out


def dominance(df: DataFrame, by: list[str], x: str, y: str, pairs: dict[str, tuple[Column, Column]], parts: int | None = None) -> DataFrame:
    """For each group and each name in `pairs` (a weight of the row with the smaller x, one of the row with the larger):
    <name>_less, <name>_tie and <name>_all, the sums of the products of weights over all pairs with x < x', where also y < y', where
    y = y', and whatever y is. Rows without x or y make no pairs; every group has a row, null keys are groups too."""
    spark = df.sparkSession
    parts = parts or min(1000, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    names = list(pairs)
    sums = [*(F.sum(a).cast("double").alias(f"__l{i}") for i, (a, _) in enumerate(pairs.values())), *(F.sum(b).cast("double").alias(f"__r{i}") for i, (_, b) in enumerate(pairs.values()))]
    left, right = [f"__l{i}" for i in range(len(names))], [f"__r{i}" for i in range(len(names))]
    keyed = df.withColumn("__g", F.struct(*by) if by else F.struct(F.lit(0).alias("one")))
    counted = stored(keyed.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy("__g", F.col(x).alias("__x"), F.col(y).alias("__y")).agg(*sums), "dominance")
    rows, single, ranges = _cut(counted, "__x", parts)
    kinds = ("less", "tie", "all")
    out = [f"{k}{i}" for k in kinds for i in range(len(names))]
    group = counted.schema["__g"].dataType.simpleString()

    def inside(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy()
        found = _within(column("__x"), column("__y"), np.stack([column(c) for c in left], 1), np.stack([column(c) for c in right], 1))
        return pa.table({"__g": table.column("__g").slice(0, 1), **{c: [float(v)] for c, v in zip(out, found.reshape(-1))}})

    near = rows.filter(~F.col("__range").isin(single)) if single else rows
    near = near.groupBy("__g", "__range").applyInArrow(inside, f"__g {group}, " + ", ".join(f"{c} double" for c in out))
    levels = max(1, (ranges - 1).bit_length())
    each = rows.groupBy("__g", "__range", "__y").agg(*(F.sum(c).alias(c) for c in (*left, *right)))
    each = each.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    upper = F.expr("shiftright(__range, __b) & 1") == 1
    met = each.groupBy("__g", "__b", F.expr("shiftright(__range, __b + 1)").alias("__block"), "__y")
    met = met.agg(*(F.sum(F.when(~upper, F.col(c)).otherwise(0.0)).alias(c) for c in left), *(F.sum(F.when(upper, F.col(c)).otherwise(0.0)).alias(c) for c in right))
    run = running_totals(stored(met, "dominance-levels"), "__y", left, ["__g", "__b", "__block"])
    far = []
    for i in range(len(names)):
        own, upto, total, ask = F.col(f"__l{i}"), F.col(f"cum___l{i}"), F.col(f"total___l{i}"), F.col(f"__r{i}")
        far += [F.sum(ask * (upto - own)).alias(f"less{i}"), F.sum(ask * own).alias(f"tie{i}"), F.sum(ask * total).alias(f"all{i}")]
    far = run.groupBy("__g").agg(*far).select("__g", *out)
    every = keyed.select("__g").distinct().select("__g", *(F.lit(0.0).alias(c) for c in out))
    whole = near.select("__g", *out).union(far).union(every).groupBy("__g").agg(*(F.sum(c).alias(c) for c in out))
    return whole.select(*(F.col(f"__g.{c}").alias(c) for c in by), *(F.col(f"{k}{i}").alias(f"{n}_{k}") for i, n in enumerate(names) for k in kinds))


def kendall(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pairs that agree, that disagree and that are level in x or y, and Kendall's tau-b (NULL where x or y is constant)."""
    one = F.lit(1)
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = dominance(df, by, x, y, {"p": (one, one)})
    ties = None
    for name, cols in (("x", [x]), ("y", [y])):
        c = both.groupBy(*by, *cols).agg(F.count("*").cast("double").alias("__n")).groupBy(*by).agg(F.sum(F.col("__n") * (F.col("__n") - 1) / 2).alias(f"tied_{name}"), F.sum("__n").alias("n"))
        c = c.withColumn("__k", F.struct(*by) if by else F.struct(F.lit(0))).drop(*by)
        ties = c if ties is None else ties.drop("n").join(c, "__k")
    d = d.withColumn("__k", F.struct(*by) if by else F.struct(F.lit(0))).join(ties, "__k", "left").drop("__k")
    agree, apart = F.col("p_less"), F.col("p_all") - F.col("p_less") - F.col("p_tie")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    tau = ratio(agree - apart, F.sqrt(pairs - F.col("tied_x")) * F.sqrt(pairs - F.col("tied_y")))
    return d.select(*by, agree.cast("bigint").alias("agree"), apart.cast("bigint").alias("disagree"), F.col("tied_x").cast("bigint").alias("tied_x"), F.col("tied_y").cast("bigint").alias("tied_y"), tau.alias("tau"))


def ordinal_agreement(df: DataFrame, predicted: str, true: str, by: list[str]) -> DataFrame:
    """Of the pairs whose true values differ, how many are in the same order by the prediction."""
    d = dominance(df, by, true, predicted, {"p": (F.lit(1), F.lit(1))})
    return d.select(*by, F.col("p_less").cast("bigint").alias("agree"), F.col("p_all").cast("bigint").alias("counted"), ratio(F.col("p_less"), F.col("p_all")).alias("share"))


def _distances(df: DataFrame, value: str, key: str) -> DataFrame:
    """For each group and distinct value the sum of its distances to all rows of the group."""
    counts = df.groupBy(key, value).agg(F.count("*").cast("double").alias("n")).withColumn("t", F.col("n") * F.col(value))
    run = running_totals(counts, value, ["n", "t"], [key])
    far = F.col(value) * F.col("cum_n") - F.col("cum_t") + (F.col("total_t") - F.col("cum_t")) - F.col(value) * (F.col("total_n") - F.col("cum_n"))
    return run.select(key, value, far.alias(f"d_{value}"))


def distance_correlation(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """n, the squared distance covariance of standardised x and y, the distance correlation, and its bias-corrected form
    (NULL below 4 rows, and where x or y is constant). Exact: distances come from running totals, their products from dominance sums."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.struct(*by).alias("__k") if by else F.struct(F.lit(0).alias("one")).alias("__k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    m = rows.groupBy("__k").agg(F.count("*").cast("double").alias("n"), *(f(c).alias(f"{k}_{c}") for c in "xy" for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    m = stored(m.filter("n >= 4 AND s_x > 0 AND s_y > 0"), "distance-moments")
    rows = stored(rows.join(m, "__k").select("__k", *(((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(c) for c in "xy")), "distance-rows")
    a, b = F.col("x"), F.col("y")
    one = F.lit(1.0)
    d = dominance(rows, ["__k"], "x", "y", {"p": (one, a * b), "q": (b, a), "r": (a, b), "s": (a * b, one)})
    net = lambda n: 2 * F.col(f"{n}_less") + F.col(f"{n}_tie") - F.col(f"{n}_all")
    d = d.select("__k", (2 * (net("p") - net("q") - net("r") + net("s"))).alias("sxy"))
    far = rows.join(_distances(rows, "x", "__k"), ["__k", "x"]).join(_distances(rows, "y", "__k"), ["__k", "y"])
    t = far.groupBy("__k").agg(*(F.sum(F.col(f"d_{p}") * F.col(f"d_{q}")).alias(f"t{p}{q}") for p, q in ("xy", "xx", "yy")), F.sum("d_x").alias("ax"), F.sum("d_y").alias("ay"), *(F.sum(F.col(c) ** 2).alias(f"q{c}") for c in "xy"), *(F.sum(c).alias(f"l{c}") for c in "xy"))
    t = t.join(d, "__k").join(m.select("__k", "n"), "__k")
    n = F.col("n")
    same = lambda c: 2 * n * F.col(f"q{c}") - 2 * F.col(f"l{c}") ** 2
    v = lambda s, tt, p, q: s / n**2 - 2 * tt / n**3 + p * q / n**4
    u = lambda s, tt, p, q: s / (n * (n - 3)) - 2 * tt / (n * (n - 2) * (n - 3)) + p * q / (n * (n - 1) * (n - 2) * (n - 3))
    terms = {"xy": (F.col("sxy"), F.col("txy"), F.col("ax"), F.col("ay")), "xx": (same("x"), F.col("txx"), F.col("ax"), F.col("ax")), "yy": (same("y"), F.col("tyy"), F.col("ay"), F.col("ay"))}
    t = t.withColumns({f"{f}{k}": g(*z) for k, z in terms.items() for f, g in (("v", v), ("u", u))})
    dcor = F.sqrt(F.greatest(F.col("vxy"), F.lit(0.0)) / F.sqrt(F.col("vxx") * F.col("vyy")))
    star = F.when((F.col("uxx") > 0) & (F.col("uyy") > 0), F.col("uxy") / F.sqrt(F.col("uxx") * F.col("uyy")))
    return t.select(*(F.col(f"__k.{c}").alias(c) for c in by), n.cast("bigint").alias("n"), F.col("vxy").alias("dcov2"), dcor.alias("dcor"), star.alias("corrected"))


def survival_curves(df: DataFrame, time: str, event: str, by: list[str]) -> DataFrame:
    """For each group (as the struct __g) and distinct time: survival of events and of censoring, right of it and left of it
    (s, s_left, g, g_left). Events come before censorings of the same time. Running totals by ranges of time; no group in a task."""
    e = F.col(event).cast("int")
    keyed = df.filter(F.col(time).isNotNull() & F.col(event).isNotNull()).withColumn("__g", F.struct(*by) if by else F.struct(F.lit(0).alias("one")))
    counts = keyed.groupBy("__g", F.col(time).alias("__t")).agg(F.sum(e).cast("double").alias("e"), F.count("*").cast("double").alias("n"))
    run = running_totals(counts, "__t", ["n"], ["__g"])
    risk = F.col("total_n") - F.col("cum_n") + F.col("n")
    hazard = {"s": F.coalesce(ratio(F.col("e"), risk), F.lit(0.0)), "g": F.coalesce(ratio(F.col("n") - F.col("e"), risk - F.col("e")), F.lit(0.0))}
    logs = run.select("__g", "__t", *(F.when(h < 1, F.log1p(-h)).otherwise(0.0).alias(f"log_{k}") for k, h in hazard.items()), *((h >= 1).cast("double").alias(f"end_{k}") for k, h in hazard.items()))
    run = running_totals(logs, "__t", ["log_s", "log_g", "end_s", "end_g"], ["__g"])
    value = lambda k, left: F.when(F.col(f"cum_end_{k}") - (F.col(f"end_{k}") if left else 0) > 0, 0.0).otherwise(F.exp(F.col(f"cum_log_{k}") - (F.col(f"log_{k}") if left else 0)))
    return run.select("__g", "__t", *(value(k, left).alias(f"{k}{'_left' if left else ''}") for k in "sg" for left in (False, True)))


def uno_c(df: DataFrame, risk: str, time: str, event: str, by: list[str], horizon: float | None = None) -> DataFrame:
    """Uno's concordance: pairs whose earlier time is an event before the horizon, weighted by the inverse square of the
    censoring survival just before it (0 where that has come to 0). NULL without such pairs."""
    curve = stored(survival_curves(df, time, event, by), "curves").select("__g", "__t", "g_left")
    keyed = df.withColumns({"__g": F.struct(*by) if by else F.struct(F.lit(0).alias("one")), "__t": F.col(time)})
    rows = keyed.filter(F.col(event).isNotNull() & F.col(risk).isNotNull()).groupBy("__g", "__t", F.col(risk).alias("__r")).agg(F.sum(F.col(event).cast("int")).alias("e"), F.count("*").alias("n")).join(curve, ["__g", "__t"])
    early = F.lit(True) if horizon is None else F.col("__t") < horizon
    w = F.when((F.col("g_left") > 0) & early, F.col("e") / F.col("g_left") ** 2).otherwise(0.0)
    d = dominance(rows, ["__g"], "__t", "__r", {"p": (w, F.col("n"))})
    right = F.col("p_all") - F.col("p_less") - F.col("p_tie") / 2
    return d.select(*(F.col(f"__g.{c}").alias(c) for c in by), F.col("p_all").alias("weight"), ratio(right, F.col("p_all")).alias("c"))


def _at(curve: Column, grid: list[float], t: float) -> Column:
    """The predicted survival at t: the value at the last time of the grid that isn't later, 1 before the first."""
    k = sum(g <= t for g in grid)
    return F.get(curve, F.lit(k - 1)) if k else F.lit(1.0)


def _weighed(df: DataFrame, time: str, event: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    curve = stored(survival_curves(df, time, event, by), "curves")
    keyed = df.filter(F.col(event).isNotNull()).withColumns({"__g": F.struct(*by) if by else F.struct(F.lit(0).alias("one")), "__t": F.col(time)})
    return keyed.join(curve.select("__g", "__t", "g_left"), ["__g", "__t"]).withColumn("__w", F.when(F.col("g_left") > 0, 1 / F.col("g_left")).otherwise(0.0)), curve


def brier_ipcw(df: DataFrame, curve: str, grid: list[float], time: str, event: str, by: list[str], times: list[float]) -> DataFrame:
    """One row for each group and time: the Brier score of predicted survival curves (arrays on `grid`), reweighted by the
    survival of censoring; NULL where that is 0. A row censored at t is known to have survived t. All times are sums of one aggregate."""
    rows, curves = _weighed(df, time, event, by)
    died = lambda t: (F.col("__t") <= t) & F.col(event).cast("boolean")
    lived = lambda t: (F.col("__t") > t) | ((F.col("__t") == t) & ~F.col(event).cast("boolean"))
    sums = []
    for i, t in enumerate(times):
        s = _at(F.col(curve), grid, t)
        sums += [F.sum(F.when(died(t), F.col("__w") * s * s).otherwise(0.0)).alias(f"d{i}"), F.sum(F.when(lived(t), (1 - s) * (1 - s)).otherwise(0.0)).alias(f"a{i}")]
    at = curves.groupBy("__g").agg(*(F.coalesce(F.max_by("g", F.when(F.col("__t") < t, F.col("__t"))), F.lit(1.0)).alias(f"g{i}") for i, t in enumerate(times)))
    out = rows.groupBy("__g").agg(F.count("*").alias("n"), *sums).join(at, "__g")
    scores = F.array(*(F.struct(F.lit(float(t)).alias("t"), F.when(F.col(f"g{i}") > 0, (F.col(f"d{i}") + F.col(f"a{i}") / F.col(f"g{i}")) / F.col("n")).alias("brier")) for i, t in enumerate(times)))
    return out.select(*(F.col(f"__g.{c}").alias(c) for c in by), F.explode(scores).alias("x")).select(*by, "x.t", "x.brier")


def integrated_brier(df: DataFrame, curve: str, grid: list[float], time: str, event: str, by: list[str], most: float | None = None) -> DataFrame:
    """The mean of the Brier score from 0 to `most` (the grid's last time) by trapezia over 0 and the grid; times at which
    there is no score are left out, and below two times it's NULL."""
    top = float(grid[-1] if most is None else most)
    times = sorted({0.0, *(float(g) for g in grid if g <= top), top})
    scores = brier_ipcw(df, curve, grid, time, event, by, times).filter("brier IS NOT NULL")
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("t")
    part = (F.col("t") - F.lag("t").over(w)) * (F.col("brier") + F.lag("brier").over(w)) / 2
    return scores.withColumn("__p", part).groupBy(*by).agg(ratio(F.sum("__p"), F.max("t") - F.min("t")).alias("integrated"))


def dynamic_auc(df: DataFrame, marker: Column | list[Column], time: str, event: str, by: list[str], times: list[float]) -> DataFrame:
    """One row for each group and time: how often a case (an event until t, weighted by the inverse survival of censoring) has
    a larger marker than a row that is known to have survived t, ties half; `decrement` is what the survival of events
    falls from the time before. The mean over times is weighted by that. The marker is one column, or one for each time."""
    rows, curves = _weighed(df, time, event, by)
    marks = marker if isinstance(marker, list) else [marker] * len(times)
    seen = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("t"), m.cast("double").alias("m")) for i, (t, m) in enumerate(zip(times, marks, strict=True))))
    each = rows.withColumn("x", F.explode(seen)).select("__g", "__t", F.col(event).cast("boolean").alias("e"), "__w", "x.*").filter("m IS NOT NULL")
    case, live = (F.col("__t") <= F.col("t")) & F.col("e"), (F.col("__t") > F.col("t")) | ((F.col("__t") == F.col("t")) & ~F.col("e"))
    counts = each.groupBy("__g", "i", "m").agg(F.sum(F.when(case, F.col("__w")).otherwise(0.0)).alias("c"), F.sum(live.cast("double")).alias("l"))
    run = running_totals(stored(counts, "marks"), "m", ["l"], ["__g", "i"])
    a = run.groupBy("__g", "i").agg(ratio(F.sum(F.col("c") * (F.col("cum_l") - F.col("l") / 2)), F.sum("c") * F.max("total_l")).alias("auc"))
    s = curves.groupBy("__g").agg(F.array(*(F.coalesce(F.max_by("s", F.when(F.col("__t") <= t, F.col("__t"))), F.lit(1.0)) for t in times)).alias("s"))
    steps = s.select("__g", F.posexplode("s").alias("i", "now"), "s").withColumn("decrement", F.when(F.col("i") == 0, 1.0).otherwise(F.get("s", F.col("i") - 1)) - F.col("now"))
    out = steps.join(a, ["__g", "i"], "left").select("__g", F.element_at(F.array(*(F.lit(float(t)) for t in times)), F.col("i") + 1).alias("t"), "auc", "decrement")
    return out.select(*(F.col(f"__g.{c}").alias(c) for c in by), "t", "auc", "decrement")
