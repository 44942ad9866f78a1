"""Resampling of dependent series: block lengths, the stationary bootstrap of means, jackknife by blocks, and BCa intervals.

A resample is its blocks, (start, length) at random; what a block adds up to is a difference of running totals. So a
replicate is a join on block ends, and rows are neither repeated nor hashed once per replicate."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import joined, ratio
from tessera.operators.ranks import running_totals
from tessera.operators.series import BLOCK
from tessera.sources.stored import stored

#: Rows of running totals that a task of replicates holds (8 bytes each).
REACH = 1 << 22


def _kinds(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)


def autocovariances(series: DataFrame, by: list[str], lags: int, block: int = BLOCK) -> DataFrame:
    """(by, lag, n, covariance) for the lags 0 to `lags` (below n), over n. Blocks of the index carry the first rows of the next
    block, and their sums are added up, so that no task gets a whole series."""
    m = series.groupBy(*by).agg(F.count("*").alias("n"), F.avg("v").alias("__m"))
    block = max(block, lags)
    at = F.expr(f"i div {block}").cast("int")
    both = F.when((F.pmod(F.col("i"), F.lit(block)) < lags) & (F.col("i") >= block), F.array(at, at - 1)).otherwise(F.array(at))
    rows = joined(series, m, by).select(*by, "n", "i", (F.col("v") - F.col("__m")).alias("e"), F.explode(both).alias("__block"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        e, i, b, n = table.column("e").to_numpy(), table.column("i").to_numpy(), table.column("__block")[0].as_py(), table.column("n")[0].as_py()
        own = int((i < (b + 1) * block).sum())
        top = min(lags, n - 1)
        sums = [float(e[: max(0, min(own, len(e) - k))] @ e[k : k + max(0, min(own, len(e) - k))]) for k in range(top + 1)]
        key = {c: pa.chunked_array([table.column(c).combine_chunks().take(pa.array([0] * (top + 1)))]) for c in by}
        return pa.table({**key, "n": [n] * (top + 1), "lag": pa.array(range(top + 1), pa.int32()), "s": sums})

    sums = rows.groupBy(*by, "__block").applyInArrow(run, f"{_kinds(series, by)}, n long, lag int, s double")
    return sums.groupBy(*by, "lag").agg(F.max("n").alias("n"), (F.sum("s") / F.max("n")).alias("covariance"))


def optimal_block_length(series: DataFrame, by: list[str]) -> DataFrame:
    """The mean block length of the stationary bootstrap for the mean of each series (Politis and White 2004, with the correction of
    Patton, Politis and White 2009): from the autocovariances up to the lag beyond which none is large, under a flat-top
    window. 1 for series shorter than 8, and for constant ones."""
    longest = series.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    beyond = lambda n: max(5, math.ceil(math.sqrt(math.log10(n)))) if n > 1 else 5
    most = math.ceil(math.sqrt(longest)) + beyond(longest)
    acov = autocovariances(series, by, most)

    def rule(frame: pd.DataFrame) -> pd.DataFrame:
        r = frame.sort_values("lag")["covariance"].to_numpy()
        n = int(frame["n"].iloc[0])
        length = 1.0
        if n >= 8 and r[0] > 0:
            k = beyond(n)
            r = r[: min(n - 1, math.ceil(math.sqrt(n)) + k) + 1]
            small = np.abs(r[1:] / r[0]) < 2 * math.sqrt(math.log10(n) / n)
            quiet = [m for m in range(len(r) - k) if small[m : m + k].all()]
            m = min(max(2 * quiet[0], 1), len(r) - 1) if quiet else len(r) - 1
            lag = np.arange(1, m + 1)
            flat = np.minimum(1.0, 2 * (1 - lag / m))
            g, d = 2 * (flat * lag * r[1 : m + 1]).sum(), r[0] + 2 * (flat * r[1 : m + 1]).sum()
            if d > 0:
                length = min(max((g / d) ** (2 / 3) * n ** (1 / 3), 1.0), math.ceil(min(3 * math.sqrt(n), n / 3)))
        return pd.DataFrame([{**{b: frame[b].iloc[0] for b in by}, "n": n, "length": float(length)}])

    return acov.groupBy(*by).applyInPandas(rule, f"{_kinds(series, by)}, n long, length double")


def _draws(n: int, mean: float, replicate: int, key: str, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and lengths of the blocks of a replicate, in pieces."""
    left = n
    rng = np.random.Generator(np.random.Philox(int.from_bytes(hashlib.sha256(f"{seed}|{replicate}|{key}".encode()).digest()[:16])))
    while left:
        size = int(min(65_536, left / mean + 16))
        start, length = rng.integers(0, n, size), rng.geometric(min(1.0, 1 / mean), size)
        upto = np.cumsum(length)
        use = int(np.searchsorted(upto, left)) + 1
        start, length = start[:use], length[:use].copy()
        if use <= size:
            length[-1] -= upto[use - 1] - left
        left -= int(length.sum())
        yield start, length


def stationary_blocks(lengths: DataFrame, by: list[str], replicates: int, seed: int = 0) -> DataFrame:
    """(by, replicate, start, length) of the blocks of each replicate of a series of n rows: starts are uniform, lengths are
    geometric around `length`, the last block is cut at n. Draws depend on the key, the replicate and the seed, not on partitions;
    they are handed over in pieces."""
    each = lengths.select(*by, "n", "length", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    name = F.to_json(F.struct(*by)) if by else F.lit("")
    each = each.withColumn("__key", name).repartition(F.col("__key"), "replicate")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                for start, length in _draws(int(row["n"]), row["length"], row["replicate"], row["__key"], seed):
                    out = pd.DataFrame({"replicate": row["replicate"], "start": start, "length": length})
                    for b in by:
                        out[b] = row[b]
                    yield out[[*by, "replicate", "start", "length"]]

    return each.mapInPandas(run, f"{_kinds(lengths, by)}, replicate int, start long, length long")


def replicate_means(series: DataFrame, by: list[str], blocks: DataFrame) -> DataFrame:
    """(by, replicate, mean). A block that reaches the end goes on at the beginning: it is whole turns, and a difference of the
    running total at two places."""
    run = joined(running_totals(series, "i", ["v"], by), series.groupBy(*by).agg(F.count("*").alias("n")), by)
    run = stored(run.select(*by, "n", F.col("i").alias("at"), F.col("cum_v").alias("cum"), F.col("total_v").alias("total")), "totals")
    size = run.groupBy(*by).agg(F.max("n").alias("n"), F.max("total").alias("total"))
    b = joined(blocks, size, by).withColumn("last", F.col("start") + F.col("length") - 1)
    ends = F.array(F.struct(F.pmod(F.col("last"), F.col("n")).alias("at"), F.lit(1.0).alias("sign"), F.expr("last div n").alias("turns")), F.struct((F.col("start") - 1).alias("at"), F.lit(-1.0).alias("sign"), F.lit(0).cast("bigint").alias("turns")))
    ends = b.select(*by, "replicate", "n", "total", F.explode(ends).alias("x")).groupBy(*by, "replicate", "n", "total", F.col("x.at").alias("at")).agg(F.sum("x.sign").alias("sign"), F.sum("x.turns").alias("turns"))
    met = joined(ends, run.select(*by, "at", "cum"), [*by, "at"], "left")
    total = F.sum(F.col("sign") * F.coalesce("cum", F.lit(0.0)) + F.col("turns") * F.col("total"))
    return met.groupBy(*by, "replicate", "n").agg(total.alias("__s")).select(*by, "replicate", (F.col("__s") / F.col("n")).alias("mean"))


def stationary_means(series: DataFrame, by: list[str], lengths: DataFrame, replicates: int, seed: int = 0, reach: int = REACH, share: int = 25) -> DataFrame:
    """(by, replicate, mean): replicate_means of stationary_blocks, without rows of blocks. Running totals are packed and handed to each
    `share` of the replicates, in ranges of `reach` rows; a task draws the blocks of its replicates again and takes the ends that
    are in its range. So what is shuffled is the series once for each share, and draws are repeated only for series beyond
    `reach` rows, a time for each range."""
    name = F.to_json(F.struct(*by)) if by else F.lit("")
    run = joined(running_totals(series, "i", ["v"], by), lengths, by)
    kinds = f"{_kinds(series, by)}, " if by else ""
    step = min(BLOCK, reach)
    packs = run.select(*by, name.alias("__key"), "n", "length", F.col("total_v").alias("total"), F.expr(f"i div {step}").alias("__pack"), "i", F.col("cum_v").cast("double").alias("cum"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        first = table.slice(0, 1)
        return first.drop_columns(["cum"]).append_column("cum", pa.array([table.column("cum").to_numpy().tobytes()], pa.binary()))

    packed = packs.groupBy(*by, "__pack").applyInArrow(pack, f"{kinds}__key string, n long, length double, total double, __pack long, i long, cum binary")
    shares = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // share))).alias("__share")
    dealt = packed.select("*", F.expr(f"i div {reach // step * step}").alias("__range"), shares)

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        row, low = frame.iloc[0], int(frame["i"].iloc[0])
        n, total, cum = int(row["n"]), float(row["total"]), np.concatenate([np.frombuffer(x) for x in frame["cum"]])

        def at(place: np.ndarray) -> np.ndarray:
            if len(cum) == n:
                return np.where(place < 0, 0.0, cum[place])
            inside = (place >= low) & (place < low + len(cum))
            return np.where(inside, cum[np.where(inside, place - low, 0)], 0.0)

        out = []
        for r in range(int(row["__share"]) * share, min(replicates, (int(row["__share"]) + 1) * share)):
            s, turns = 0.0, 0
            for start, length in _draws(n, row["length"], r, row["__key"], seed):
                last = start + length - 1
                s += float((at(last % n) - at(start - 1)).sum())
                turns += int((last // n).sum())
            out.append((r, n, s + turns * total * (low == 0)))
        out = pd.DataFrame(out, columns=["replicate", "n", "__s"])
        for b in by:
            out[b] = row[b]
        return out[[*by, "replicate", "n", "__s"]]

    sums = dealt.groupBy(*by, "__range", "__share").applyInPandas(draw, f"{kinds}replicate int, n long, __s double")
    return sums.groupBy(*by, "replicate", "n").agg(F.sum("__s").alias("__s")).select(*by, "replicate", (F.col("__s") / F.col("n")).alias("mean"))


def jackknife_means(series: DataFrame, by: list[str], groups: int) -> DataFrame:
    """(by, group, mean): the mean of each series without one of `groups` contiguous parts (as even as can be)."""
    m = series.groupBy(*by).agg(F.count("*").alias("n"), F.sum("v").alias("total")).withColumn("__g", F.least(F.col("n"), F.lit(groups)))
    wide, more = F.expr("n div __g"), F.expr("n % __g")
    part = F.when(F.col("i") < more * (wide + 1), F.expr("i div (n div __g + 1)")).otherwise(more + F.floor((F.col("i") - more * (wide + 1)) / wide))
    p = joined(series, m, by).groupBy(*by, "n", "total", part.cast("int").alias("group")).agg(F.count("*").alias("k"), F.sum("v").alias("s"))
    return p.select(*by, "group", ratio(F.col("total") - F.col("s"), F.col("n") - F.col("k")).alias("mean"))


def bca(values: np.ndarray, estimate: float, left_out: np.ndarray, confidence: float) -> tuple[float | None, float | None, str]:
    """The bias-corrected and accelerated interval of replicates; the percentile one where it isn't defined."""
    normal, tails = NormalDist(), ((1 - confidence) / 2, (1 + confidence) / 2)
    values = values[np.isfinite(values)]
    if len(values) < 2:
        return None, None, "percentile"
    levels, share = tails, ((values < estimate).sum() + (values == estimate).sum() / 2) / len(values)
    if 0 < share < 1:
        off = left_out[np.isfinite(left_out)]
        off = off.mean() - off if len(off) > 1 else np.zeros(2)
        size = (off**2).sum() ** 1.5
        a, z0 = ((off**3).sum() / (6 * size) if size > 0 else 0.0), normal.inv_cdf(share)
        moved = [(z0 + normal.inv_cdf(t)) for t in tails]
        if all(1 - a * z > 0 for z in moved):
            new = [normal.cdf(z0 + z / (1 - a * z)) for z in moved]
            if 0 < new[0] < new[1] < 1:
                levels = new
    low, high = np.quantile(values, levels)
    return float(low), float(high), "percentile" if levels is tails else "bca"


def bca_interval(estimates: DataFrame, replicates: DataFrame, left_out: DataFrame, by: list[str], confidence: float = 0.95) -> DataFrame:
    """(by, estimate, low, high, method, replicates) from (by, estimate), (by, replicate, mean) and (by, group, mean). The numbers of
    replicates and of groups are parameters of those, so that a group here is bounded."""
    rows = estimates.select(*by, F.lit(0).alias("__kind"), F.col("estimate").alias("__x")).union(replicates.select(*by, F.lit(1), "mean")).union(left_out.select(*by, F.lit(2), "mean"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = {k: frame.loc[frame["__kind"] == k, "__x"].to_numpy(float) for k in range(3)}
        out = {b: frame[b].iloc[0] for b in by} | {"estimate": x[0][0] if len(x[0]) else None, "low": None, "high": None, "method": "percentile", "replicates": int(np.isfinite(x[1]).sum())}
        if len(x[0]):
            x[2].sort()  # sums in one order, whatever the partitions
            out["low"], out["high"], out["method"] = bca(np.sort(x[1]), x[0][0], x[2], confidence)
        return pd.DataFrame([out]).astype({"estimate": "Float64", "low": "Float64", "high": "Float64"})

    return rows.groupBy(*by).applyInPandas(run, f"{_kinds(rows, by)}, estimate double, low double, high double, method string, replicates long")


def mean_interval(series: DataFrame, by: list[str], replicates: int = 200, groups: int = 50, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """The mean of each series with a BCa interval of the stationary bootstrap with automatic block lengths."""
    series = stored(series, "resampled")
    lengths = stored(optimal_block_length(series, by), "block-lengths")
    estimates = series.groupBy(*by).agg(F.avg("v").alias("estimate"))
    out = bca_interval(estimates, stationary_means(series, by, lengths, replicates, seed), jackknife_means(series, by, groups), by, confidence)
    return joined(out, lengths.select(*by, "length"), by)
