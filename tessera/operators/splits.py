"""Splits and samples that don't depend on partitions: chronological, by group, folds, weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import micros
from tessera.operators.ranks import PART, ranged, running_totals


def hash_order(key: Column, seed: int = 0) -> Column:
    """A fixed pseudo-random order of keys, the same in any engine: hex MD5 of 'seed:key'."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def _position(df: DataFrame, column: str) -> Column:
    """A number that grows with the column, if perhaps not strictly; equal for all rows where there is no such number."""
    kind = dict(df.dtypes)[column]
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.col(column).cast("double")
    if kind == "date" or kind.startswith("timestamp"):
        return micros(column).cast("double")
    return F.lit(0.0)


def numbered(df: DataFrame, strata: list[str], order: list, value: Column | None = None) -> DataFrame:
    """Adds i (from 0) and n in each stratum, by `order`. Rows are cut into ranges of `value`, a number that grows with
    the order (by default the first column of it); each range of a stratum is sorted by itself, and the counts of the
    ranges before it are added, so that one stratum may hold all rows."""
    value = _position(df, order[0]) if value is None else value
    rows = ranged(df.withColumn("__value", F.coalesce(value, F.lit(-1e308))), "__value").drop("__value")
    counts = rows.groupBy(*strata, PART).agg(F.count("*").alias("__c"))
    whole = Window.partitionBy(*strata)
    before = whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*(F.col(c).alias(f"__o_{c}") for c in (*strata, PART)), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"), F.sum("__c").over(whole).alias("n"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in (*strata, PART)])
    rows = rows.withColumn("__row", F.row_number().over(Window.partitionBy(*strata, PART).orderBy(*order)) - 1).join(offsets, same)
    return rows.select(*df.columns, (F.col("__row") + F.col("__before")).cast("int").alias("i"), "n")


def dealt_order(df: DataFrame, strata: list[str], key: str, seed: int) -> DataFrame:
    """numbered() in the order of hashed keys."""
    hashed = hash_order(F.col(key), seed)
    return numbered(df, strata, [hashed, F.col(key)], F.conv(F.substring(hashed, 1, 12), 16, 10).cast("double"))


def _cuts(n: Column, ratios: list[float]) -> list[Column]:
    """Ends of the parts of n rows by largest remainders; ties go to the earlier part."""
    k = len(ratios)
    exact = [n * F.lit(r / sum(ratios)) for r in ratios]
    low = [F.floor(e + F.lit(1e-9)) for e in exact]
    rest = [e - f for e, f in zip(exact, low)]
    left = n - sum(low[1:], low[0])
    size = []
    for a in range(k):
        ahead = sum(((rest[b] > rest[a] + 1e-9) | ((F.abs(rest[b] - rest[a]) <= 1e-9) & F.lit(b < a))).cast("int") for b in range(k) if b != a)
        size.append(low[a] + (ahead < left).cast("int"))
    return [sum(size[1 : a + 1], size[0]) for a in range(k)]


def chronological(df: DataFrame, strata: list[str], order: list[str], roles: dict[str, float], purge: int = 1) -> DataFrame:
    """Adds `role`: each stratum in time order is cut into the roles' shares; the first `purge` rows after each cut are
    'excluded'."""
    rows = numbered(df, strata, order)
    ends = _cuts(F.col("n"), list(roles.values()))
    role, start = F.lit(None).cast("string"), F.lit(0)
    out = None
    for name, end in zip(roles, ends):
        own = F.when((F.col("i") < start + purge) & (start > 0), "excluded").otherwise(name)
        cond = (F.col("i") >= start) & (F.col("i") < end)
        out = F.when(cond, own) if out is None else out.when(cond, own)
        start = end
    return rows.withColumn("role", F.coalesce(out, role)).drop("i", "n")


def next_other_role(df: DataFrame, by: list[str], order: list[str], time: str, role: str, roles: list[str]) -> DataFrame:
    """Adds `limit`: the earliest later time in the same source of a row with another role (excluded rows don't count).

    Rows are cut into ranges of the order's first column, as in numbered(). A range is read from its end, with the least time of
    each role so far; the least times of the ranges after it are one row for each source and range."""
    rows = ranged(df.withColumn("__value", F.coalesce(_position(df, order[0]), F.lit(-1e308))), "__value").drop("__value")
    least = {r: F.min(F.when(F.col(role) == r, F.col(time))) for r in roles}
    names = {r: f"__n_{k}" for k, r in enumerate(roles)}
    parts = rows.groupBy(*by, PART).agg(*(e.alias(names[r]) for r, e in least.items()))
    after = Window.partitionBy(*by).orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    beyond = parts.select(*(F.col(c).alias(f"__o_{c}") for c in (*by, PART)), *(F.min(n).over(after).alias(f"__b{n}") for n in names.values()))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in (*by, PART)])
    back = Window.partitionBy(*by, PART).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({names[r]: e.over(back) for r, e in least.items()}).join(beyond, same)
    others = [F.when(F.col(role) != r, F.least(names[r], f"__b{names[r]}")) for r in roles]
    return rows.withColumn("limit", F.least(*others) if len(others) > 1 else others[0]).select(*df.columns, "limit")


def class_weights(df: DataFrame, label: str, power: float = 1.0) -> DataFrame:
    """One row for each class: rows, and the weight n**-power of each of its rows, all rows' weights adding up to 1."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    raw = F.pow(F.col("n").cast("double"), F.lit(-power))
    return counts.withColumn("weight", raw / F.sum(F.col("n") * raw).over(Window.partitionBy()))


def folds(df: DataFrame, key: str, stratum: str, k: int, seed: int = 0) -> DataFrame:
    """Adds `fold`: rows of each stratum are dealt in turn, in the order of hashed keys."""
    return dealt_order(df, [stratum], key, seed).withColumn("fold", F.col("i") % k).drop("i", "n")


def holdout(df: DataFrame, key: str, stratum: str, fraction: float, seed: int = 0) -> DataFrame:
    """Adds `test`: the first round(fraction * n) rows of each stratum in the order of hashed keys."""
    rows = dealt_order(df, [stratum], key, seed)
    return rows.withColumn("test", F.col("i") < F.floor(F.col("n") * fraction + 0.5)).drop("i", "n")


def group_holdout(df: DataFrame, group: str, test: list) -> DataFrame:
    return df.withColumn("test", F.col(group).isin(*test))


def last_rows(df: DataFrame, by: list[str], order: list[str], fraction: float) -> DataFrame:
    """Adds `test`: the last floor(fraction * n) rows of each key in time order."""
    rows = numbered(df, by, order)
    return rows.withColumn("test", F.col("i") >= F.col("n") - F.floor(F.col("n") * fraction)).drop("i", "n")


def disjoint_groups(df: DataFrame, group: str, fractions: dict[str, float], seed: int = 0) -> DataFrame:
    """Adds `part`: whole groups, by the first 32 bits of their hash."""
    at = F.conv(F.substring(hash_order(F.col(group), seed), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    out, edge = None, 0.0
    for name, f in fractions.items():
        edge += f
        out = F.when(at < edge, name) if out is None else out.when(at < edge, name)
    return df.withColumn("part", out.otherwise(list(fractions)[-1]))


def time_blocks(df: DataFrame, time: str, blocks: int) -> DataFrame:
    """Adds `block`: equal counts in time order; rows of one time share the block of the first of them."""
    counts = df.groupBy(time).agg(F.count("*").alias("n"))
    run = running_totals(counts, time, ["n"])
    # a boundary b * n / blocks that falls inside the rows of one time moves to the left
    inside = reduce(lambda a, b: a + b, [(F.col("cum_n") - F.col("n") >= F.round(F.lit(b) * F.col("total_n") / blocks)).cast("int") for b in range(1, blocks)])
    crossed = reduce(lambda a, b: a + b, [((F.col("cum_n") - F.col("n") < F.round(F.lit(b) * F.col("total_n") / blocks)) & (F.col("cum_n") > F.round(F.lit(b) * F.col("total_n") / blocks))).cast("int") for b in range(1, blocks)])
    return df.join(run.select(time, (inside + crossed).alias("block")), time)


def forward_folds(df: DataFrame, time: str, label_end: str, blocks: int, embargo: int) -> DataFrame:
    """For each block from the second on, as validation: rows of it, and rows of earlier blocks that may be trained on
    (their label ends before the block begins, and they are at least `embargo` older)."""
    placed = time_blocks(df, time, blocks)
    starts = placed.groupBy("block").agg(F.min(time).alias("v0"), F.count("*").alias("validation")).filter("block > 0")
    ahead = placed.join(F.broadcast(starts.withColumnRenamed("block", "fold")), F.col("block") < F.col("fold"))  # at most `blocks` rows
    train = ahead.filter((F.col(label_end) < F.col("v0")) & (F.col(time) <= F.col("v0") - embargo))
    return starts.withColumnRenamed("block", "fold").join(train.groupBy("fold").agg(F.count("*").alias("train")), "fold", "left").select("fold", "v0", "validation", F.coalesce("train", F.lit(0)).alias("train"))


def stratified_sample(df: DataFrame, key: str, stratum: str, share: float, seed: int = 0) -> DataFrame:
    """The first ceil(share * n) rows of each stratum in the order of hashed keys."""
    rows = dealt_order(df, [stratum], key, seed)
    return rows.filter(F.col("i") < F.ceil(F.col("n") * share)).drop("i", "n")


def weighted_order(df: DataFrame, key: str, weight: str, seed: int = 0) -> DataFrame:
    """Adds `turn`: -ln(u) / weight with u hashed from the key; taking the smallest turns samples without replacement
    with chances by weight."""
    u = (F.conv(F.substring(hash_order(F.col(key), seed), 1, 8), 16, 10).cast("bigint") + 0.5) / F.lit(float(1 << 32))
    return df.withColumn("turn", -F.log(u) / F.col(weight))
