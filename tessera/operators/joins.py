"""As-of and interval joins, unions of intervals, and audits of what two sets of rows share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with the values of the latest row of right (same key, time not after left_time); nulls where there is none.

    Both sides are one stream per key, sorted once: each left row takes the last values before it. So a key's rows are
    never multiplied. A hot key is cut into periods: see `periods` of as-of joins in `asof_periods`.
    """
    a = left.select(F.struct(*left.columns).alias("__row"), *by, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__v"))
    b = right.select(F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), *by, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*values).alias("__v"))
    order = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("__last", F.last("__v", ignorenulls=True).over(order)).filter("__side = 1")
    return found.select("__row.*", *(F.col(f"__last.{v}").alias(v) for v in values))


def asof_periods(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], period: int) -> DataFrame:
    """As `asof`, for keys too large for one task: each key's time is cut into periods that are sorted by themselves,
    and each period begins with the last row of right before it (one row per key and period)."""
    # the last row before a period is that of the nearest earlier period with rows of right
    place = lambda t: F.floor(F.col(t) / F.lit(period))
    r = right.withColumn("__p", place(right_time))
    ends = r.groupBy(*by, "__p").agg(F.max_by(F.struct(F.col(right_time), *values), F.struct(right_time, *values)).alias("__end"))
    spine = left.select(*by, place(left_time).alias("__p")).distinct().join(ends, [*by, "__p"], "full")
    carried = F.last("__end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    seeds = spine.withColumn("__seed", carried).filter("__seed IS NOT NULL").select(*by, "__p", F.col(f"__seed.{right_time}").alias(right_time), *(F.col(f"__seed.{v}").alias(v) for v in values))
    both = r.select(*by, "__p", right_time, *values).unionByName(seeds)
    return asof(left.withColumn("__p", place(left_time)), both, [*by, "__p"], left_time, right_time, values).drop("__p")


def interval(left: DataFrame, right: DataFrame, by: list[str], time: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Rows of left (points) with rows of right (intervals, both ends closed) of the same key that contain them. Points
    and intervals meet in cells of `width`, so that an equal join finds them; each pair meets once."""
    cells = right.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    points = left.withColumn("__cell", F.floor(F.col(time) / width))
    keys = [*by, "__cell"]
    joined = points.alias("l").join(cells.alias("r"), [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col(time).between(F.col(start), F.col(end))], how)
    return joined.select("l.*", *(F.col(f"r.{c}") for c in right.columns if c not in by)).drop("__cell")


def merged_intervals(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """The union of each key's intervals, as disjoint ones; intervals that touch are joined."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("__island", F.sum("__new").over(order))
    return marked.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def overlap_length(a: DataFrame, b: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Total length of the common part of two unions of intervals, per key that both have. By a sweep over the sorted
    ends: the depth of each side is a running sum, and a step counts where both are positive."""
    events = None
    for side, df in ((1, merged_intervals(a, by, start, end)), (2, merged_intervals(b, by, start, end))):
        ends = df.select(*by, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e"))
        ends = ends.select(*by, "e.t", *(F.when(F.lit(side == s), F.col("e.d")).otherwise(0).alias(f"d{s}") for s in (1, 2)))
        events = ends if events is None else events.unionByName(ends)
    steps = events.groupBy(*by, "t").agg(F.sum("d1").alias("d1"), F.sum("d2").alias("d2"), F.max(F.abs(F.col("d1"))).alias("a1"), F.max(F.abs(F.col("d2"))).alias("a2"))
    order = Window.partitionBy(*by).orderBy("t")
    depth = order.rowsBetween(Window.unboundedPreceding, 0)
    both = (F.sum("d1").over(depth) > 0) & (F.sum("d2").over(depth) > 0)
    length = steps.withColumn("step", F.when(both, F.lead("t").over(order) - F.col("t")))
    return length.groupBy(*by).agg(F.sum("step").alias("overlap"), F.max("a1").alias("a1"), F.max("a2").alias("a2")).filter("a1 > 0 AND a2 > 0").select(*by, F.coalesce("overlap", F.lit(0)).alias("overlap"))


def shared_units(df: DataFrame, split: str, units: list[str]) -> DataFrame:
    """For each kind of unit: distinct units, units in several splits, and the rows of those."""
    named = df.select(split, F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).cast("string").alias("key")) for u in units))).alias("x")).select(split, "x.*").filter("key IS NOT NULL")
    counts = named.groupBy("unit", "key", split).agg(F.count("*").alias("n"))
    keys = counts.groupBy("unit", "key").agg(F.count("*").alias("splits"), F.sum("n").alias("n"))
    several = F.col("splits") > 1
    return keys.groupBy("unit").agg(F.count("*").alias("keys"), F.sum(several.cast("long")).alias("shared_keys"), F.sum(F.when(several, F.col("n")).otherwise(0)).alias("shared_rows"))


def seen_share(df: DataFrame, split: str, train: str, key: str) -> DataFrame:
    """For each other split: its distinct keys, and the share of them that also occur in the training split."""
    keys = df.filter(F.col(key).isNotNull()).groupBy(key, split).agg(F.lit(1).alias("__one"))
    trained = keys.filter(F.col(split) == train).select(key, F.lit(1).alias("__seen"))
    return keys.filter(F.col(split) != train).join(trained, key, "left").groupBy(split).agg(F.count("*").alias("keys"), F.avg(F.coalesce("__seen", F.lit(0)).cast("double")).alias("seen"))


def cross_split_duplicates(df: DataFrame, split: str, train: str, columns: list[str]) -> DataFrame:
    """For each other split: its rows, and how many of them equal a training row in all columns (null equals null)."""
    cells = df.groupBy(*columns, split).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*columns)
    seen = F.max(F.when(F.col(split) == train, 1).otherwise(0)).over(w)
    return cells.withColumn("seen", seen).filter(F.col(split) != train).groupBy(split).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("seen") == 1, F.col("n")).otherwise(0)).alias("duplicates"))


def compared(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that differ: only in a, only in b, or with the names of the columns that are unequal (null equals null)."""
    x, y = a.select(key, F.struct(*columns).alias("a")), b.select(key, F.struct(*columns).alias("b"))
    joined = x.join(y, key, "full")
    names = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns)))
    what = F.when(F.col("a").isNull(), "only right").when(F.col("b").isNull(), "only left").otherwise(F.concat_ws(",", names))
    return joined.select(key, what.alias("difference")).filter(F.col("difference") != "")


def first_alerts(episodes: DataFrame, units: DataFrame, by: list[str], lead: int, late: int, threshold: float, width: int) -> DataFrame:
    """For each episode (id, key, start, completion): the first time of a unit of the same key that scores `threshold`
    or more within [completion - lead, completion + late]; `detected` if it isn't before the start; the lead time is
    completion - alert (null if never alerted)."""
    hits = units.filter(F.col("score") >= threshold).select(*by, "time")
    spans = episodes.select(*by, "episode", "start", "completion", (F.col("completion") - lead).alias("__lo"), (F.col("completion") + late).alias("__hi"))
    met = interval(hits, spans, by, "time", "__lo", "__hi", width).groupBy("episode").agg(F.min("time").alias("alert"))
    found = episodes.select("episode", "start", "completion").join(met, "episode", "left")
    return found.withColumns({"detected": F.coalesce((F.col("alert") >= F.col("start")), F.lit(False)), "lead": F.col("completion") - F.col("alert")})


