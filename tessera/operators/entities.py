"""Entities and relations over time: tables of facts, changes of state, silences, first suspects, host windows, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entity_table(df: DataFrame, entity: str, time: str) -> DataFrame:
    return df.groupBy(entity).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("updates"))


def relation_table(df: DataFrame, source: str, target: str, time: str, size: str) -> DataFrame:
    """One row for each unordered pair: when it was seen, rows and sizes in the direction from the smaller to the larger
    id and back. A size is NULL if any row's is."""
    fwd = F.col(source) <= F.col(target)
    rows = df.withColumns({"a": F.least(source, target), "b": F.greatest(source, target), "__f": fwd})

    def poisoned(side):
        value = F.when(side, F.col(size))
        return F.when(F.count(F.when(side, 1)) == F.count(value), F.coalesce(F.sum(value), F.lit(0)))

    return rows.groupBy("a", "b").agg(
        F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("updates"), F.sum(fwd.cast("bigint")).alias("updates_fwd"), F.sum((~fwd).cast("bigint")).alias("updates_bwd"),
        poisoned(fwd).alias("size_fwd"), poisoned(~fwd).alias("size_bwd"),
    )


def changes(df: DataFrame, by: list[str], order: list[str], state: str) -> DataFrame:
    """The rows at which the state is another one than before (the first row of each group is one)."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumns({"__was": F.lag(state).over(w), "__i": F.row_number().over(w)})
    return marked.filter((F.col("__i") == 1) | ~F.col(state).eqNullSafe(F.col("__was"))).drop("__was", "__i")


def silences(df: DataFrame, by: list[str], time: str, longer: int) -> DataFrame:
    """Gaps of more than `longer` between successive rows: when they began, and how long they were."""
    gap = F.lead(time).over(Window.partitionBy(*by).orderBy(time)) - F.col(time)
    return df.withColumn("gap", gap).filter(F.col("gap") > longer).select(*by, time, "gap")


def first_suspects(df: DataFrame, entity: str, time: str, score: str, alert: float, top: int) -> DataFrame:
    """The `top` entities by earliest alert (none: last), then by highest score, then by id."""
    agg = df.groupBy(entity).agg(F.min(F.when(F.col(score) >= alert, F.col(time))).alias("first_alert"), F.max(score).alias("best"))
    return agg.orderBy(F.col("first_alert").asc_nulls_last(), F.desc("best"), entity).limit(top)


def host_windows(df: DataFrame, host: str, time: str, width: int, category: str, values: list, number: str, peer: str) -> DataFrame:
    """Per host and window: rows of each category value, distinct peers, and sum, least and largest number (NULL if all are
    absent)."""
    g = F.expr(f"({time} - pmod({time}, {width})) div {width}")
    return df.groupBy(host, g.alias("g")).agg(
        *(F.sum((F.col(category) == v).cast("bigint")).alias(f"n_{v}") for v in values), F.count_distinct(peer).alias("peers"), F.sum(number).alias("total"), F.min(number).alias("least"), F.max(number).alias("largest")
    )


def log_time_cells(df: DataFrame, by: list[str], time: str, now: int, first: int, value: str) -> DataFrame:
    """Retention whose resolution halves with age: ages are put into levels that double from `first` on, and each level
    into cells of its own width; a cell keeps a count, a mean and the latest time. So a group has as many cells as the
    logarithm of its age, however many rows it has."""
    age = (F.lit(now) - F.col(time)).cast("double")
    level = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(age, F.lit(1.0)) / first)) + 1).cast("int")
    rows = df.filter(F.col(time) <= now).withColumn("level", level)
    width = (F.lit(first) * F.pow(F.lit(2.0), F.greatest(F.col("level") - 1, F.lit(0)))).cast("bigint")
    cell = F.floor(F.col(time) / width)
    return rows.groupBy(*by, "level", cell.alias("cell")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(time).alias("latest"))


def category_codes(df: DataFrame, column: str, least: int, most: int) -> DataFrame:
    """The vocabulary of a categorical column: values with `least` rows or more, the most frequent first (ties: by
    value), `most` at most; code 0 is for all others."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    top = counts.orderBy(F.desc("n"), column).limit(most)
    return top.withColumn("code", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), column)))


def paths(df: DataFrame, by: list[str], order: list[str], letter: str, most: int | None = None) -> DataFrame:
    """The states of each group in order (the last `most` of them, where given), as a string of single letters."""
    w = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order))
    last = df.withColumn("__r", F.row_number().over(w))
    last = last if most is None else last.filter(F.col("__r") <= most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("__r")).alias("i"), F.col(letter).alias("l")))), lambda s: s["l"]), "")
    return last.groupBy(*by).agg(joined.alias("path"))
