"""Row-level constraints, and measures of one-dimensional persistence diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def residuals(df: DataFrame, rules: dict[str, str], by: list[str]) -> DataFrame:
    """For each rule (a SQL expression of the amount by which it is broken; 0 or less is kept, NULL can't be checked): rows
    that can be checked, rows that break it, and the mean and largest excess among those."""
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.expr(e).cast("double").alias("x")) for n, e in rules.items()))).alias("r")).select(*by, "r.*")
    over = F.when(F.col("x") > 0, F.col("x"))
    return long.groupBy(*by, "rule").agg(F.count("x").alias("checked"), F.count(over).alias("broken"), F.avg(over).alias("mean_excess"), F.max(over).alias("largest"))


def betti_curve(df: DataFrame, by: list[str], birth: str, death: str) -> DataFrame:
    """The number of intervals [birth, death) that are alive, at every point where it changes."""
    ends = df.filter(F.col(birth) < F.col(death)).select(*by, F.explode(F.array(F.struct(F.col(birth).alias("t"), F.lit(1).alias("d")), F.struct(F.col(death).alias("t"), F.lit(-1).alias("d")))).alias("e")).select(*by, "e.*")
    steps = ends.groupBy(*by, "t").agg(F.sum("d").alias("d"))
    return steps.withColumn("alive", F.sum("d").over(Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0))).drop("d")


def diagram_summary(df: DataFrame, by: list[str], birth: str, death: str) -> DataFrame:
    """Number, total and largest persistence, and the entropy of the shares of the total."""
    life = df.filter(F.col(birth) < F.col(death)).withColumn("l", (F.col(death) - F.col(birth)).cast("double"))
    s = life.groupBy(*by).agg(F.count("*").alias("n"), F.sum("l").alias("total"), F.max("l").alias("largest"), F.sum(F.col("l") * F.log("l")).alias("s"))
    return s.select(*by, "n", "total", "largest", (F.log("total") - F.col("s") / F.col("total")).alias("entropy"))


def trigger_audit(df: DataFrame, time: str, kind: str, cadence: int, most: int) -> DataFrame:
    """Cadence triggers that are off the grid, and intervals with more than `most` priority triggers."""
    off = df.filter((F.col(kind) == "cadence") & (F.pmod(F.col(time), F.lit(cadence)) != 0)).groupBy().agg(F.count("*").alias("off_grid"))
    many = df.filter(F.col(kind) == "priority").groupBy(F.expr(f"({time} - pmod({time}, {cadence})) div {cadence}")).count().filter(F.col("count") > most).groupBy().agg(F.count("*").alias("crowded"))
    return off.crossJoin(many)  # one row each
