"""What is observed, when, and how well: status shares, coverage, gaps, capability, ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import ratio
from tessera.functions.status import contributes, status_name
from tessera.operators.ranks import quantiles


def status_tables(df: DataFrame, group: str, status: str = "status") -> DataFrame:
    """Counts and shares of each status by group and, with a null group, over all rows."""
    sets = df.groupingSets([[group, status], [status]], group, status).agg(F.count("*").alias("n"), F.grouping(group).alias("overall"))
    whole = F.sum("n").over(Window.partitionBy("overall", group))
    return sets.select(F.col(group).alias("grp"), status_name(F.col(status)).alias("status_name"), "n", (F.col("n") / whole).alias("share"), F.col("overall").cast("int").alias("overall"))


def coverage_over_time(df: DataFrame, source: str, bin_us: int, us: str = "us", status: str = "status") -> DataFrame:
    """Per source and bin since the source's first row: rows, the share of each status and the contributing share."""
    first = df.groupBy(source).agg(F.min(us).alias("t0"))
    bins = df.join(F.broadcast(first) if first.count() <= 100_000 else first, source).withColumn("bin", F.expr(f"({us} - t0) div {bin_us}"))
    shares = [F.avg((F.col(status) == code).cast("double")).alias(f"share_{code}") for code in range(5)]
    return bins.groupBy(source, "bin").agg(F.count("*").alias("n"), *shares, F.avg(contributes(F.col(status)).cast("double")).alias("contributing"))


def coverage_gaps(cov: DataFrame, source: str, drop: float = 0.5, least: int = 1) -> DataFrame:
    """Runs of at least `least` successive existing bins whose contributing share is under drop times the median."""
    middle = quantiles(cov, "contributing", {"med": 0.5}, [source])
    order = Window.partitionBy(source).orderBy("bin")
    flagged = cov.join(middle, source).filter("med > 0").withColumn("low", F.col("contributing") < drop * F.col("med")).withColumn("i", F.row_number().over(order))
    runs = flagged.filter("low").withColumn("run", F.col("i") - F.row_number().over(order))
    return runs.groupBy(source, "run").agg(F.min("bin").alias("first_bin"), (F.max("bin") + 1).alias("end_bin"), F.count("*").alias("bins")).filter(F.col("bins") >= least).drop("run")


def capability(df: DataFrame, group: str, status: str = "status") -> DataFrame:
    """always (from 0.99 of the rows), mostly (from 0.5), sometimes (over 0), not observable (if that is the most
    frequent status), else never supplied."""
    counts = df.groupBy(group, status).agg(F.count("*").alias("n"))
    agg = counts.groupBy(group).agg(
        F.sum("n").alias("rows"), F.sum(F.when(contributes(F.col(status)), F.col("n")).otherwise(0)).alias("good"), F.max_by(status, F.struct("n", (-F.col(status)).alias("s"))).alias("modal")
    )
    share = F.col("good") / F.col("rows")
    word = F.when(share >= 0.99, "always").when(share >= 0.5, "mostly").when(share > 0, "sometimes").when(F.col("modal") == 4, "not observable").otherwise("never supplied")
    return agg.select(group, "rows", share.alias("share"), word.alias("capability"))


def visibility(df: DataFrame, group: str, bad: str, levels: dict[str, str]) -> DataFrame:
    """Among rows where `bad` holds: the share with a contributing value of each level (name: status column)."""
    return df.filter(bad).groupBy(group).agg(F.count("*").alias("n"), *(F.avg(contributes(F.col(c)).cast("double")).alias(name) for name, c in levels.items()))


def ordering(df: DataFrame, source: str, time: str, watermark: str) -> DataFrame:
    """Share of rows behind the watermark, least gap between distinct times, and share of rows that share a time."""
    late = df.groupBy(source).agg(F.avg(F.when(F.col(time).isNotNull() & F.col(watermark).isNotNull(), (F.col(time) < F.col(watermark)).cast("double"))).alias("late_share"), F.count(time).alias("n"))
    times = df.filter(F.col(time).isNotNull()).groupBy(source, time).count()
    gap = F.col(time) - F.lag(time).over(Window.partitionBy(source).orderBy(time))
    gaps = times.withColumn("gap", gap).groupBy(source).agg(F.min("gap").alias("resolution"), F.count("*").alias("distinct_times"))
    return late.join(gaps, source).select(source, "n", "late_share", "resolution", (1 - ratio(F.col("distinct_times"), F.col("n"))).alias("simultaneous"))


def patterns(df: DataFrame, statuses: list[str], top: int) -> DataFrame:
    """The most frequent combinations of statuses, as letters O S L N X; ties in the order of letters."""
    letters = F.array(*map(F.lit, "OSLNX"))
    word = F.concat(*(F.element_at(letters, F.col(c).cast("int") + 1) for c in statuses))
    counts = df.groupBy(word.alias("pattern")).agg(F.count("*").alias("n"))  # at most 5 ** len(statuses) rows
    return counts.orderBy(F.desc("n"), "pattern").limit(top)


def coabsence(df: DataFrame, statuses: dict[str, str]) -> DataFrame:
    """For each pair of columns: rows where both are absent, the Jaccard index and the phi coefficient of absence."""
    names = sorted(statuses)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    absent = {n: (~contributes(F.col(statuses[n]))).cast("long") for n in names}
    sums = df.agg(F.count("*").alias("n"), *(F.sum(absent[x]).alias(f"s_{x}") for x in names), *(F.sum(absent[a] * absent[b]).alias(f"c_{a}_{b}") for a, b in pairs))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"s_{a}").alias("sa"), F.col(f"s_{b}").alias("sb"), F.col(f"c_{a}_{b}").alias("n_both")) for a, b in pairs))
    out = sums.select("n", F.inline(rows))
    pa, pb, pab = F.col("sa") / F.col("n"), F.col("sb") / F.col("n"), F.col("n_both") / F.col("n")
    spread = F.sqrt(pa * (1 - pa) * pb * (1 - pb))
    return out.select("a", "b", "n_both", ratio(F.col("n_both"), F.col("sa") + F.col("sb") - F.col("n_both")).alias("jaccard"), ratio(pab - pa * pb, spread).alias("phi"))
