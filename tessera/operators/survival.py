"""Time to event with censoring, and tests of differences, from counts by distinct time or value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import ratio
from tessera.operators.dominance import dominance
from tessera.operators.ranks import running_totals, value_ranks
from tessera.operators.splits import hash_order


def kaplan_meier(df: DataFrame, time: str, event: str, by: list[str]) -> DataFrame:
    """One row for each distinct time with an event: at risk, events, and the survival after it. Rows at risk are those
    with a time not earlier; a hazard of 1 gives 0. Times per group are few beside rows (one row each here)."""
    counts = df.filter(F.col(time).isNotNull()).groupBy(*by, time).agg(F.sum(F.col(event).cast("bigint")).alias("events"), F.count("*").alias("n"))
    run = running_totals(counts, time, ["n"], by).withColumn("at_risk", F.col("total_n") - F.col("cum_n") + F.col("n"))
    steps = run.filter("events > 0").withColumn("keep", 1 - F.col("events") / F.col("at_risk"))
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    alive = F.when(F.min("keep").over(w) > 0, F.exp(F.sum(F.when(F.col("keep") > 0, F.log("keep")).otherwise(0.0)).over(w))).otherwise(0.0)
    return steps.select(*by, time, "at_risk", "events", alive.alias("survival"))


def concordance(df: DataFrame, risk: str, time: str, event: str, by: list[str]) -> DataFrame:
    """Harrell's C: among pairs whose earlier time is an event, how often the earlier one has the larger risk (ties of risk
    count half; NULL without a pair). Pairs are never made, and risks may be as many as rows (see operators/dominance)."""
    d = dominance(df.filter(F.col(event).isNotNull()), by, time, risk, {"p": (F.col(event).cast("int"), F.lit(1))})
    right = F.col("p_all") - F.col("p_less") - F.col("p_tie") / 2
    return d.select(*by, F.col("p_all").cast("bigint").alias("comparable"), ratio(right, F.col("p_all")).alias("c"))


def risk_sets(df: DataFrame, step: str, event: str, most: int) -> DataFrame:
    """Person-periods: one row for each step 1..min(step, most) of each row, y is 1 in the last one if the event is there."""
    upto = F.least(F.col(step), F.lit(most))
    out = df.filter(upto >= 1).withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), upto.cast("bigint"))))
    return out.withColumn("y", ((F.col("k") == F.col(step)) & F.col(event)).cast("int"))


def life_table(df: DataFrame, step: str, event: str, by: list[str], most: int) -> DataFrame:
    """Hazard and cumulative incidence by step."""
    h = risk_sets(df, step, event, most).groupBy(*by, "k").agg(F.count("*").alias("at_risk"), F.sum("y").alias("events"))
    w = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    hazard = F.col("events") / F.col("at_risk")
    h = h.withColumn("hazard", hazard)
    alive = F.when(F.max("hazard").over(w) < 1, F.exp(F.sum(F.when(F.col("hazard") < 1, F.log1p(-F.col("hazard"))).otherwise(0.0)).over(w))).otherwise(0.0)
    return h.withColumn("incidence", 1 - alive)


def wilcoxon(df: DataFrame, difference: str, by: list[str]) -> DataFrame:
    """Signed-rank sums of non-zero differences (mid-ranks of their sizes), and the normal score with the tie correction."""
    rows = df.filter(F.col(difference).isNotNull() & (F.col(difference) != 0)).withColumn("__a", F.abs(difference))
    ranks = value_ranks(rows, "__a", by)
    signs = rows.groupBy(*by, "__a").agg(F.sum((F.col(difference) > 0).cast("bigint")).alias("up"), F.count("*").alias("k"))
    j = signs.join(ranks.select(*by, "__a", "midrank"), [*by, "__a"])
    k = F.col("k").cast("double")
    s = j.groupBy(*by).agg(F.sum("k").alias("n"), F.sum(F.col("up") * F.col("midrank")).alias("w_plus"), F.sum((F.col("k") - F.col("up")) * F.col("midrank")).alias("w_minus"), F.sum(k**3 - k).alias("ties"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    return s.select(*by, "n", "w_plus", "w_minus", ratio(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(var)).alias("z"))


def mcnemar(df: DataFrame, a: Column, b: Column, by: list[str]) -> DataFrame:
    """Rows that only one of two decisions gets right, and the statistic with continuity correction."""
    s = df.groupBy(*by).agg(F.sum((a & ~b).cast("bigint")).alias("only_a"), F.sum((~a & b).cast("bigint")).alias("only_b"))
    n = F.col("only_a") + F.col("only_b")
    return s.withColumn("chi2", ratio((F.abs(F.col("only_a") - F.col("only_b")) - 1.0) ** 2, n))


def cliffs_delta(df: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """P(x > y) - P(x < y) between rows where `group` is true and the others, by running totals; no pairs are made."""
    g = F.col(group).cast("bigint")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(g).alias("x"), F.sum(1 - g).alias("y"))
    run = running_totals(counts, value, ["x", "y"], by)
    below, above = F.col("cum_y") - F.col("y"), F.col("total_y") - F.col("cum_y")
    return run.groupBy(*by).agg(ratio(F.sum(F.col("x") * (below - above)).cast("double"), F.max("total_x").cast("double") * F.max("total_y")).alias("delta"))


def block_ranks(df: DataFrame, block: str, model: str, score: str) -> DataFrame:
    """Mean rank of each model over blocks (ties share ranks, the largest score is first)."""
    w = Window.partitionBy(block)
    up, same = F.rank().over(w.orderBy(F.desc(score))), F.count("*").over(Window.partitionBy(block, score))
    return df.withColumn("r", up + (same - 1) / 2).groupBy(model).agg(F.count("*").alias("blocks"), F.avg("r").alias("mean_rank"))


def bootstrap(df: DataFrame, key: str, value: str, by: list[str], replicates: int, seed: int = 0) -> DataFrame:
    """Poisson bootstrap of a mean, one row for each group and replicate. A row's weights come from hashes of its key, four of
    them from one hash, so that they don't depend on partitions. All replicates are sums of one aggregate over rows that are
    read once and neither multiplied nor shuffled."""
    cut, p, total = [], 0.36787944117144233, 0.0
    for k in range(1, 9):
        total += p
        cut.append(total)
        p /= k
    hashes = {f"__h{i}": F.md5(F.concat(F.lit(f"{seed}:{i}:"), F.col(key).cast("string")).cast("binary")) for i in range(-(-replicates // 4))}
    sums = []
    for r in range(replicates):
        u = F.conv(F.substring(f"__h{r // 4}", r % 4 * 8 + 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
        w = sum(((u >= c).cast("int") for c in cut[1:]), (u >= cut[0]).cast("int"))
        sums += [F.sum(w * F.col(value)).alias(f"__s{r}"), F.sum(w).alias(f"__w{r}")]
    s = df.filter(F.col(value).isNotNull()).withColumns(hashes).groupBy(*by).agg(*sums)
    means = F.array(*(ratio(F.col(f"__s{r}"), F.col(f"__w{r}").cast("double")) for r in range(replicates)))
    return s.select(*by, F.posexplode(means).alias("replicate", "mean"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Per class: support, precision, recall and F1 (NULL without a denominator)."""
    c = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    own = c.groupBy("y").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    said = c.groupBy(F.col("p").alias("y")).agg(F.sum("n").alias("said"))
    j = own.join(said, "y", "left").fillna(0, ["said"])
    return j.select("y", "support", ratio(F.col("tp"), F.col("said")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("support") + F.col("said")).alias("f1"))


def restricted_mean(df: DataFrame, time: str, event: str, by: list[str], tau: float) -> DataFrame:
    """The area under each group's Kaplan-Meier curve up to tau; tau where no event comes earlier. A null key is a group."""
    keyed = df.filter(F.col(time).isNotNull()).withColumn("__g", F.struct(*by))
    curve = kaplan_meier(keyed, time, event, ["__g"]).filter(F.col(time) <= tau)
    until = F.lead(time, 1, tau).over(Window.partitionBy("__g").orderBy(time))
    area = curve.withColumn("__w", F.col("survival") * (until - F.col(time))).groupBy("__g").agg((F.sum("__w") + F.min(time)).alias("rmst"))
    out = keyed.select("__g").distinct().join(area, "__g", "left")
    return out.select(*(F.col(f"__g.{c}").alias(c) for c in by), F.coalesce("rmst", F.lit(float(tau))).alias("rmst"))


def sign_flips(df: DataFrame, difference: str, key: str, by: list[str], seed: int = 0, flips: int = 60) -> DataFrame:
    """A paired permutation test by group: n, the mean difference, and p, the share of `flips` (60 at most) random choices
    of signs, the real one included, whose mean is as far from 0. Each row's signs are bits of one hash of its key, so
    that all choices are sums of one aggregate, and rows are neither multiplied nor sorted."""
    bits = F.conv(F.substring(hash_order(F.col(key), seed), 1, 15), 16, 10).cast("bigint")
    d = F.col(difference).cast("double")
    rows = df.filter(d.isNotNull()).withColumns({"__bits": bits, "__d": d})
    sums = [F.sum(F.when(F.shiftright("__bits", r).bitwiseAND(F.lit(1)) == 1, -F.col("__d")).otherwise(F.col("__d"))).alias(f"__s{r}") for r in range(flips)]
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("__d").alias("__t"), *sums)
    as_far = sum(((F.abs(f"__s{r}") >= F.abs("__t") - 1e-9).cast("int") for r in range(1, flips)), (F.abs("__s0") >= F.abs("__t") - 1e-9).cast("int"))
    return out.select(*by, "n", (F.col("__t") / F.col("n")).alias("mean"), ((as_far + 1) / F.lit(flips + 1)).alias("p"))
