"""Exact duplicates, conflicts of labels among them, and near-duplicate rows of mixed columns."""

from __future__ import annotations

import functools
import itertools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import slog1p
from tessera.operators.graph import components
from tessera.sources.stored import stored


def duplicate_groups(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Groups of two or more rows equal in all columns (null equals null): size and the smallest key."""
    return df.groupBy(*columns).agg(F.count("*").alias("size"), F.min(key).alias("representative")).filter("size > 1")


def duplicate_summary(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    g = duplicate_groups(df, columns, key)
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum("size"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("redundant"), F.max("size").alias("largest"))


def keep_first(df: DataFrame, digest: str, order: str, never: str | None = None) -> DataFrame:
    """The first row of each digest in the given order; rows whose digest is null or equals `never` all stay."""
    free = F.col(digest).isNull() if never is None else F.col(digest).isNull() | (F.col(digest) == never)
    first = df.filter(~free).groupBy(digest).agg(F.min(order).alias("__first"))
    return df.join(first, digest, "left").filter(free | (F.col(order) == F.col("__first"))).select(*df.columns)


def label_conflicts(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Over groups of equal rows with two or more different known labels: groups, rows with known labels in them, and
    the least share of all known rows that any rule must get wrong."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(*columns, label).agg(F.count("*").alias("n"))
    groups = counts.groupBy(*columns).agg(F.count("*").alias("labels"), F.sum("n").alias("size"), F.max("n").alias("top"))
    bad = F.col("labels") > 1
    return groups.agg(F.sum(bad.cast("long")).alias("groups"), F.sum(F.when(bad, F.col("size")).otherwise(0)).alias("rows"), (F.sum(F.when(bad, F.col("size") - F.col("top")).otherwise(0)) / F.sum("size")).alias("error_floor"))


def band_keys(numeric: list[str], categories: list[str], tolerance: float, bands: int, rows: int, seed: int = 0) -> Column:
    """An array of bucket keys. Each band takes `rows` columns by a seeded choice; a number falls into a cell of twice the
    tolerance, shifted by a seeded offset, so that near numbers often share it."""
    import random

    names = [*numeric, *categories]
    keys = []
    for b in range(bands):
        rng = random.Random(seed * 1_000_003 + b)
        chosen = [rng.choice(names) for _ in range(rows)]
        parts = []
        for c in sorted(set(chosen)):
            shift = rng.random()
            if c in numeric:
                parts.append(F.coalesce(F.floor(slog1p(F.col(c).cast("double")) / (2 * tolerance) + shift), F.lit(-(1 << 60))))
            else:
                parts.append(F.coalesce(F.col(c).cast("string"), F.lit("")))
        keys.append(F.xxhash64(F.lit(b), *parts))
    return F.array(*keys)


def similarity(numeric: list[str], categories: list[str], tolerance: float, a: str = "a", b: str = "b") -> Column:
    """Share of the columns in which two structs agree: both absent, equal, or numbers whose slog1p differ by at most the
    tolerance."""
    same = [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in categories]
    for c in numeric:
        x, y = F.col(f"{a}.{c}").cast("double"), F.col(f"{b}.{c}").cast("double")
        same.append(F.coalesce(F.abs(slog1p(x) - slog1p(y)) <= tolerance, x.isNull() & y.isNull()))
    return sum((s.cast("int") for s in same[1:]), same[0].cast("int")) / len(same)


def agreement_keys(numeric: list[str], categories: list[str], tolerance: float, least: float, spread: int = 3) -> Column:
    """An array of keys of which any two similar rows share one. Rows that differ in d columns at most agree in a whole one
    of d + 1 groups of columns; two numbers within the tolerance share a cell of twice the tolerance in one of two grids
    that lie half a cell apart. Of each group, all categories and up to `spread` numbers make the key."""
    names = [*categories, *numeric]
    groups = len(names) - math.ceil(least * len(names) - 1e-9) + 1
    keys = []
    for g in range(groups):
        own = names[g::groups]
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in own if c in categories]
        for grids in itertools.product((0.0, 0.5), repeat=min(spread, sum(c in numeric for c in own))):
            cells = [F.coalesce(F.floor(slog1p(F.col(c).cast("double")) / (2.000001 * tolerance) + shift), F.lit(-(1 << 60))) for c, shift in zip((c for c in own if c in numeric), grids)]
            keys.append(F.xxhash64(F.lit(g), F.lit(str(grids)), *parts, *cells))
    return F.array(*keys)


def near_duplicate_rows(
    df: DataFrame, key: str, numeric: list[str], categories: list[str], tolerance: float = 0.05, least: float = 0.95, bands: int = 24, rows: int = 8, most: int = 64, pivots: int = 4
) -> DataFrame:
    """Pairs (a, b) of keys, a < b, of distinct rows that are similar in `least` of the columns or more. Equal rows are
    one, under their smallest key. In a bucket of up to `most` rows all are compared. In a larger one each row is compared
    with `pivots` rows of the bucket, chosen by seeded hashes, and with the least row of its cell; then whatever is still
    in different components is compared in full where it can be similar (agreement_keys), and each row gets a pair for
    each other component that it is similar to. So not every pair of a large bucket comes out, but its components are those
    of all similar pairs (near_duplicate_groups)."""
    names = [*numeric, *categories]
    reps = stored(df.groupBy(*names).agg(F.min(key).alias(key)), "near-rows")
    placed = reps.select(F.struct(key, *names).alias("r"), F.explode(band_keys(numeric, categories, tolerance, bands, rows)).alias("bucket"))
    chosen = F.array_distinct(F.array(*(F.min_by("r", F.xxhash64(F.col(f"r.{key}"), F.lit(i))) for i in range(pivots))))
    buckets = placed.groupBy("bucket").agg(F.count("*").alias("n"), chosen.alias("pivots")).filter("n > 1")
    a = placed.select("bucket", F.col("r").alias("a"))
    small = buckets.filter(F.col("n") <= most).select("bucket")
    # joins are shuffled: a table of buckets or rows that is sent around is a map in the driver's memory, and grows with the input
    within = a.join(small.hint("merge"), "bucket").join(placed.select("bucket", F.col("r").alias("b")).hint("merge"), "bucket")
    across = a.join(buckets.filter(F.col("n") > most).select("bucket", F.explode("pivots").alias("b")).hint("merge"), "bucket")
    ka, kb = F.col(f"a.{key}"), F.col(f"b.{key}")
    r = F.struct(key, *names)
    cells = [F.floor(slog1p(F.col(c).cast("double")) / tolerance) for c in numeric]
    mates = reps.groupBy(*categories, *(c.alias(f"__cell{i}") for i, c in enumerate(cells))).agg(F.min_by(r, key).alias("b"))
    beside = reps.alias("x").join(mates.alias("m").hint("merge"), functools.reduce(operator.and_, [F.col(f"x.{c}").eqNullSafe(F.col(f"m.{c}")) for c in categories] + [F.floor(slog1p(F.col(f"x.{c}").cast("double")) / tolerance).eqNullSafe(F.col(f"m.__cell{i}")) for i, c in enumerate(numeric)]))
    beside = beside.select(F.lit(0).cast("long").alias("bucket"), F.struct(*(F.col(f"x.{c}").alias(c) for c in [key, *names])).alias("a"), "b")
    pairs = within.filter(ka < kb).unionByName(across.filter(ka != kb)).unionByName(beside.filter(ka != kb))
    good = pairs.filter(similarity(numeric, categories, tolerance) >= least - 1e-12)
    links = stored(good.select(F.least(ka, kb).alias("a"), F.greatest(ka, kb).alias("b")).distinct(), "near-links")

    # rows of large buckets whose components aren't one yet
    large = buckets.filter(F.col("n") > most).select("bucket")
    held = a.join(large.hint("merge"), "bucket").select("a.*").distinct()
    labels = components(links).withColumnRenamed("v", key)
    held = stored(held.join(labels.hint("merge"), key, "left").withColumn("component", F.coalesce("component", key)), "near-held")
    keyed = held.select(r.alias("r"), "component", F.explode(agreement_keys(numeric, categories, tolerance, least)).alias("cell"))
    sizes = keyed.groupBy("cell", "component").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("cell").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    # every pair across components has an end outside the largest one; large cells are dealt over salts
    sizes = sizes.filter("parts > 1").select("cell", "main", F.ceil(F.col("n") / 1000).cast("int").alias("salts"))
    keyed = keyed.join(stored(sizes, "near-cells").hint("merge"), "cell")
    outer = keyed.filter("component <> main").select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("r").alias("a"), F.col("component").alias("ca"))
    inner = keyed.select("cell", F.pmod(F.xxhash64(f"r.{key}"), F.col("salts")).cast("int").alias("salt"), F.col("r").alias("b"), F.col("component").alias("cb"))
    apart = outer.join(inner.hint("merge"), ["cell", "salt"]).filter("ca <> cb").filter(similarity(numeric, categories, tolerance) >= least - 1e-12)
    more = apart.groupBy(ka.alias("ka"), "cb").agg(F.min(kb).alias("kb"))
    return links.union(more.select(F.least("ka", "kb"), F.greatest("ka", "kb"))).distinct()


def near_duplicate_groups(df: DataFrame, key: str, numeric: list[str], categories: list[str], **how) -> DataFrame:
    """(key, component) of every row that near_duplicate_rows links; the component is its smallest key."""
    return components(near_duplicate_rows(df, key, numeric, categories, **how)).withColumnRenamed("v", key)
