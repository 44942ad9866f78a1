"""Raw labels mapped by a table, with what isn't known kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(label: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(label.cast("string")), "[^a-z0-9]+", "")


def mapped_labels(df: DataFrame, label: str, mapping: DataFrame) -> DataFrame:
    """df with the columns of `mapping` (one row for each `raw` label) and `mapped`. A null label is mapped to nulls (no
    statement); one that the mapping doesn't know has mapped = false and is never taken for a harmless one. Raw labels that
    normalise alike have to say the same. The mapping is a small table by nature, so that Spark may broadcast it."""
    known = mapping.withColumn("__raw", normalised(F.col("raw"))).drop("raw").distinct()
    if twice := [r[0] for r in known.groupBy("__raw").count().filter("count > 1").limit(20).collect()]:
        raise ValueError(f"labels that are mapped in two ways: {sorted(twice)}")
    out = df.withColumn("__raw", normalised(F.col(label))).join(known.withColumn("__known", F.lit(True)), "__raw", "left")
    return out.withColumn("mapped", F.coalesce("__known", F.col(label).isNull())).drop("__raw", "__known")
