"""Jump consistent hashing (Lamping and Veach, 2014) over DataFrame columns; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LCG = 2862933555777941757
RECORD_OVERHEAD = 16


def _unsigned(key: Column) -> Column:
    wide = key.cast("decimal(20,0)")
    return F.when(key < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def _step(key: Column) -> Column:
    """key * LCG + 1 modulo 2**64, in exact decimals (the product has at most 38 digits)."""
    product = key * F.lit(str(LCG)).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")
    return (product % F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")


def jump_hash(key: Column, shards: int) -> Column:
    """The shard 0..shards-1 of a BIGINT key. A null key counts as 0.

    When shards are appended, a key either stays or goes to a new shard. The candidate strictly grows, so that
    `shards` turns are enough; turns after the last jump leave the state as it is.
    """
    start = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("next"), _unsigned(F.coalesce(key, F.lit(0).cast("bigint"))).alias("key")
    )

    def turn(state: Column, _: Column) -> Column:
        key = _step(state["key"])
        high = F.floor(key / F.lit("8589934592").cast("decimal(10,0)")).cast("double")
        jumped = F.floor((state["next"] + 1).cast("double") * (F.lit(2147483648.0) / (high + 1.0)))
        moved = F.struct(state["next"].alias("at"), jumped.cast("bigint").alias("next"), key.alias("key"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    # the first turn always happens: `at` becomes 0 and `next` the first candidate
    first = _step(start["key"])
    high = F.floor(first / F.lit("8589934592").cast("decimal(10,0)")).cast("double")
    begun = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.floor(F.lit(2147483648.0) / (high + 1.0)).cast("bigint").alias("next"), first.alias("key")
    )
    if shards <= 1:
        return F.lit(0)
    return F.aggregate(F.sequence(F.lit(2), F.lit(shards)), begun, turn, lambda s: s["at"].cast("int"))


def shard_rows(
    df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", rows_per_task: int = 250_000, rows: int | None = None
) -> DataFrame:
    """Places every row by its key and numbers the rows of each shard.

    Adds size (UTF-8 bytes plus 16), text_crc32, law ('key'), shard, grown_shard (with one shard more) and slot
    (0, 1, ... within the shard, in the order of a mix of key and checksum, then key, checksum and size). The order
    is that of a fixed range of mixes, so that a shard is numbered by many tasks, each over one sub-range of about
    rows_per_task rows; neither many rows of one key nor many copies of one text share a sub-range.

    Nulls: a null key is placed as 0, a null text has no bytes. Rows equal in key and text take adjacent slots.
    An empty table gives an empty table. Only the columns named here are read or returned.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rowed = df.select(
        F.col(key).cast("bigint").alias("doc_id"), (F.octet_length(body) + RECORD_OVERHEAD).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32")
    )
    high = F.floor(_step(_unsigned(F.coalesce(F.col("doc_id"), F.lit(0).cast("bigint")))) / F.lit("4294967296").cast("decimal(10,0)")).cast("bigint")
    placed = rowed.withColumns(
        {"shard": jump_hash(F.col("doc_id"), shards), "grown_shard": jump_hash(F.col("doc_id"), shards + 1), "mix": high.bitwiseXOR(F.col("text_crc32"))}
    )
    pieces = max(1, -(-(df.count() if rows is None else rows) // (shards * rows_per_task)))
    placed = placed.withColumn("piece", F.floor(F.col("mix") * pieces / F.lit(4294967296)).cast("int"))
    from pyspark.sql import Window

    within = Window.partitionBy("shard", "piece").orderBy(F.col("mix"), F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size"))
    counts = placed.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = placed.withColumn("rank", F.row_number().over(within) - 1)
    if pieces > 1:
        numbered = numbered.join(offsets, ["shard", "piece"])
    else:
        numbered = numbered.withColumn("offset", F.lit(0))
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("rank") + F.col("offset")).cast("bigint").alias("slot"), "grown_shard"
    )
