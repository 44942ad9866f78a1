"""Parquet tables, and the events table in the form of state updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import micros
from tessera.functions.status import present


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def updates(spark: SparkSession, folder: str) -> DataFrame:
    """seq, us (event time), entity, kind, k (a count from props), status and value (NULL where excluded).

    The events have no absent values, so that absence is derived: k modulo 20 decides the status."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    turn = F.pmod(F.col("k"), F.lit(20))
    status = F.when(turn == 0, 3).when(turn == 1, 4).when(turn == 2, 1).when(turn == 3, 2).otherwise(0)
    rows = table(spark, folder, "events").select(
        F.col("event_id").alias("seq"), micros("ts").alias("us"), F.col("user_id").alias("entity"), F.col("event_type").alias("kind"), k.alias("k"), F.col("value").alias("raw")
    )
    return rows.withColumn("status", status).withColumn("value", present(F.col("raw"), F.col("status"))).drop("raw")


#: The same rows in SQL, as the first part of a WITH.
UPDATES_SQL = """u AS (
  SELECT seq, us, entity, kind, k, status, CASE WHEN status < 3 THEN raw END AS value FROM (
    SELECT event_id AS seq, epoch_us(ts) AS us, user_id AS entity, event_type AS kind, k, value AS raw,
      CASE k % 20 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS status
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)))"""
