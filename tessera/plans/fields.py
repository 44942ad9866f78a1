"""Texts as logs write them, made of the events' numbers, and their conversion, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import convert
from tessera.functions.scalars import rounded
from tessera.sources.tables import UPDATES_SQL as U
from tessera.sources.tables import updates

NETWORKS = ["10.0.0.0/8", "192.168.40.0/22"]
#: The same in both SQL dialects.
TEXTS = {
    "port": "CAST(k * 997 AS VARCHAR(20))",
    "mac": "CASE WHEN k % 9 = 0 THEN 'none' ELSE concat('AA-BB-0', CAST(k % 10 AS VARCHAR(20)), '-00-11-FF') END",
    "hex": "CASE WHEN k % 6 = 0 THEN '0x0' WHEN k % 6 = 1 THEN 'g1' ELSE concat('0x', CAST(k AS VARCHAR(20)), 'f') END",
    "truth": "CASE k % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' ELSE 'maybe' END",
    "wait": "CASE k % 7 WHEN 0 THEN '-1.5' WHEN 1 THEN 'x' ELSE concat(CAST(k AS VARCHAR(20)), '.25') END",
    "address": "CASE k % 4 WHEN 0 THEN '0.0.0.0' WHEN 1 THEN concat('192.168.', CAST(k AS VARCHAR(20)), '.7') WHEN 2 THEN concat('10.1.300.', CAST(k AS VARCHAR(20))) ELSE concat('10.1.2.', CAST(k AS VARCHAR(20))) END",
}


def converted_fields(spark, sf):
    x = updates(spark, sf).select("seq", "k", *(F.expr(s.replace("VARCHAR(20)", "STRING")).alias(n) for n, s in TEXTS.items()))
    return x.select(
        "seq", convert.port(F.col("port")).cast("bigint").alias("port"), convert.mac(F.col("mac")).alias("mac"), convert.nonzero(convert.hexadecimal(F.col("hex"))).alias("hex"),
        convert.truth(F.col("truth")).cast("int").alias("truth"), rounded(convert.seconds(F.col("wait"), 0.001)).alias("wait"), convert.nonzero(convert.ipv4(F.col("address"))).alias("address"),
        convert.in_networks(F.col("address"), NETWORKS).cast("int").alias("internal"), convert.syn_count(F.col("k"), F.lit(1)).alias("syn"),
        convert.first_whole(F.split("port", "9")).alias("first"), convert.joined(F.split("address", r"\.")).alias("joined"), convert.trimmed(F.col("truth")).alias("word"),
    )


FIELDS = f"""WITH {U}, x AS (SELECT seq, k, {', '.join(f'{s} AS {n}' for n, s in TEXTS.items())} FROM u), y AS (SELECT *, string_split(address, '.')::BIGINT[] AS q FROM x),
z AS (SELECT *, CASE WHEN list_max(q) <= 255 THEN q[1] * 16777216 + q[2] * 65536 + q[3] * 256 + q[4] END AS a, string_split(port, '9')[1] AS head FROM y)
SELECT seq, CASE WHEN port::BIGINT <= 65535 THEN port::BIGINT END AS port, CASE WHEN mac <> 'none' THEN lower(replace(mac, '-', ':')) END AS mac, CASE WHEN k % 6 > 1 THEN hex::BIGINT END AS hex,
CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 END::INTEGER AS truth, CASE WHEN k % 7 > 1 THEN round(wait::DOUBLE * 0.001, 6) END AS wait, nullif(a, 0) AS address,
CASE WHEN a IS NOT NULL THEN (a BETWEEN 167772160 AND 184549375 OR a BETWEEN 3232245760 AND 3232246783)::INTEGER END AS internal, CASE WHEN (k & 2) <> 0 THEN 1 END::INTEGER AS syn,
CASE WHEN head <> '' THEN head::BIGINT END AS first, replace(address, '.', '/') AS joined, trim(truth) AS word FROM z"""

QUERIES = {"converted_fields": converted_fields}
ORACLE = {"converted_fields": FIELDS}
