"""Queries of changed tables, balances, queues and ranked classes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalars import rounded
from tessera.operators import perturb as pb
from tessera.sources.tables import UPDATES_SQL as U
from tessera.sources.tables import table, updates


def _r(df, keep, *names):
    return df.select(*keep, *(rounded(F.col(n)).alias(n) for n in names))


def _hash(seed, key="seq"):
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296)"


def thinned_updates(spark, sf):
    return pb.thinned(updates(spark, sf), "seq", 0.3, 5).groupBy("kind").agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))


THINNED = f"WITH {U} SELECT kind, count(*) AS n, min(seq) AS lo, max(seq) AS hi FROM u WHERE {_hash(5)} < 0.3 GROUP BY kind"


def masked_updates(spark, sf):
    return pb.masked(updates(spark, sf), "seq", "value", "status", 0.2, 6).select("seq", "status", rounded(F.col("value")).alias("value"))


MASKED = f"WITH {U} SELECT seq, CASE WHEN {_hash(6)} < 0.2 THEN 3 ELSE status END AS status, CASE WHEN {_hash(6)} >= 0.2 THEN round(value, 6) END AS value FROM u"


def unobservable_regime(spark, sf):
    return pb.unobservable(updates(spark, sf), "kind = 'error'", "value", "status").groupBy("kind", "status").agg(F.count("*").alias("n"), F.count("value").alias("present"))


REGIME = f"WITH {U}, r AS (SELECT kind, CASE WHEN kind = 'error' THEN 4 ELSE status END AS status, CASE WHEN kind <> 'error' THEN value END AS value FROM u) SELECT kind, status, count(*) AS n, count(value) AS present FROM r GROUP BY 1, 2"


def jittered_updates(spark, sf):
    return pb.jittered(updates(spark, sf), "seq", "us", 1_000_000, 7).select("seq", "us")


JITTERED = f"WITH {U} SELECT seq, us + floor((2 * {_hash(7)} - 1) * 1000000)::BIGINT AS us FROM u"


def repeated_updates(spark, sf):
    return pb.repeated(updates(spark, sf), "seq", 0.1, 8).groupBy("kind", "copy").agg(F.count("*").alias("n"))


REPEATED = f"WITH {U}, c AS (SELECT kind, unnest(CASE WHEN {_hash(8)} < 0.1 THEN [0, 1] ELSE [0] END)::INTEGER AS copy FROM u) SELECT kind, copy, count(*) AS n FROM c GROUP BY 1, 2"


def node_balance(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    return _r(pb.node_balance(li, "l_suppkey", "l_partkey", "l_quantity"), ["v"], "into", "out", "balance")


BALANCE = """WITH l AS (SELECT l_suppkey AS v, l_quantity AS o, 0 AS i FROM lineitem UNION ALL SELECT l_partkey, 0, l_quantity FROM lineitem) SELECT v, sum(i)::DOUBLE AS "into", sum(o)::DOUBLE AS "out", sum(i) - sum(o) AS balance FROM l GROUP BY v"""


def queue_statistics(spark, sf):
    """Orders as stays of 1 to 30 days, in 1997, with days as the unit."""
    o = table(spark, sf, "orders").select("o_orderpriority", F.expr("datediff(o_orderdate, DATE'1970-01-01')").alias("a"), (F.expr("datediff(o_orderdate, DATE'1970-01-01')") + 1 + F.col("o_custkey") % 30).alias("d"))
    return _r(pb.queue_statistics(o, ["o_orderpriority"], "a", "d", 9862, 10227), ["o_orderpriority"], "present", "rate", "stay", "edge")


QUEUE = """WITH o AS (SELECT o_orderpriority, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS a, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 1 + o_custkey % 30 AS d FROM orders),
s AS (SELECT o_orderpriority, sum(greatest(0, least(d, 10227) - greatest(a, 9862))) / 365.0::DOUBLE AS p, sum((a >= 9862 AND a < 10227)::INT) / 365.0::DOUBLE AS r, avg(d - a) FILTER (a >= 9862 AND a < 10227) AS w FROM o GROUP BY 1)
SELECT o_orderpriority, round(p, 6) AS present, round(r, 6) AS rate, round(w, 6) AS stay, round(p - r * coalesce(w, 0), 6) AS edge FROM s"""


def top_k_credit(spark, sf):
    """Five class chances made of the count k, with ties."""
    u = updates(spark, sf).select("kind", F.array(*((F.pmod(F.floor(F.col("k") / (i + 1)), F.lit(4)) / 10.0) for i in range(5))).alias("p"), (F.col("seq") % 5).cast("int").alias("y"))
    out = pb.top_k_credit(u, "p", "y", 2)
    return out.groupBy("kind").agg(rounded(F.avg("credit")).alias("credit"), rounded(F.avg("brier")).alias("brier"))


TOP_K_CREDIT = f"""WITH {U}, p AS (SELECT kind, [{', '.join(f'((k // {i + 1}) % 4) / 10' for i in range(5))}] AS p, (seq % 5)::INT AS y FROM u), c AS (SELECT kind, p, p[y + 1] AS x FROM p)
SELECT kind, round(avg(greatest(0, least(1, (2 - len(list_filter(p, lambda q: q > x))) / len(list_filter(p, lambda q: q = x))))), 6) AS credit, round(avg(list_sum(list_transform(p, lambda q: q * q)) - 2 * x + 1), 6) AS brier FROM c GROUP BY kind"""

QUERIES = {f.__name__: f for f in (thinned_updates, masked_updates, unobservable_regime, jittered_updates, repeated_updates, node_balance, queue_statistics, top_k_credit)}
ORACLE = {
    "thinned_updates": THINNED, "masked_updates": MASKED, "unobservable_regime": REGIME, "jittered_updates": JITTERED, "repeated_updates": REPEATED, "node_balance": BALANCE, "queue_statistics": QUEUE,
    "top_k_credit": TOP_K_CREDIT,
}
