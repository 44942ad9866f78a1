"""Queries of joins, duplicates, windows and splits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalars import micros, rounded
from tessera.operators import dedup, joins, splits, windows
from tessera.sources.tables import UPDATES_SQL as U
from tessera.sources.tables import table, updates

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000


def _r(df, keep, *names):
    return df.select(*keep, *(rounded(F.col(n)).alias(n) for n in names))


def entity_latest_asof(spark, sf):
    """For each purchase, the latest click of the same user up to then."""
    u = updates(spark, sf)
    clicks = u.filter("kind = 'click'").select("entity", F.col("us").alias("click_us"), F.col("seq").alias("click_seq"), "k")
    out = joins.asof(u.filter("kind = 'purchase'").select("seq", "entity", "us"), clicks, ["entity"], "us", "click_us", ["click_us", "click_seq", "k"])
    return out.select("seq", "entity", "click_seq", "k", (F.col("us") - F.col("click_us")).alias("age"))


def entity_latest_asof_periods(spark, sf):
    """The same, with each user's time cut into days."""
    u = updates(spark, sf)
    clicks = u.filter("kind = 'click'").select("entity", F.col("us").alias("click_us"), F.col("us").alias("click_at"), F.col("seq").alias("click_seq"), "k")
    out = joins.asof_periods(u.filter("kind = 'purchase'").select("seq", "entity", "us"), clicks, ["entity"], "us", "click_us", ["click_at", "click_seq", "k"], DAY)
    return out.select("seq", "entity", "click_seq", "k", (F.col("us") - F.col("click_at")).alias("age"))


ASOF = f"""WITH {U} SELECT p.seq, p.entity, c.seq AS click_seq, c.k, p.us - c.us AS age FROM (SELECT * FROM u WHERE kind = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM u WHERE kind = 'click') c ON p.entity = c.entity AND p.us >= c.us"""


def _episodes(spark, sf):
    """Orders as episodes: from the order date, 30 days long, keyed by customer."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("episode"), F.col("o_custkey").alias("entity"), micros("o_orderdate").alias("start"))
    return o.withColumn("completion", F.col("start") + 30 * DAY)


def _scored(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("entity"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), micros("l_shipdate").alias("time"), F.col("l_quantity").alias("score"))
    return li.join(o, "o_orderkey").select("entity", "time", "score")


def episode_lead_time(spark, sf):
    return joins.first_alerts(_episodes(spark, sf), _scored(spark, sf), ["entity"], 60 * DAY, 10 * DAY, 40.0, 90 * DAY)


EPISODES = f"""e AS (SELECT o_orderkey AS episode, o_custkey AS entity, epoch_us(o_orderdate) AS start, epoch_us(o_orderdate) + {30 * DAY} AS completion FROM orders),
x AS (SELECT o_custkey AS entity, epoch_us(l_shipdate) AS time, l_quantity AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
EPISODE_LEAD_TIME = f"""WITH {EPISODES}, m AS (SELECT episode, min(time) AS alert FROM e JOIN x ON e.entity = x.entity AND time BETWEEN completion - {60 * DAY} AND completion + {10 * DAY} AND score >= 40 GROUP BY episode)
SELECT episode, start, completion, alert, coalesce(alert >= start, false) AS detected, completion - alert AS lead FROM e LEFT JOIN m USING (episode)"""


def episode_assignment(spark, sf):
    """Scored units inside an episode of their customer, with the one that completes first."""
    met = joins.interval(_scored(spark, sf), _episodes(spark, sf), ["entity"], "time", "start", "completion", 90 * DAY)
    return met.groupBy("entity", "time").agg(F.min_by("episode", F.struct("completion", "episode")).alias("episode"), F.count("*").alias("n"))


EPISODE_ASSIGNMENT = f"""WITH {EPISODES} SELECT x.entity, time, arg_min(episode, (completion, episode)) AS episode, count(*) AS n FROM x JOIN e ON e.entity = x.entity AND time BETWEEN start AND completion GROUP BY 1, 2"""


def _shipping(spark, sf, flag):
    li = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == flag)
    return li.select("l_suppkey", micros("l_shipdate").alias("start"), (micros("l_shipdate") + DAY * F.col("l_linenumber")).alias("end"))


def interval_union(spark, sf):
    return joins.merged_intervals(_shipping(spark, sf, "A"), ["l_suppkey"], "start", "end").select("l_suppkey", "start", F.col("end").alias("stop"))


def _union_sql(flag, name):
    return f"""{name}0 AS (SELECT l_suppkey, epoch_us(l_shipdate) AS a, epoch_us(l_shipdate) + {DAY} * l_linenumber AS b FROM lineitem WHERE l_returnflag = '{flag}'),
{name}1 AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS w FROM {name}0),
{name}2 AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM {name}1), {name} AS (SELECT l_suppkey, min(a) AS a, max(b) AS b FROM {name}2 GROUP BY l_suppkey, i)"""


INTERVAL_UNION = f"WITH {_union_sql('A', 'p')} SELECT l_suppkey, a AS start, b AS stop FROM p"


def temporal_overlap(spark, sf):
    return joins.overlap_length(_shipping(spark, sf, "A"), _shipping(spark, sf, "R"), ["l_suppkey"], "start", "end")


TEMPORAL_OVERLAP = f"""WITH {_union_sql('A', 'p')}, {_union_sql('R', 'q')} SELECT l_suppkey, coalesce(sum(greatest(0, least(p.b, q.b) - greatest(p.a, q.a))), 0)::BIGINT AS overlap FROM p JOIN q USING (l_suppkey) GROUP BY 1"""


def _parts(spark, sf):
    """Line items split by ship date: before 1999 training, then evaluation, from 2001 test."""
    year = F.year("l_shipdate")
    return table(spark, sf, "lineitem").withColumn("split", F.when(year < 1999, "train").when(year < 2001, "val").otherwise("test"))


PARTS = "p AS (SELECT *, CASE WHEN year(l_shipdate) < 1999 THEN 'train' WHEN year(l_shipdate) < 2001 THEN 'val' ELSE 'test' END AS split FROM lineitem)"


def shared_units(spark, sf):
    return joins.shared_units(_parts(spark, sf), "split", ["l_orderkey", "l_partkey", "l_suppkey"])


SHARED_UNITS = f"""WITH {PARTS}, n AS (SELECT split, unnest(['l_orderkey', 'l_partkey', 'l_suppkey']) AS unit, unnest([l_orderkey, l_partkey, l_suppkey]) AS key FROM p),
k AS (SELECT unit, key, count(DISTINCT split) AS s, count(*) AS n FROM n GROUP BY 1, 2)
SELECT unit, count(*) AS keys, sum((s > 1)::INT)::BIGINT AS shared_keys, sum(CASE WHEN s > 1 THEN n ELSE 0 END)::BIGINT AS shared_rows FROM k GROUP BY unit"""


def seen_units(spark, sf):
    return _r(joins.seen_share(_parts(spark, sf), "split", "train", "l_orderkey"), ["split", "keys"], "seen")


SEEN_UNITS = f"""WITH {PARTS}, k AS (SELECT DISTINCT split, l_orderkey FROM p)
SELECT split, count(*) AS keys, round(avg((l_orderkey IN (SELECT l_orderkey FROM k WHERE split = 'train'))::INT), 6) AS seen FROM k WHERE split <> 'train' GROUP BY split"""


def cross_split_duplicates(spark, sf):
    return joins.cross_split_duplicates(_parts(spark, sf), "split", "train", ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber"])


CROSS = f"""WITH {PARTS}, t AS (SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_linenumber FROM p WHERE split = 'train')
SELECT split, count(*) AS n, count(t.l_quantity) AS duplicates FROM p LEFT JOIN t USING (l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_linenumber) WHERE split <> 'train' GROUP BY split"""


def table_difference(spark, sf):
    """Orders against themselves with some values changed and some rows left out."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    b = o.filter("o_orderkey % 97 <> 1").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    b = b.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 75 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")))
    return joins.compared(o, b, "o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice"])


TABLE_DIFFERENCE = """SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 1 THEN 'only left' WHEN o_orderkey % 150 = 0 THEN 'o_orderstatus,o_totalprice' WHEN o_orderkey % 75 = 0 THEN 'o_orderstatus'
  ELSE 'o_totalprice' END AS difference FROM orders WHERE o_orderkey % 97 = 1 OR o_orderkey % 50 = 0 OR o_orderkey % 75 = 0"""

KEYS = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def exact_duplicates(spark, sf):
    return dedup.duplicate_groups(table(spark, sf, "lineitem"), KEYS, "l_orderkey")


EXACT = f"SELECT {', '.join(KEYS)}, count(*) AS size, min(l_orderkey) AS representative FROM lineitem GROUP BY ALL HAVING count(*) > 1"


def document_duplicates(spark, sf):
    return dedup.duplicate_summary(table(spark, sf, "documents"), ["text"], "doc_id")


DOCUMENT_DUPLICATES = """SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS rows, coalesce(sum(n - 1), 0)::BIGINT AS redundant, max(n) AS largest FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)"""


def first_of_digest(spark, sf):
    """Line items by a digest of their quantity and price; returned ones count as rows without a digest."""
    li = table(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    digest = F.when(F.col("l_returnflag") != "R", F.md5(F.concat_ws(":", F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string"), "l_linestatus")))
    kept = dedup.keep_first(li.withColumn("digest", digest), "digest", "id")
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))


FIRST_OF_DIGEST = """WITH l AS (SELECT l_returnflag, l_orderkey * 100 + l_linenumber AS id, CASE WHEN l_returnflag <> 'R' THEN md5(concat_ws(':', l_quantity::INT::VARCHAR, l_linenumber::VARCHAR, l_linestatus)) END AS d FROM lineitem),
m AS (SELECT *, min(id) OVER (PARTITION BY d) AS f FROM l) SELECT l_returnflag, count(*) AS n, min(id) AS lo, max(id) AS hi FROM m WHERE d IS NULL OR id = f GROUP BY l_returnflag"""


def label_conflicts(spark, sf):
    return _r(dedup.label_conflicts(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_returnflag"), ["groups", "rows"], "error_floor")


LABEL_CONFLICTS = """WITH c AS (SELECT l_quantity, l_discount, l_tax, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), g AS (SELECT count(*) AS l, sum(n) AS s, max(n) AS t FROM c GROUP BY l_quantity, l_discount, l_tax)
SELECT sum((l > 1)::INT)::BIGINT AS groups, sum(CASE WHEN l > 1 THEN s ELSE 0 END)::BIGINT AS rows, round(sum(CASE WHEN l > 1 THEN s - t ELSE 0 END) / sum(s), 6) AS error_floor FROM g"""


def near_duplicate_rows(spark, sf):
    return dedup.near_duplicate_rows(table(spark, sf, "part"), "p_partkey", ["p_retailprice", "p_size"], ["p_brand", "p_type"], rows=4)


def inter_arrival_burstiness(spark, sf):
    b = windows.burstiness(updates(spark, sf), ["entity"], ["us", "seq"]).withColumn("mean", F.col("mean") / 1000000)
    return _r(b, ["entity", "n"], "mean", "cv", "b", "b_finite", "memory", "zero_share")


BURSTINESS = f"""WITH {U}, g AS (SELECT entity, us, seq, (us - lag(us) OVER w)::DOUBLE AS gap FROM u WINDOW w AS (PARTITION BY entity ORDER BY us, seq)),
h AS (SELECT *, lag(gap) OVER (PARTITION BY entity ORDER BY us, seq) AS before FROM g),
a AS (SELECT entity, count(*) AS n, avg(gap) AS m, stddev_pop(gap) AS s, avg((gap = 0)::INT) AS z, CASE WHEN count(*) >= 3 THEN corr(gap, before) FILTER (before IS NOT NULL) END AS c FROM h WHERE gap IS NOT NULL GROUP BY entity)
SELECT entity, n, round(m / 1000000, 6) AS mean, round(s / m, 6) AS cv, round((s - m) / (s + m), 6) AS b, round((sqrt(n + 1) * s / m - sqrt(n - 1)) / ((sqrt(n + 1) - 2) * s / m + sqrt(n - 1)), 6) AS b_finite,
  round(c, 6) AS memory, round(z, 6) AS zero_share FROM a"""


def _series(spark, sf):
    return windows.count_series(updates(spark, sf), ["kind"], "us", HOUR)


SERIES = f"""s AS (SELECT kind, bin, count(us)::BIGINT AS n FROM (SELECT kind, lo, unnest(range(0, (hi - lo) // {HOUR} + 1)) AS bin FROM (SELECT kind, min(us) AS lo, max(us) AS hi FROM u GROUP BY kind)) p
  LEFT JOIN (SELECT kind, us, (us - min(us) OVER (PARTITION BY kind)) // {HOUR} AS bin FROM u) q USING (kind, bin) GROUP BY 1, 2)"""


def count_series_spine(spark, sf):
    return _series(spark, sf)


COUNT_SERIES = f"WITH {U}, {SERIES} SELECT * FROM s"


def flow_deltas(spark, sf):
    """Running totals: the count k of an event as a counter of its user and kind."""
    return windows.flow_deltas(updates(spark, sf), ["entity", "kind"], ["us", "seq"], "k").select("seq", "delta")


FLOW_DELTAS = f"WITH {U}, d AS (SELECT seq, k - coalesce(lag(k) OVER (PARTITION BY entity, kind ORDER BY us, seq), 0) AS d FROM u) SELECT seq, CASE WHEN d >= 0 THEN d END AS delta FROM d"


def _states(spark, sf):
    u = updates(spark, sf)
    return windows.window_states(u, ["kind"], "us", 6 * HOUR, {"entities": "entity", "counts": "k"}, ["k", "value"], {"even": "k % 2 = 0", "large": "value > 50"})


def window_states(spark, sf):
    return _r(_states(spark, sf), ["kind", "g", "rows", "entities", "counts", "sum_k"], "sum_value", "even", "large")


STATES = f"""t AS (SELECT kind, ((us + {6 * HOUR} - 1) // {6 * HOUR}) AS g, count(*) AS rows, count(DISTINCT entity) AS entities, count(DISTINCT k) AS counts, sum(k)::BIGINT AS sum_k, CASE WHEN count(value) = count(*) THEN sum(value) END AS sum_value,
  avg((k % 2 = 0)::INT) AS even, avg((value > 50)::INT) AS large FROM u GROUP BY 1, 2)"""
WINDOW_STATES = f"WITH {U}, {STATES} SELECT kind, g, rows, entities, counts, sum_k, round(sum_value, 6) AS sum_value, round(even, 6) AS even, round(large, 6) AS large FROM t"


def lagged_design(spark, sf):
    return windows.lagged_design(_states(spark, sf), ["kind"], "g", ["rows", "sum_k"], 3).select("kind", "g", *(f"{c}_lag{k}" for c in ("rows", "sum_k") for k in (1, 2, 3)))


LAGGED_DESIGN = f"""WITH {U}, {STATES} SELECT t.kind, t.g, {', '.join(f'a{k}.{c} AS {c}_lag{k}' for c in ('rows', 'sum_k') for k in (1, 2, 3))} FROM t
{' '.join(f'LEFT JOIN t a{k} ON a{k}.kind = t.kind AND a{k}.g = t.g - {k}' for k in (1, 2, 3))}"""


def cadence_triggers(spark, sf):
    t = windows.triggers(updates(spark, sf), ["kind"], "us", MINUTE)
    return t.groupBy("kind").agg(F.count("*").alias("n"), F.min("us").alias("first"), F.max("us").alias("last"))


TRIGGERS = f"WITH {U} SELECT kind, max(us) // {MINUTE} - (min(us) + {MINUTE} - 1) // {MINUTE} + 1 AS n, (min(us) + {MINUTE} - 1) // {MINUTE} * {MINUTE} AS first, max(us) // {MINUTE} * {MINUTE} AS last FROM u GROUP BY kind"


def next_position(spark, sf):
    return windows.next_position(updates(spark, sf), ["entity"], ["us", "seq"], "seq").select("seq", "next_key", "next_dt")


NEXT_POSITION = f"WITH {U} SELECT seq, lead(seq) OVER w AS next_key, lead(us) OVER w - us AS next_dt FROM u WINDOW w AS (PARTITION BY entity ORDER BY us, seq)"


def fan_episodes(spark, sf):
    """Suppliers that ship to many parts within a week."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", micros("l_shipdate").alias("us"))
    return windows.fans(li, "l_suppkey", "l_partkey", "us", 7 * DAY, 8)


FANS = f"""WITH l AS (SELECT l_suppkey, l_partkey, epoch_us(l_shipdate) AS us FROM lineitem WHERE l_suppkey <> l_partkey),
e AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY us ROWS UNBOUNDED PRECEDING) AS ep FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY l_suppkey ORDER BY us) > {7 * DAY} THEN 1 ELSE 0 END AS w FROM l)),
m AS (SELECT *, len(list_distinct(list(l_partkey) OVER (PARTITION BY l_suppkey, ep ORDER BY us RANGE BETWEEN {7 * DAY} PRECEDING AND CURRENT ROW))) AS met FROM e)
SELECT l_suppkey, min(us) AS first, max(us) AS last, count(*) AS n, max(met)::INTEGER AS most, min(us) FILTER (met >= 8) AS since FROM m GROUP BY l_suppkey, ep HAVING min(us) FILTER (met >= 8) IS NOT NULL"""


def bounded_windows(spark, sf):
    w = windows.bounded_windows(updates(spark, sf), "kind", ["us", "seq"], "entity", 256, 100)
    return w.groupBy("kind", "window").agg(F.count("*").alias("n"), F.min("us").alias("first"), F.max("us").alias("last"))


def acf(spark, sf):
    return _r(windows.autocorrelation(_series(spark, sf), ["kind"], "bin", "n", 24), ["kind", "lag"], "r", "q")


ACF = f"""WITH {U}, {SERIES}, d AS (SELECT kind, bin, n - avg(n) OVER (PARTITION BY kind) AS d FROM s), c AS (SELECT kind, count(*) AS n, sum(d * d) AS c0 FROM d GROUP BY kind),
l AS (SELECT a.kind, (b.bin - a.bin) AS lag, sum(a.d * b.d) AS p FROM d a JOIN d b ON a.kind = b.kind AND b.bin - a.bin BETWEEN 1 AND 24 GROUP BY 1, 2)
SELECT kind, lag::INTEGER AS lag, round(p / c0, 6) AS r, round(n * (n + 2.0) * sum(p / c0 * p / c0 / (n - lag)) OVER (PARTITION BY kind ORDER BY lag), 6) AS q FROM l JOIN c USING (kind)"""


def hurst_aggregated_variance(spark, sf):
    return _r(windows.aggregated_variance(_series(spark, sf), ["kind"], "bin", "n", [2, 4, 8, 16, 32]), ["kind", "sizes"], "hurst")


HURST = f"""WITH {U}, {SERIES}, b AS (SELECT kind, m, bin // m AS block, avg(n) AS mean, count(*) AS c FROM s, (SELECT unnest([2, 4, 8, 16, 32]) AS m) GROUP BY 1, 2, 3 HAVING count(*) = m),
v AS (SELECT kind, m, var_pop(mean) AS v FROM b GROUP BY 1, 2 HAVING count(*) > 1 AND var_pop(mean) > 0) SELECT kind, count(*) AS sizes, round(1 + regr_slope(ln(v), ln(m)) / 2, 6) AS hurst FROM v GROUP BY kind"""


def rolling_indicators(spark, sf):
    return _r(windows.rolling(_series(spark, sf), ["kind"], "bin", "n", 48), ["kind", "bin", "n"], "variance", "ar1", "slope")


ROLLING = f"""WITH {U}, {SERIES}, l AS (SELECT *, lag(n) OVER (PARTITION BY kind ORDER BY bin) AS b FROM s),
r AS (SELECT kind, bin, n, count(*) OVER w AS c, var_samp(n) OVER w AS v, corr(n, b) OVER x AS a, regr_slope(n, bin) OVER w AS sl FROM l
  WINDOW w AS (PARTITION BY kind ORDER BY bin ROWS BETWEEN 47 PRECEDING AND CURRENT ROW), x AS (PARTITION BY kind ORDER BY bin ROWS BETWEEN 46 PRECEDING AND CURRENT ROW))
SELECT kind, bin, n, round(CASE WHEN c = 48 THEN v END, 6) AS variance, round(CASE WHEN c = 48 THEN a END, 6) + 0.0::DOUBLE AS ar1, round(CASE WHEN c = 48 THEN sl END, 6) + 0.0::DOUBLE AS slope FROM r"""


def trailing_entropy(spark, sf):
    return _r(windows.trailing_window_entropy(updates(spark, sf), ["kind"], "entity", "us", 12 * HOUR, 48 * HOUR), ["kind", "k", "n"], "h")


TRAILING_ENTROPY = f"""WITH {U}, e AS (SELECT kind, entity, k, count(*)::DOUBLE AS c FROM (SELECT kind, entity, unnest(range((us + {12 * HOUR} - 1) // {12 * HOUR}, (us + {48 * HOUR} + {12 * HOUR} - 1) // {12 * HOUR})) AS k FROM u) GROUP BY ALL)
SELECT kind, k, sum(c)::BIGINT AS n, round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 6) AS h FROM e GROUP BY 1, 2"""


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", micros("o_orderdate").alias("us"))


ROLES = {"train": 0.6, "test": 0.2, "val": 0.2}


def chronological_split(spark, sf):
    return splits.chronological(_orders(spark, sf), ["o_orderpriority"], ["us", "o_orderkey"], ROLES)


CUTS = """n AS (SELECT o_orderkey, o_orderpriority, epoch_us(o_orderdate) AS us, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
f AS (SELECT *, (n * 6) // 10 AS a0, (n * 2) // 10 AS b0, (n * 6) % 10 AS ra, (n * 2) % 10 AS rb FROM n),
g AS (SELECT *, n - a0 - 2 * b0 AS rest FROM f), h AS (SELECT *, a0 + CASE WHEN (CASE WHEN rb > ra THEN 2 ELSE 0 END) < rest THEN 1 ELSE 0 END AS a, b0 + CASE WHEN (CASE WHEN ra >= rb THEN 1 ELSE 0 END) < rest THEN 1 ELSE 0 END AS b FROM g),
r AS (SELECT o_orderkey, o_orderpriority, us, CASE WHEN i < a THEN 'train' WHEN i < a + 1 THEN 'excluded' WHEN i < a + b THEN 'test' WHEN i < a + b + 1 THEN 'excluded' ELSE 'val' END AS role FROM h)"""
CHRONOLOGICAL = f"WITH {CUTS} SELECT * FROM r"


def label_limits(spark, sf):
    rows = chronological_split(spark, sf)
    return splits.next_other_role(rows, ["o_orderpriority"], ["us", "o_orderkey"], "us", "role", ["train", "test", "val"]).select("o_orderkey", "limit")


LABEL_LIMITS = f"""WITH {CUTS}, {', '.join(f"m_{x} AS (SELECT o_orderkey, min(CASE WHEN role = '{x}' THEN us END) OVER (PARTITION BY o_orderpriority ORDER BY us, o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS t_{x} FROM r)" for x in ROLES)}
SELECT o_orderkey, least(CASE WHEN role <> 'train' THEN t_train END, CASE WHEN role <> 'test' THEN t_test END, CASE WHEN role <> 'val' THEN t_val END) AS "limit" FROM r JOIN m_train USING (o_orderkey) JOIN m_test USING (o_orderkey) JOIN m_val USING (o_orderkey)"""


def class_balanced_weights(spark, sf):
    return _r(splits.class_weights(table(spark, sf, "orders"), "o_orderstatus", 0.5), ["o_orderstatus", "n"], "weight").withColumn("weight", F.round("weight", 6))


WEIGHTS = "WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderstatus, n, round(pow(n, -0.5) / sum(n * pow(n, -0.5)) OVER (), 6) AS weight FROM c"


def kfold_stratified(spark, sf):
    return splits.folds(_orders(spark, sf), "o_orderkey", "o_orderpriority", 5).select("o_orderkey", "fold")


KFOLD = "SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('0:' || o_orderkey), o_orderkey) - 1) % 5)::INTEGER AS fold FROM orders"


def random_holdout(spark, sf):
    return splits.holdout(_orders(spark, sf), "o_orderkey", "o_orderpriority", 0.3, 7).select("o_orderkey", "test")


HOLDOUT = "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('7:' || o_orderkey), o_orderkey) - 1 < floor(count(*) OVER (PARTITION BY o_orderpriority) * 0.3 + 0.5) AS test FROM orders"


def last_rows_holdout(spark, sf):
    return splits.last_rows(updates(spark, sf), ["entity"], ["us", "seq"], 0.2).select("seq", "test")


LAST_ROWS = f"WITH {U} SELECT seq, row_number() OVER (PARTITION BY entity ORDER BY us, seq) - 1 >= count(*) OVER (PARTITION BY entity) - floor(count(*) OVER (PARTITION BY entity) * 0.2) AS test FROM u"


def disjoint_groups(spark, sf):
    return splits.disjoint_groups(updates(spark, sf), "entity", {"train": 0.6, "test": 0.25, "val": 0.15}, 3).groupBy("entity", "part").agg(F.count("*").alias("n"))


DISJOINT = f"""WITH {U}, h AS (SELECT entity, ('0x' || substr(md5('3:' || entity), 1, 8))::BIGINT / 4294967296 AS x FROM u) SELECT entity, CASE WHEN x < 0.6 THEN 'train' WHEN x < 0.85 THEN 'test' ELSE 'val' END AS part, count(*) AS n FROM h GROUP BY 1, 2"""


def forward_chaining_folds(spark, sf):
    return splits.forward_folds(_orders(spark, sf).withColumn("ends", F.col("us") + 20 * DAY), "us", "ends", 5, 30 * DAY)


FORWARD = f"""WITH t AS (SELECT epoch_us(o_orderdate) AS us, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT us, sum(n) OVER (ORDER BY us) AS hi, sum(n) OVER (ORDER BY us) - n AS lo, sum(n) OVER () AS total FROM t),
b AS (SELECT us, {' + '.join(f'(hi > round({i} * total / 5.0))::INT' for i in range(1, 5))} AS block FROM c), p AS (SELECT epoch_us(o_orderdate) AS us, block FROM orders JOIN b ON epoch_us(o_orderdate) = b.us),
s AS (SELECT block AS fold, min(us) AS v0, count(*) AS validation FROM p WHERE block > 0 GROUP BY 1)
SELECT fold, v0, validation, (SELECT count(*) FROM p WHERE block < fold AND us + {20 * DAY} < v0 AND us <= v0 - {30 * DAY}) AS train FROM s"""


def stratified_sample(spark, sf):
    return splits.stratified_sample(_orders(spark, sf), "o_orderkey", "o_orderpriority", 0.1, 1).select("o_orderkey", "o_orderpriority")


SAMPLE = "SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('1:' || o_orderkey), o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE i < ceil(n * 0.1)"


def latest_n_per_entity(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("entity").orderBy(F.desc("us"), F.desc("seq"))
    return updates(spark, sf).withColumn("r", F.row_number().over(w)).filter("r <= 5").select("entity", "r", "seq", "kind")


LATEST_N = f"WITH {U} SELECT entity, r::INTEGER AS r, seq, kind FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY us DESC, seq DESC) AS r FROM u) WHERE r <= 5"

QUERIES = {f.__name__: f for f in (
    entity_latest_asof, entity_latest_asof_periods, episode_lead_time, episode_assignment, interval_union, temporal_overlap, shared_units, seen_units, cross_split_duplicates, table_difference,
    exact_duplicates, document_duplicates, first_of_digest, label_conflicts, near_duplicate_rows, inter_arrival_burstiness, count_series_spine, flow_deltas, window_states, lagged_design,
    cadence_triggers, next_position, fan_episodes, bounded_windows, acf, hurst_aggregated_variance, rolling_indicators, trailing_entropy, chronological_split, label_limits, class_balanced_weights,
    kfold_stratified, random_holdout, last_rows_holdout, disjoint_groups, forward_chaining_folds, stratified_sample, latest_n_per_entity,
)}
ORACLE = {
    "entity_latest_asof": ASOF, "entity_latest_asof_periods": ASOF, "episode_lead_time": EPISODE_LEAD_TIME, "episode_assignment": EPISODE_ASSIGNMENT, "interval_union": INTERVAL_UNION,
    "temporal_overlap": TEMPORAL_OVERLAP, "shared_units": SHARED_UNITS, "seen_units": SEEN_UNITS, "cross_split_duplicates": CROSS, "table_difference": TABLE_DIFFERENCE, "exact_duplicates": EXACT,
    "document_duplicates": DOCUMENT_DUPLICATES, "first_of_digest": FIRST_OF_DIGEST, "label_conflicts": LABEL_CONFLICTS, "inter_arrival_burstiness": BURSTINESS, "count_series_spine": COUNT_SERIES,
    "flow_deltas": FLOW_DELTAS, "window_states": WINDOW_STATES, "lagged_design": LAGGED_DESIGN, "cadence_triggers": TRIGGERS, "next_position": NEXT_POSITION, "fan_episodes": FANS, "acf": ACF,
    "hurst_aggregated_variance": HURST, "rolling_indicators": ROLLING, "trailing_entropy": TRAILING_ENTROPY, "chronological_split": CHRONOLOGICAL, "label_limits": LABEL_LIMITS,
    "class_balanced_weights": WEIGHTS, "kfold_stratified": KFOLD, "random_holdout": HOLDOUT, "last_rows_holdout": LAST_ROWS, "disjoint_groups": DISJOINT, "forward_chaining_folds": FORWARD,
    "stratified_sample": SAMPLE, "latest_n_per_entity": LATEST_N,
}
