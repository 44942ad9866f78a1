"""Queries on observation status, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.scalars import rounded
from tessera.operators import observability as ob
from tessera.sources.tables import UPDATES_SQL as U
from tessera.sources.tables import table, updates

HOUR = 3_600_000_000


def status_tables(spark, sf):
    t = ob.status_tables(updates(spark, sf), "kind")
    return t.select("grp", "status_name", "n", rounded(F.col("share")).alias("share"), "overall")


STATUS_TABLES = f"""WITH {U}, g AS (SELECT kind AS grp, status, count(*) AS n, grouping(kind)::INTEGER AS overall FROM u GROUP BY GROUPING SETS ((kind, status), (status)))
SELECT grp, (['OBSERVED','STALE','LOW_RELIABILITY','NOT_SUPPLIED','NOT_OBSERVABLE'])[status + 1] AS status_name, n,
  round(n / sum(n) OVER (PARTITION BY overall, grp), 6) AS share, overall FROM g"""


def coverage_over_time(spark, sf):
    cov = ob.coverage_over_time(updates(spark, sf), "kind", HOUR)
    return cov.select("kind", "bin", "n", *(rounded(F.col(f"share_{c}")).alias(f"share_{c}") for c in range(5)), rounded(F.col("contributing")).alias("contributing"))


COVERAGE = f"""WITH {U}, c AS (
  SELECT kind, (us - t0) // {HOUR} AS bin, count(*) AS n, avg((status = 0)::INT) AS share_0, avg((status = 1)::INT) AS share_1, avg((status = 2)::INT) AS share_2,
    avg((status = 3)::INT) AS share_3, avg((status = 4)::INT) AS share_4, avg((status < 3)::INT) AS contributing
  FROM (SELECT *, min(us) OVER (PARTITION BY kind) AS t0 FROM u) GROUP BY ALL)"""
COVERAGE_OVER_TIME = COVERAGE + """
SELECT kind, bin, n, round(share_0, 6) AS share_0, round(share_1, 6) AS share_1, round(share_2, 6) AS share_2, round(share_3, 6) AS share_3, round(share_4, 6) AS share_4,
  round(contributing, 6) AS contributing FROM c"""


def coverage_gaps(spark, sf):
    return ob.coverage_gaps(ob.coverage_over_time(updates(spark, sf), "kind", HOUR), "kind", 0.9)


COVERAGE_GAPS = COVERAGE + """, m AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY bin) AS i, quantile_cont(contributing, 0.5) OVER (PARTITION BY kind) AS med FROM c),
l AS (SELECT *, i - row_number() OVER (PARTITION BY kind ORDER BY bin) AS run FROM m WHERE med > 0 AND contributing < 0.9 * med)
SELECT kind, min(bin) AS first_bin, max(bin) + 1 AS end_bin, count(*) AS bins FROM l GROUP BY kind, run"""


def capability_matrix(spark, sf):
    return ob.capability(updates(spark, sf), "entity").select("entity", "rows", rounded(F.col("share")).alias("share"), "capability")


CAPABILITY = f"""WITH {U}, c AS (SELECT entity, status, count(*) AS n FROM u GROUP BY ALL),
a AS (SELECT entity, sum(n)::BIGINT AS rows, sum(CASE WHEN status < 3 THEN n ELSE 0 END) / sum(n) AS share, first(status ORDER BY n DESC, status) AS modal FROM c GROUP BY entity)
SELECT entity, rows, round(share, 6) AS share, CASE WHEN share >= 0.99 THEN 'always' WHEN share >= 0.5 THEN 'mostly' WHEN share > 0 THEN 'sometimes'
  WHEN modal = 4 THEN 'not observable' ELSE 'never supplied' END AS capability FROM a"""


def _levels(spark, sf):
    """Statuses of three levels of an event: the value, the count and a pairing of both."""
    u = updates(spark, sf)
    other = F.when(F.pmod("k", F.lit(7)) == 0, 3).when(F.pmod("k", F.lit(11)) == 0, 4).otherwise(0)
    return u.withColumns({"s_value": F.col("status"), "s_count": other, "s_pair": F.greatest("status", other)})


LEVELS = f"""WITH {U}, l AS (SELECT *, status AS s_value, CASE WHEN k % 7 = 0 THEN 3 WHEN k % 11 = 0 THEN 4 ELSE 0 END AS s_count FROM u),
v AS (SELECT *, greatest(s_value, s_count) AS s_pair FROM l)"""


def attack_visibility(spark, sf):
    v = ob.visibility(_levels(spark, sf), "entity", "kind = 'error'", {"by_value": "s_value", "by_count": "s_count", "by_pair": "s_pair"})
    return v.select("entity", "n", *(rounded(F.col(c)).alias(c) for c in ("by_value", "by_count", "by_pair")))


VISIBILITY = LEVELS + """ SELECT entity, count(*) AS n, round(avg((s_value < 3)::INT), 6) AS by_value, round(avg((s_count < 3)::INT), 6) AS by_count,
  round(avg((s_pair < 3)::INT), 6) AS by_pair FROM v WHERE kind = 'error' GROUP BY entity"""


def ordering_reliability(spark, sf):
    """Events in the order of their ids modulo 97 come out of time order; the watermark is the latest time so far."""
    u = updates(spark, sf)
    before = Window.partitionBy("entity").orderBy(F.pmod("seq", F.lit(97)), "seq").rowsBetween(Window.unboundedPreceding, -1)
    o = ob.ordering(u.withColumn("watermark", F.max("us").over(before)), "entity", "us", "watermark")
    return o.select("entity", "n", rounded(F.col("late_share")).alias("late_share"), "resolution", rounded(F.col("simultaneous")).alias("simultaneous"))


ORDERING = f"""WITH {U}, w AS (SELECT *, max(us) OVER (PARTITION BY entity ORDER BY seq % 97, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM u),
l AS (SELECT entity, count(us) AS n, avg(CASE WHEN us IS NOT NULL AND wm IS NOT NULL THEN (us < wm)::INT END) AS late FROM w GROUP BY entity),
d AS (SELECT entity, us, us - lag(us) OVER (PARTITION BY entity ORDER BY us) AS gap FROM (SELECT DISTINCT entity, us FROM u)),
g AS (SELECT entity, min(gap) AS resolution, count(*) AS k FROM d GROUP BY entity)
SELECT entity, n, round(late, 6) AS late_share, resolution, round(1 - k / n, 6) AS simultaneous FROM l JOIN g USING (entity)"""


def status_patterns(spark, sf):
    return ob.patterns(_levels(spark, sf), ["s_value", "s_count", "s_pair"], 25)


PATTERNS = LEVELS + """ SELECT pattern, n FROM (SELECT substr('OSLNX', s_value + 1, 1) || substr('OSLNX', s_count + 1, 1) || substr('OSLNX', s_pair + 1, 1) AS pattern, count(*) AS n
  FROM v GROUP BY 1) ORDER BY n DESC, pattern LIMIT 25"""


def missing_coabsence(spark, sf):
    c = ob.coabsence(_levels(spark, sf), {"value": "s_value", "count": "s_count", "pair": "s_pair"})
    return c.select("a", "b", "n_both", rounded(F.col("jaccard")).alias("jaccard"), rounded(F.col("phi")).alias("phi"))


COABSENCE = LEVELS + """, l3 AS (SELECT seq, unnest(['value', 'count', 'pair']) AS name, unnest([s_value, s_count, s_pair]) >= 3 AS gone FROM v),
p AS (SELECT x.name AS a, y.name AS b, count(*) AS n, sum(x.gone::INT)::DOUBLE AS sa, sum(y.gone::INT)::DOUBLE AS sb, sum((x.gone AND y.gone)::INT)::BIGINT AS n_both
  FROM l3 x JOIN l3 y ON x.seq = y.seq AND x.name < y.name GROUP BY ALL)
SELECT a, b, n_both, round(n_both / (sa + sb - n_both), 6) AS jaccard, round((n_both / n - sa / n * sb / n) / sqrt(sa / n * (1 - sa / n) * sb / n * (1 - sb / n)), 6) AS phi FROM p"""


def label_absence(spark, sf):
    """Documents with and without a label, by language: absence that the data have of themselves."""
    docs, labels = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), rounded(F.avg("quality")).alias("mean_quality"))


LABEL_ABSENCE = "SELECT lang, count(*) AS n, count(quality) AS labelled, round(avg(quality), 6) AS mean_quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang"

QUERIES = {
    "status_tables": status_tables, "coverage_over_time": coverage_over_time, "coverage_gaps": coverage_gaps, "capability_matrix": capability_matrix, "attack_visibility": attack_visibility,
    "ordering_reliability": ordering_reliability, "status_patterns": status_patterns, "missing_coabsence": missing_coabsence, "label_absence": label_absence,
}
ORACLE = {
    "status_tables": STATUS_TABLES, "coverage_over_time": COVERAGE_OVER_TIME, "coverage_gaps": COVERAGE_GAPS, "capability_matrix": CAPABILITY, "attack_visibility": VISIBILITY,
    "ordering_reliability": ORDERING, "status_patterns": PATTERNS, "missing_coabsence": COABSENCE, "label_absence": LABEL_ABSENCE,
}
