"""Queries of descriptive statistics, dependence, information and drift, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalars import rounded, slog1p
from tessera.operators import describe as d
from tessera.operators import drift, information
from tessera.sources.tables import UPDATES_SQL as U
from tessera.sources.tables import table, updates


def _r(df, keep, *names):
    return df.select(*keep, *(rounded(F.col(n)).alias(n) for n in names))


def class_balance(spark, sf):
    return _r(d.balance(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"), ["l_returnflag", "l_linestatus", "n", "total"], "share")


CLASS_BALANCE = """SELECT l_returnflag, l_linestatus, n, total::INTEGER AS total, round(n / max(n) FILTER (total = 1) OVER (PARTITION BY l_returnflag), 6) AS share FROM (
  SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus) AS total FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag)))"""


def evenness(spark, sf):
    return _r(d.evenness(updates(spark, sf), "kind", "entity"), ["kind", "classes", "n"], "shannon", "pielou", "effective", "gini_simpson", "imbalance")


EVENNESS = f"""WITH {U}, c AS (SELECT kind, entity, count(*)::DOUBLE AS n FROM u GROUP BY ALL),
s AS (SELECT kind, count(*) AS classes, sum(n) AS n, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h, sum(n * n) AS sq, max(n) / min(n) AS im FROM c GROUP BY kind)
SELECT kind, classes, n::BIGINT AS n, round(h, 6) AS shannon, round(CASE WHEN classes > 1 THEN h / ln(classes) END, 6) AS pielou, round(exp(h), 6) AS effective,
  round(1 - sq / (n * n), 6) AS gini_simpson, round(im, 6) AS imbalance FROM s"""


def robust_summary(spark, sf):
    out = d.robust_summary(updates(spark, sf), "value", ["kind"])
    return _r(out, ["kind", "n"], "min", "max", "mean", "sd", "q1", "median", "q3", "iqr", "mad", "trimmed_mean", "bowley", "moors")


ROBUST = f"""WITH {U}, v AS (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY value) AS r, count(*) OVER (PARTITION BY kind) AS c, quantile_cont(value, 0.5) OVER (PARTITION BY kind) AS med
  FROM u WHERE value IS NOT NULL),
q AS (SELECT kind, count(*) AS n, min(value) AS lo, max(value) AS hi, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS o,
  1.4826 * quantile_cont(abs(value - med), 0.5) AS mad, avg(value) FILTER (r > floor(c * 0.1) AND r <= c - floor(c * 0.1)) AS tm FROM v GROUP BY kind)
SELECT kind, n, round(lo, 6) AS min, round(hi, 6) AS max, round(mean, 6) AS mean, round(sd, 6) AS sd, round(o[2], 6) AS q1, round(o[4], 6) AS median, round(o[6], 6) AS q3, round(o[6] - o[2], 6) AS iqr,
  round(mad, 6) AS mad, round(tm, 6) AS trimmed_mean, round((o[6] + o[2] - 2 * o[4]) / (o[6] - o[2]), 6) AS bowley, round((o[7] - o[5] + o[3] - o[1]) / (o[6] - o[2]), 6) AS moors FROM q"""


def histogram_fd(spark, sf):
    return d.histogram(updates(spark, sf), "value", ["kind"])


HISTOGRAM = f"""WITH {U}, q AS (SELECT kind, count(value) AS n, min(value) AS lo, max(value) AS hi, 2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) * pow(count(value), -1.0/3) AS w FROM u GROUP BY kind),
b AS (SELECT *, least(200, greatest(1, ceil((hi - lo) / w)))::INT AS bins FROM q)
SELECT kind, least(bins - 1, floor((value - lo) / ((hi - lo) / bins)))::INT AS bin, count(*) AS n, any_value(bins) AS bins FROM u JOIN b USING (kind) WHERE value IS NOT NULL GROUP BY 1, 2"""


def top_k_categories(spark, sf):
    return d.top_values(updates(spark, sf), "k", ["kind"], 20)


TOP_K = f"""WITH {U}, c AS (SELECT kind, k, count(*) AS n FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, k) AS r FROM c)
SELECT kind, CASE WHEN r <= 20 THEN k END AS k, sum(n)::BIGINT AS n FROM r GROUP BY 1, 2"""


def log_histogram(spark, sf):
    return _r(d.log_histogram(table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"]), ["o_orderpriority", "bin", "n"], "density").withColumn("density", F.round(F.col("density") * 1, 9))


LOG_HISTOGRAM = """WITH c AS (SELECT o_orderpriority, floor(log10(o_totalprice) * 10)::BIGINT AS bin, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY ALL)
SELECT o_orderpriority, bin, n, round(n / (sum(n) OVER (PARTITION BY o_orderpriority) * (pow(10.0, (bin + 1) / 10.0) - pow(10.0, bin / 10.0))), 6) AS density FROM c"""


def hill_tail(spark, sf):
    return _r(d.hill(updates(spark, sf), "value", ["kind"], 50), ["kind"], "gamma")


HILL = f"""WITH {U}, r AS (SELECT kind, ln(value) AS l, row_number() OVER (PARTITION BY kind ORDER BY value DESC) AS r FROM u WHERE value > 0)
SELECT kind, round(CASE WHEN count(*) = 51 THEN sum(l) FILTER (r <= 50) / 50 - max(l) FILTER (r = 51) END, 6) AS gamma FROM r WHERE r <= 51 GROUP BY kind"""


def pearson_slog1p(spark, sf):
    return _r(d.correlation(updates(spark, sf), slog1p(F.col("value")), slog1p(F.col("k").cast("double")), ["kind"]), ["kind", "n"], "r", "lo", "hi")


PEARSON = f"""WITH {U}, r AS (SELECT kind, count(*) AS n, corr(sign(value) * ln(1 + abs(value)), ln(1 + k)) AS r FROM u WHERE value IS NOT NULL GROUP BY kind)
SELECT kind, n, round(r, 6) AS r, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS lo, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS hi FROM r"""


def spearman(spark, sf):
    return _r(d.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), ["l_returnflag", "n"], "rho")


SPEARMAN = """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS b FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY l_returnflag"""


def cramers_v(spark, sf):
    return _r(d.cramers_v(table(spark, sf, "lineitem"), "l_returnflag", "l_suppkey"), ["n"], "chi2", "v")


CRAMERS = """WITH c AS (SELECT l_returnflag AS x, l_suppkey AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), j AS (SELECT n, sum(n) OVER (PARTITION BY x) AS a, sum(n) OVER (PARTITION BY y) AS b, x, y FROM c),
s AS (SELECT sum(n) AS n, sum(n * n / (a * b)) - 1 AS p, count(DISTINCT x) AS r, count(DISTINCT y) AS c FROM j)
SELECT n::BIGINT AS n, round(p * n, 6) AS chi2, round(sqrt(greatest(0, p - (r - 1) * (c - 1) / (n - 1)) / least(r - (r - 1) * (r - 1) / (n - 1) - 1, c - (c - 1) * (c - 1) / (n - 1) - 1)), 6) AS v FROM s"""


def entropy_estimators(spark, sf):
    counts = updates(spark, sf).groupBy("entity", "k").agg(F.count("*").alias("n"))
    return _r(information.entropies(counts, ["entity"]), ["entity", "symbols", F.col("total").cast("long").alias("total")], "plugin", "miller_madow", "chao_shen")


ENTROPY = f"""WITH {U}, c AS (SELECT entity, k, count(*)::DOUBLE AS n FROM u GROUP BY ALL),
s AS (SELECT entity, sum(n) AS t, count(*) AS m, sum((n = 1)::INT) AS f FROM c GROUP BY entity), g AS (SELECT entity, t, m, CASE WHEN f = t THEN t - 1 ELSE f END AS f FROM s),
j AS (SELECT *, n / t AS p, (1 - f / t) * n / t AS cp FROM c JOIN g USING (entity))
SELECT entity, max(m) AS symbols, max(t)::BIGINT AS total, round(-sum(p * ln(p)), 6) AS plugin, round(-sum(p * ln(p)) + (max(m) - 1) / (2 * max(t)), 6) AS miller_madow,
  round(-sum(CASE WHEN cp > 0 THEN cp * ln(cp) / (1 - pow(1 - cp, t)) ELSE 0 END), 6) AS chao_shen FROM j GROUP BY entity"""


def mutual_information(spark, sf):
    return _r(information.mutual_information(updates(spark, sf), "kind", "k"), [], "mi", "mi_miller_madow")


def _mi_sql(x, y, source):
    return f"""SELECT sum(CASE WHEN g = 0 THEN -1 ELSE 1 END * h) AS mi, sum(CASE WHEN g = 0 THEN -1 ELSE 1 END * (h + (m - 1) / (2 * t))) AS mm FROM (
      SELECT g, sum(n) AS t, count(*) AS m, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (
        SELECT count(*)::DOUBLE AS n, grouping({x}, {y}) AS g FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY GROUPING SETS (({x}), ({y}), ({x}, {y}))) GROUP BY g)"""


MI = f"WITH {U} SELECT round(mi, 6) AS mi, round(mm, 6) AS mi_miller_madow FROM ({_mi_sql('kind', 'k', 'u')})"


def lagged_information(spark, sf):
    return _r(information.lagged_mutual_information(updates(spark, sf), "entity", ["us", "seq"], "kind", [1, 2, 3]), ["lag"], "mi", "mi_miller_madow")


LAGGED = f"""WITH {U}, l AS (SELECT kind, {', '.join(f'lead(kind, {i}) OVER w AS l{i}' for i in (1, 2, 3))} FROM u WINDOW w AS (PARTITION BY entity ORDER BY us, seq))
{' UNION ALL '.join(f"SELECT {i} AS lag, round(mi, 6) AS mi, round(mm, 6) AS mi_miller_madow FROM ({_mi_sql('kind', f'l{i}', 'l')})" for i in (1, 2, 3))}"""


def jensen_shannon(spark, sf):
    counts = updates(spark, sf).groupBy("entity", "k").agg(F.sum(F.when(F.col("kind") == "error", 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("kind") == "error", 0).otherwise(1)).alias("q"))
    return _r(information.jensen_shannon(counts, "k", "p", "q", ["entity"]), ["entity"], "jsd")


JSD = f"""WITH {U}, c AS (SELECT entity, k, sum((kind = 'error')::INT)::DOUBLE AS p, sum((kind <> 'error')::INT)::DOUBLE AS q FROM u GROUP BY ALL),
n AS (SELECT entity, p / sum(p) OVER w AS a, q / sum(q) OVER w AS b, sum(p) OVER w AS sp, sum(q) OVER w AS sq FROM c WINDOW w AS (PARTITION BY entity)),
t AS (SELECT entity, CASE WHEN a + b > 0 THEN -(a + b) / 2 * ln((a + b) / 2) ELSE 0 END + CASE WHEN a > 0 THEN a * ln(a) ELSE 0 END / 2 + CASE WHEN b > 0 THEN b * ln(b) ELSE 0 END / 2 AS t FROM n WHERE sp > 0 AND sq > 0)
SELECT entity, round(greatest(0, sum(t)), 6) AS jsd FROM t GROUP BY entity"""


def _halves(spark, sf):
    """The second half of January is held against the first."""
    return updates(spark, sf).withColumn("current", F.col("us") >= 1705363200000000)


HALVES = f"WITH {U}, h AS (SELECT *, us >= 1705363200000000 AS cur FROM u)"


def psi(spark, sf):
    return _r(drift.psi(_halves(spark, sf), "value", "current", ["kind"]), ["kind", "bins"], "psi")


PSI = HALVES + """, q AS (SELECT kind, list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) FILTER (NOT cur))) AS e FROM h GROUP BY kind),
b AS (SELECT kind, CASE WHEN value IS NULL THEN -1 ELSE len(list_filter(e[2:len(e) - 1], lambda x: x <= value)) END AS bin, sum((NOT cur)::INT) AS r, sum(cur::INT) AS c FROM h JOIN q USING (kind) GROUP BY 1, 2),
s AS (SELECT kind, greatest(1e-4, r / sum(r) OVER (PARTITION BY kind)) AS a, greatest(1e-4, c / sum(c) OVER (PARTITION BY kind)) AS b FROM b)
SELECT kind, count(*) AS bins, round(sum((b - a) * ln(b / a)), 6) AS psi FROM s GROUP BY kind"""


def ks_two_sample(spark, sf):
    return _r(drift.kolmogorov_smirnov(_halves(spark, sf), "value", "current", ["kind"]), ["kind", "n_reference", "n_current"], "ks")


KS = HALVES + """, c AS (SELECT kind, value, sum((NOT cur)::INT) AS r, sum(cur::INT) AS c FROM h WHERE value IS NOT NULL GROUP BY 1, 2),
s AS (SELECT kind, value, sum(r) OVER w / sum(r) OVER p AS f, sum(c) OVER w / sum(c) OVER p AS g, sum(r) OVER p AS nr, sum(c) OVER p AS nc FROM c WINDOW w AS (PARTITION BY kind ORDER BY value), p AS (PARTITION BY kind))"""
KS_TWO_SAMPLE = KS + " SELECT kind, max(nr)::BIGINT AS n_reference, max(nc)::BIGINT AS n_current, round(max(abs(f - g)), 6) AS ks FROM s GROUP BY kind"


def w1_distance(spark, sf):
    return _r(drift.wasserstein(_halves(spark, sf), "value", "current", ["kind"]), ["kind"], "w1")


W1 = KS + ", d AS (SELECT kind, abs(f - g) * (lead(value) OVER (PARTITION BY kind ORDER BY value) - value) AS t FROM s) SELECT kind, round(sum(t), 6) AS w1 FROM d GROUP BY kind"


def chi2_homogeneity(spark, sf):
    return _r(drift.homogeneity(_halves(spark, sf), "k", "current", ["kind"]), ["kind", "df"], "chi2")


CHI2 = HALVES + """, c AS (SELECT kind, k, sum((NOT cur)::INT) AS r, sum(cur::INT) AS c FROM h GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY r + c DESC, k) AS i FROM c),
g AS (SELECT kind, CASE WHEN i <= 50 THEN k END AS k, sum(r) AS r, sum(c) AS c FROM t GROUP BY 1, 2),
e AS (SELECT kind, r, c, (r + c) * sum(r) OVER w / (sum(r) OVER w + sum(c) OVER w) AS er, (r + c) * sum(c) OVER w / (sum(r) OVER w + sum(c) OVER w) AS ec FROM g WINDOW w AS (PARTITION BY kind))
SELECT kind, count(*) - 1 AS df, round(sum((r - er) * (r - er) / er + (c - ec) * (c - ec) / ec), 6) AS chi2 FROM e GROUP BY kind"""


def _p_values(spark, sf):
    """A family of tests: the share of errors of each entity as a p-value, NULL for every ninth."""
    shares = updates(spark, sf).groupBy("entity").agg(F.avg((F.col("kind") == "error").cast("double")).alias("p"))
    return shares.select("entity", F.when(F.col("entity") % 9 != 0, F.round(F.col("p") / 4, 9)).alias("p"), (F.col("entity") % 3).alias("family"))


P_VALUES = f"WITH {U}, p AS (SELECT entity, CASE WHEN entity % 9 <> 0 THEN round(avg((kind = 'error')::INT) / 4, 9) END AS p, entity % 3 AS family FROM u GROUP BY entity), m AS (SELECT *, count(p) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p NULLS LAST) AS i FROM p)"


def fdr_bh(spark, sf):
    return _r(drift.fdr(_p_values(spark, sf), "p", ["family"]), ["entity", "family"], "adjusted")


FDR_BH = P_VALUES + " SELECT entity, family, round(CASE WHEN p IS NOT NULL THEN least(1, min(p * m / i) OVER (PARTITION BY family ORDER BY i DESC)) END, 6) AS adjusted FROM m"


def fdr_by(spark, sf):
    return _r(drift.fdr(_p_values(spark, sf), "p", ["family"], "by"), ["entity", "family"], "adjusted")


FDR_BY = P_VALUES + " SELECT entity, family, round(CASE WHEN p IS NOT NULL THEN least(1, min(p * m / i * list_sum(list_transform(range(1, m + 1), lambda x: 1.0::DOUBLE / x))) OVER (PARTITION BY family ORDER BY i DESC)) END, 6) AS adjusted FROM m"


def cusum_closed_form(spark, sf):
    rows = updates(spark, sf).filter(F.col("value").isNotNull())
    return _r(drift.cusum(rows, "entity", ["us", "seq"], "value", 50.0, 5.0), ["seq"], "up", "down")


CUSUM = f"""WITH {U}, s AS (SELECT seq, entity, us, sum(value - 55) OVER w AS a, sum(45 - value) OVER w AS b FROM u WHERE value IS NOT NULL WINDOW w AS (PARTITION BY entity ORDER BY us, seq))
SELECT seq, round(a - least(0, min(a) OVER w), 6) AS up, round(b - least(0, min(b) OVER w), 6) AS down FROM s WINDOW w AS (PARTITION BY entity ORDER BY us, seq)"""


def page_hinkley(spark, sf):
    return drift.alarms(updates(spark, sf), "entity", ["us", "seq"], "value", lambda: drift.PageHinkley(0.005, 200.0))


PAGE_HINKLEY = f"""WITH RECURSIVE {U}, x AS (SELECT entity, us, seq, value, row_number() OVER (PARTITION BY entity ORDER BY us, seq) AS i FROM u WHERE value IS NOT NULL),
r(entity, i, n, mean, a, b, lo, hi, alarm, us, seq) AS (
  SELECT DISTINCT entity, 0::BIGINT, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0, 0::BIGINT, 0::BIGINT FROM x
  UNION ALL
  SELECT entity, i, CASE WHEN f = 0 THEN n ELSE 0 END, CASE WHEN f = 0 THEN mean ELSE 0 END, CASE WHEN f = 0 THEN a ELSE 0 END, CASE WHEN f = 0 THEN b ELSE 0 END,
    CASE WHEN f = 0 THEN lo ELSE 0 END, CASE WHEN f = 0 THEN hi ELSE 0 END, f, us, seq FROM (
    SELECT *, CASE WHEN a - lo > 200 THEN 1 WHEN hi - b > 200 THEN -1 ELSE 0 END AS f FROM (
      SELECT entity, i, n, mean, a, b, least(lo, a) AS lo, greatest(hi, b) AS hi, us, seq FROM (
        SELECT entity, i, n, mean, a + value - mean - 0.005 AS a, b + value - mean + 0.005 AS b, lo, hi, us, seq FROM (
          SELECT r.entity, x.i, r.n + 1 AS n, r.mean + (x.value - r.mean) / (r.n + 1) AS mean, r.a, r.b, r.lo, r.hi, x.value, x.us, x.seq FROM r JOIN x ON r.entity = x.entity AND x.i = r.i + 1)))))
SELECT entity, us, seq, alarm FROM r WHERE alarm <> 0"""


def drift_detection(spark, sf):
    rows = updates(spark, sf).withColumn("wrong", (F.col("kind") == "error").cast("double"))
    return drift.alarms(rows, "entity", ["us", "seq"], "wrong", drift.DriftDetection)


def adwin_changes(spark, sf):
    """Changes of the mean of values, which are clipped to 0..200 and scaled to 0..1 as the window's bound asks."""
    rows = updates(spark, sf).withColumn("share", F.least(F.greatest(F.col("value") / 200, F.lit(0.0)), F.lit(1.0)))
    return drift.alarms(rows, "kind", ["us", "seq"], "share", drift.Adwin)


QUERIES = {f.__name__: f for f in (
    class_balance, evenness, robust_summary, histogram_fd, top_k_categories, log_histogram, hill_tail, pearson_slog1p, spearman, cramers_v, entropy_estimators, mutual_information, lagged_information,
    jensen_shannon, psi, ks_two_sample, w1_distance, chi2_homogeneity, fdr_bh, fdr_by, cusum_closed_form, page_hinkley, drift_detection, adwin_changes,
)}
ORACLE = {
    "class_balance": CLASS_BALANCE, "evenness": EVENNESS, "robust_summary": ROBUST, "histogram_fd": HISTOGRAM, "top_k_categories": TOP_K, "log_histogram": LOG_HISTOGRAM, "hill_tail": HILL,
    "pearson_slog1p": PEARSON, "spearman": SPEARMAN, "cramers_v": CRAMERS, "entropy_estimators": ENTROPY, "mutual_information": MI, "lagged_information": LAGGED, "jensen_shannon": JSD, "psi": PSI,
    "ks_two_sample": KS_TWO_SAMPLE, "w1_distance": W1, "chi2_homogeneity": CHI2, "fdr_bh": FDR_BH, "fdr_by": FDR_BY, "cusum_closed_form": CUSUM, "page_hinkley": PAGE_HINKLEY,
}
