"""Every query against its SQL, and the queries without SQL against brute force."""

import math
from collections import defaultdict

import pytest
from conftest import rows_of

from tessera.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, duck, data, name):
    got, want = registry.QUERIES[name](spark, data).toPandas(), duck.execute(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_query_has_sql_or_a_test_here():
    assert set(registry.QUERIES) - set(registry.ORACLE) == {"drift_detection", "adwin_changes", "near_duplicate_rows", "bounded_windows", "core_numbers", "logistic_detector"} | ELSEWHERE


#: Held against slow definitions in test_series.py, test_streams_flows.py and test_calibrate.py.
ELSEWHERE = {"adf", "pelt", "bocpd", "block_lengths", "stationary_interval", "flow_port_evidence", "pacf", "kpss_automatic", "likeliest_temperature"}


def _series(spark, data, value):
    from tessera.sources.tables import updates

    out = defaultdict(list)
    for r in updates(spark, data).orderBy("us", "seq").collect():
        out[r.entity].append((r.us, r.seq, value(r)))
    return out


def test_drift_detection(spark, data):
    want = set()
    for entity, rows in _series(spark, data, lambda r: int(r.kind == "error")).items():
        n = wrong = 0
        p0 = s0 = math.inf
        for us, seq, e in rows:
            n, wrong = n + 1, wrong + e
            if n < 30:
                continue
            p = wrong / n
            s = (p * (1 - p) / n) ** 0.5
            if p + s < p0 + s0:
                p0, s0 = p, s
            if p + s > p0 + 3 * s0:
                want.add((entity, us, seq, 2))
                n, wrong, p0, s0 = 0, 0, math.inf, math.inf
            elif p + s > p0 + 2 * s0:
                want.add((entity, us, seq, 1))
    assert {tuple(r) for r in registry.QUERIES["drift_detection"](spark, data).collect()} == want


def test_adwin_cuts_where_the_mean_jumps(spark):
    from tessera.operators.drift import Adwin, alarms

    rows = [(0, i, float(i % 2)) for i in range(300)] + [(0, i, 5.0 + i % 2) for i in range(300, 600)] + [(1, i, float(i % 2)) for i in range(600)]
    got = alarms(spark.createDataFrame(rows, "g int, t int, x double"), "g", ["t"], "x", Adwin).collect()
    assert got and all(r.g == 0 and r.t >= 300 for r in got) and min(r.t for r in got) < 330


def test_bounded_windows(spark, data):
    from tessera.sources.tables import updates

    rows = sorted((r.kind, r.us, r.seq, r.entity) for r in updates(spark, data).collect())
    counts, key = defaultdict(int), None
    for kind, _, _, entity in rows:
        if kind != key:
            key, known, n, w = kind, set(), 0, 0
        elif n == 256 or len(known | {entity}) > 100:
            known, n, w = set(), 0, w + 1
        known.add(entity)
        n += 1
        counts[kind, w] += 1
    assert {(r.kind, r.window): r.n for r in registry.QUERIES["bounded_windows"](spark, data).collect()} == dict(counts)


def test_core_numbers(spark, data, duck):
    pairs = duck.execute("SELECT DISTINCT least(l_suppkey, l_partkey), greatest(l_suppkey, l_partkey) FROM lineitem WHERE l_suppkey <> l_partkey").fetchall()
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    core, k = {}, 0
    while near:
        v = min(near, key=lambda x: len(near[x]))
        k = max(k, len(near[v]))
        core[v] = k
        for u in near.pop(v):
            near[u].discard(v)
    from tessera.operators import graph

    got = graph.core_numbers(spark.createDataFrame(pairs, "a long, b long").coalesce(1))
    assert {r.v: r.core for r in got.collect()} == core


def test_near_duplicate_rows(spark):
    from tessera.operators.dedup import near_duplicate_rows

    rows = [(1, 100.0, 5.0, "a"), (2, 100.5, 5.0, "a"), (3, 100.0, 5.0, "a"), (4, 900.0, 5.0, "a"), (5, 100.0, 5.0, "b"), (6, None, None, None), (7, None, None, None)]
    df = spark.createDataFrame(rows, "id long, x double, y double, c string")
    got = {tuple(r) for r in near_duplicate_rows(df, "id", ["x", "y"], ["c"], rows=2).collect()}
    assert got == {(1, 2)}
    many = spark.range(500).selectExpr("id", "100 + id * 0.001 AS x", "5.0D AS y", "'a' AS c")
    linked = near_duplicate_rows(many, "id", ["x", "y"], ["c"], rows=2)
    assert linked.count() <= 24 * 4 * 500 and linked.selectExpr("explode(array(a, b)) AS v").distinct().count() == 500


def test_logistic_finds_a_plain_rule(spark):
    from tessera.operators.forecast import hazard_model, isotonic, logistic

    df = spark.range(2000).selectExpr("CAST(id % 20 AS DOUBLE) AS x", "CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(id % 3 AS DOUBLE) END AS z", "CAST(id % 20 >= 10 AS DOUBLE) AS y")
    out = logistic(df, ["x", "z"], "y").transform(df)
    assert out.filter("prediction = y").count() > 1900
    three = df.selectExpr("x", "CAST(floor(x / 7) AS DOUBLE) AS y")
    assert logistic(three, ["x"], "y", multinomial=True).transform(three).filter("prediction = y").count() > 1700
    waits = spark.range(900).selectExpr("CAST(id % 2 AS DOUBLE) AS x", "CASE WHEN id % 2 = 1 THEN 1 + id % 3 ELSE 6 + id % 3 END AS step", "true AS event")
    model = hazard_model(waits, ["x"], "step", "event", 10)
    assert model.stages[-1].coefficients[0] > 0
    steps = isotonic(spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1)], "s double, y int"), "s", "y").orderBy("score").collect()
    assert [round(r.chance, 9) for r in steps] == [0.0, 0.5, 0.5, 1.0]


def test_logistic_detector_ranks_held_out_years(spark, data):
    rows = registry.QUERIES["logistic_detector"](spark, data).collect()
    assert rows and all(r.positives > 0 and 0.3 < r.auroc < 0.7 for r in rows)  # flags don't depend on the features here
