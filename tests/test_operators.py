"""Small tables with answers worked out by hand: ties, absent values, empty groups, empty tables."""

import struct

import numpy as np
import pytest

from tessera.functions import status as st
from tessera.operators import describe, drift, joins, ranking, splits, survival, windows
from tessera.operators.ranks import quantiles, running_totals, value_ranks


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_absence_is_null_and_weights_follow_status(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, 1.0) for i in range(5)], "s int, v double")
    got = rows(df.select("s", st.present(F.col("v"), F.col("s")), st.weight(F.col("s"), {1: 0.5}), st.status_name(F.col("s"))), "s")
    assert got == [(0, 1.0, 1.0, "OBSERVED"), (1, 1.0, 0.5, "STALE"), (2, 1.0, 1.0, "LOW_RELIABILITY"), (3, None, 0.0, "NOT_SUPPLIED"), (4, None, 0.0, "NOT_OBSERVABLE")]


def test_running_totals_and_ranks_with_ties(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 1, 2, 5, None)] + [("b", 7)], "g string, x int")
    assert rows(value_ranks(df, "x", ["g"]).select("g", "x", "n", "midrank", "total_n"), "g", "x") == [("a", 1, 2, 1.5, 4), ("a", 2, 1, 3.0, 4), ("a", 5, 1, 4.0, 4), ("b", 7, 1, 1.0, 1)]
    empty = running_totals(df.limit(0).selectExpr("g", "x", "1 AS n"), "x", ["n"], ["g"])
    assert empty.collect() == []


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), ("a", 11.0), ("b", 3.0)], "g string, x double")
    assert rows(quantiles(df, "x", {"m": 0.5, "q": 0.25}, ["g"]), "g") == [("a", 6.0, 1.75), ("b", 3.0, 3.0)]


def test_asof_takes_the_latest_row_up_to_the_time(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k int, t long")
    right = spark.createDataFrame([(1, 10, "x"), (1, 11, "y"), (2, 6, "z")], "k int, u long, v string")
    assert rows(joins.asof(left, right, ["k"], "t", "u", ["v"]), "k", "t") == [(1, 10, "x"), (1, 20, "y"), (2, 5, None)]
    again = joins.asof_periods(left, right.withColumn("at", right.u), ["k"], "t", "u", ["v"], 3)
    assert rows(again, "k", "t") == [(1, 10, "x"), (1, 20, "y"), (2, 5, None)]


def test_intervals_that_touch_are_one(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 8, 9), (2, 0, 1)], "k int, a long, b long")
    assert rows(joins.merged_intervals(df, ["k"], "a", "b"), "k", "a") == [(1, 0, 7), (1, 8, 9), (2, 0, 1)]
    points = spark.createDataFrame([(1, 5), (1, 10)], "k int, t long")
    assert len(rows(joins.interval(points, df, ["k"], "t", "a", "b", 3), "a")) == 2


def test_first_alert_counts_the_closed_window(spark):
    e = spark.createDataFrame([(1, 7, 100, 200), (2, 8, 100, 200)], "episode int, k int, start long, completion long")
    u = spark.createDataFrame([(7, 90, 0.9), (7, 210, 0.9), (8, 211, 0.9), (8, 150, 0.1)], "k int, time long, score double")
    got = rows(joins.first_alerts(e, u, ["k"], 110, 10, 0.5, 100).select("episode", "alert", "detected", "lead"), "episode")
    assert got == [(1, 90, False, 110), (2, None, False, None)]


def test_ranking_with_ties_and_a_missing_class(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 1.0, False), ("a", 0.0, False), ("b", 1.0, True)], "g string, s double, y boolean")
    assert rows(ranking.ranking(df, "s", "y", ["g"]).select("g", "auroc", "average_precision"), "g") == [("a", 0.75, 0.5), ("b", None, 1.0)]
    assert rows(ranking.conformal(df, "s", "y", ["g"], "0.05").select("g", "k", "threshold"), "g") == [("a", 3, None)]
    assert rows(ranking.operating_point(df, "s", "y", ["g"], 0.0), "g") == [("a", None, 0.0, 0.0), ("b", None, 0.0, 0.0)]


def test_kaplan_meier_reaches_zero(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True)], "g string, t long, e boolean")
    assert [(r[1], r[2], r[3], round(r[4], 9)) for r in rows(survival.kaplan_meier(df, "t", "e", ["g"]), "t")] == [(1, 3, 1, 0.666666667), (3, 1, 1, 0.0)]


def test_fdr_leaves_nulls_out(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "id int, p double").selectExpr("*", "1 AS f")
    assert [(r[0], r[1] if r[1] is None else round(r[1], 9)) for r in rows(drift.fdr(df, "p", ["f"]).select("id", "adjusted"), "id")] == [(1, 0.03), (2, 0.04), (3, 0.04), (4, None)]


def test_flow_deltas_and_poisoned_sums(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 2)], "f string, t long, total long")
    assert [r[3] for r in rows(windows.flow_deltas(df, ["f"], ["t"], "total"), "t")] == [5, 4, None]
    w = spark.createDataFrame([("a", 10, 1.0), ("a", 11, None), ("a", 20, 2.0)], "k string, t long, v double")
    got = rows(windows.window_states(w, ["k"], "t", 10, {}, ["v"], {}), "g")
    assert got == [("a", 1, 1, 1.0), ("a", 2, 2, None)]


def test_count_series_has_true_zeros(spark):
    df = spark.createDataFrame([("a", 0), ("a", 35)], "k string, t long")
    assert rows(windows.count_series(df, ["k"], "t", 10), "bin") == [("a", 0, 1), ("a", 1, 0), ("a", 2, 0), ("a", 3, 1)]


def test_burstiness_of_few_gaps(spark):
    df = spark.createDataFrame([("a", 0), ("a", 10), ("b", 1)], "k string, t long")
    got = rows(windows.burstiness(df, ["k"], ["t"]).select("k", "n", "mean", "b", "b_finite", "memory"), "k")
    assert got == [("a", 1, 10.0, -1.0, None, None)]


def test_chronological_split_purges(spark):
    df = spark.createDataFrame([("s", i) for i in range(10)], "s string, t int")
    got = [r[2] for r in rows(splits.chronological(df, ["s"], ["t"], {"train": 0.6, "test": 0.2, "val": 0.2}, 1), "t")]
    assert got == ["train"] * 6 + ["excluded", "test", "excluded", "val"]


def test_evenness_of_one_class(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "g string, c int")
    got = rows(describe.evenness(df, "g", "c").select("g", "classes", "shannon", "pielou"), "g")
    assert got[0] == ("a", 1, 0.0, None) and round(got[1][3], 9) == 1.0


def test_page_hinkley_restarts():
    d = drift.PageHinkley(0.0, 3.0)
    assert d.scan(np.array([0, 0, 0, 10, 10, 10.0])).tolist()[3:] == [1, 0, 0]
    x = np.random.default_rng(0).standard_normal(3000).cumsum()
    whole, parts = drift.PageHinkley(0.1, 9.0), drift.PageHinkley(0.1, 9.0)
    assert whole.scan(x).tolist() == [int(parts.scan(x[i : i + 1])[0]) for i in range(len(x))]
    e = (np.random.default_rng(1).random(3000) < np.repeat([0.1, 0.4, 0.2], 1000)).astype(float)
    whole, parts = drift.DriftDetection(), drift.DriftDetection()
    got = whole.scan(e).tolist()
    assert 2 in got and got == [int(parts.scan(e[i : i + 1])[0]) for i in range(len(e))]


def _frame(payload=b"hello"):
    udp = struct.pack(">HHHH", 53, 4000, 8 + len(payload), 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(udp), 0, 0, 64, 17, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2]))
    return b"\0" * 12 + b"\x08\x00" + ip + udp


def test_captures_and_flow_exports(spark, tmp_path):
    from tessera.sources.packets import captures, flow_exports

    f = _frame()
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    (tmp_path / "a.pcap").write_bytes(head + struct.pack("<IIII", 7, 5, len(f), len(f)) + f + struct.pack("<IIII", 8, 0, 3, 3) + b"abc" + struct.pack("<IIII", 9, 0, 99, 99) + b"cut")
    got = rows(captures(spark, str(tmp_path / "a.pcap")).drop("file"), "number")
    assert got == [(0, 7_000_005_000, len(f), len(f), "10.0.0.1", "10.0.0.2", 17, 53, 4000, None, 5), (1, 8_000_000_000, 3, 3, *[None] * 7)]
    record = bytes([10, 0, 0, 1, 10, 0, 0, 2]) + b"\0" * 8 + struct.pack(">IIIIHH", 3, 400, 1000, 2000, 80, 5000) + bytes([0, 0x12, 6, 0]) + b"\0" * 8
    (tmp_path / "a.nf5").write_bytes(struct.pack(">HHIIIIBBH", 5, 1, 5000, 100, 0, 42, 0, 0, 0) + record)
    assert rows(flow_exports(spark, str(tmp_path / "a.nf5")).drop("file"), "sequence") == [(42, 100, "10.0.0.1", "10.0.0.2", 80, 5000, 6, 18, 3, 400, 96000, 97000)]


def test_zeek_and_json_and_leef(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.sources import logs

    (tmp_path / "conn.log").write_text("#separator \\x09\n#fields\tts\tuid\tservice\n1.5\tC1\t-\n2.5\tC2\t(empty)\nbroken\n")
    got = rows(logs.zeek(spark, str(tmp_path / "conn.log")), "ts")
    assert ("1.5", "C1", None, None, None) in got and ("2.5", "C2", "", None, None) in got and any(r[3] == "1 values" for r in got)
    (tmp_path / "eve.json").write_text('{"a": 1, "z": "y"}\n{"a": \n')
    got = logs.json_lines(spark, str(tmp_path / "eve.json"), "a INT").collect()
    assert {(r.a, tuple((r._rest or {}).items()), r._quarantine is None) for r in got} == {(1, (("z", "y"),), True), (None, (), False)}
    line = spark.createDataFrame([("LEEF:1.0|V|P|2|id|src=1.2.3.4\tdst=5",), ("x",)], "l string").select(*logs.leef(F.col("l"))).collect()
    assert line[0].attributes == {"src": "1.2.3.4", "dst": "5"} and line[0].event_id == "id" and line[1]._quarantine == "not LEEF"


def test_chained_rows_show_changes(spark):
    from pyspark.sql import functions as F

    from tessera.sources.sinks import broken, chained, markdown

    df = chained(spark.createDataFrame([(1, i, f"v{i}") for i in range(4)], "g int, i int, v string"), "g", "i", ["v"])
    assert broken(df, "g", "i", ["v"]).count() == 0
    changed = df.withColumn("v", F.when(F.col("i") == 2, "other").otherwise(F.col("v")))
    assert [r.i for r in broken(changed, "g", "i", ["v"]).orderBy("i").collect()] == [2, 3]
    assert markdown(spark.createDataFrame([(1, "a|b")], "x int, y string")) == "| x | y |\n| --- | --- |\n| 1 | a\\|b |"
    with pytest.raises(ValueError):
        markdown(spark.range(5), 3)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[:2] == ["kind", "bin"]


def _joined(pairs):
    """Node -> smallest node of its component, by union-find."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {v: find(v) for v in list(root)}


@pytest.mark.parametrize("least", [0.95, 0.6])
def test_large_buckets_lose_no_component(spark, least):
    from math import log1p

    from tessera.operators.dedup import near_duplicate_groups, near_duplicate_rows

    # `flat` is the one banded column, so that all rows share one bucket of over 64; only close pairs of x are similar
    flat = ("x", "y", "c")[__import__("random").Random(0).choice(range(3))]
    data = []
    for i in range(400):
        spread = 1.3 ** (i // 2) * (1.04 if i % 2 else 1.0)
        data.append((i, spread if flat != "x" else 5.0, spread if flat == "x" else 5.0 + i % 2 * 0.01, str(i // 4) if flat != "c" else "a"))
    df = spark.createDataFrame(data, "id long, x double, y double, c string")
    like = lambda p, q: (abs(log1p(p[1]) - log1p(q[1])) <= 0.05) + (abs(log1p(p[2]) - log1p(q[2])) <= 0.05) + (p[3] == q[3])
    want = {(p[0], q[0]) for p in data for q in data if p[0] < q[0] and like(p, q) / 3 >= least}
    how = {"bands": 1, "rows": 1, "least": least}
    got = {tuple(r) for r in near_duplicate_rows(df, "id", ["x", "y"], ["c"], **how).collect()}
    assert want and got <= want
    assert {r.id: r.component for r in near_duplicate_groups(df, "id", ["x", "y"], ["c"], **how).collect()} == _joined(want)


def test_components_and_paths_take_every_row(spark, data, duck):
    from tessera.plans import registry

    pairs = duck.execute("SELECT DISTINCT l_orderkey, -1 - l_partkey FROM lineitem").fetchall()
    assert {r.v: r.component for r in registry.QUERIES["whole_graph_components"](spark, data).collect()} == _joined(pairs)
    lengths = dict(duck.execute("SELECT user_id, count(*) FROM events GROUP BY 1").fetchall())
    got = {r.entity: len(r.path) for r in registry.QUERIES["whole_path_distance"](spark, data).collect()}
    assert got == {k: n for k, n in lengths.items() if k + 1 in lengths} and max(got.values()) > 30


def test_audit_edges(spark):
    from pyspark.sql import functions as F

    from tessera.operators import audit

    rows = [(1, 1, 3, True), (1, 0, 2, True), (2, 7, -1, True), (3, 1, 20, True), (None, None, -1, False), (4, 1, -1, False), (5, None, -1, True)]
    df = spark.createDataFrame(rows, "seq long, malicious int, stage int, mapped boolean")
    got = {r.rule: r.violations for r in audit.label_violations(df, "seq").collect()}
    assert got == {"malicious": 1, "stage": 1, "unmapped": 1, "stage_of_harmless": 1, "no_key": 1, "repeated_key": 2}
    assert {r.violations for r in audit.label_violations(df.limit(0), "seq").collect()} == {0}
    cells = spark.createDataFrame([(0, None, "a"), (0, 1, "a"), (1, 1, "a"), (1, 1, "b"), (1, None, None)], "g int, c int, y string")
    found = {r.g: r for r in audit.error_bounds(cells, "c", "y", ["g"]).collect()}
    assert (found[0].n, found[0].classes, found[0].bits, found[0].fano, found[0].error) == (2, 1, 0.0, 0.0, 0.0)
    assert abs(found[1].bits - 1) < 1e-9 and abs(found[1].fano - 0.5) < 1e-6 and found[1].error == 0.5 and found[1].coefficient == 0
    low, high = spark.range(1).select(*audit.nearest_bounds(F.lit(0.32), F.lit(2))).first()
    assert abs(low - 0.2) < 1e-9 and high == 0.32
    flat = spark.createDataFrame([(0, t, 2.0) for t in range(5)], "g int, t int, x double")
    assert audit.kpss(flat, "t", "x", ["g"], 2).first().kpss is None
    one = spark.createDataFrame([("k", 1, 5), ("k", 2, 5)], "kind string, net int, us long")
    assert audit.alerts_per_day(one, F.lit(True), "us", ["net"], ["kind"]).first().per_day is None
