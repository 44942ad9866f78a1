"""Pairs by two orders, weighted survival, and exports with templates."""

import math
import random
import struct
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import dominance as d
from tessera.operators import survival
from tessera.sources import exports


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=40))
def test_pairs_within_a_range(rows):
    x, y, a, b = (np.array(c, float) for c in zip(*rows))
    got = d._within(x, y, a[:, None], b[:, None])[:, 0]
    pairs = [(i, j) for i in range(len(x)) for j in range(len(x)) if x[i] < x[j]]
    assert got.tolist() == [sum(a[i] * b[j] for i, j in pairs if test(y[i], y[j])) for test in (lambda p, q: p < q, lambda p, q: p == q, lambda p, q: True)]


@pytest.mark.parametrize("parts", [2, 7, 64])
def test_dominance_of_random_ties(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", None]), rng.choice([0.5, rng.randrange(9), rng.random(), None]), rng.choice([1.0, rng.random(), None]), rng.randrange(4), rng.randrange(4)) for _ in range(500)] + [("alone", 1.0, 1.0, 1, 1), ("none", None, 1.0, 1, 1)]
    df = spark.createDataFrame([(g, None if x is None else float(x), y, a, b) for g, x, y, a, b in rows], "g string, x double, y double, a int, b int").repartition(4)
    got = {r.g: (r.p_less, r.p_tie, r.p_all, r.q_less) for r in d.dominance(df, ["g"], "x", "y", {"p": (F.col("a"), F.col("b")), "q": (F.lit(1), F.col("x"))}, parts).collect()}
    assert set(got) == {"a", None, "alone", "none"}
    for g in got:
        own = [(float(x), y, a, b) for h, x, y, a, b in rows if h == g and x is not None and y is not None]
        p = [(i, j) for i in own for j in own if i[0] < j[0]]
        want = (sum(i[2] * j[3] for i, j in p if i[1] < j[1]), sum(i[2] * j[3] for i, j in p if i[1] == j[1]), sum(i[2] * j[3] for i, j in p), sum(j[0] for i, j in p if i[1] < j[1]))
        assert got[g] == pytest.approx(want)


def test_rank_correlations(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), float(rng.randrange(12)), rng.random() * 3 // 0.25) for _ in range(240)] + [(7, 1.0, 2.0), (8, 1.0, 2.0), (8, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    got = {r.g: r for r in d.kendall(df, "x", "y", ["g"]).collect()}
    far = {r.g: r for r in d.distance_correlation(df, "x", "y", ["g"]).collect()}
    assert set(far) == {0, 1, 2} and got[7].tau is None and got[8].tau is None
    for g in range(3):
        x, y = (np.array(c) for c in zip(*[(a, b) for h, a, b in rows if h == g]))
        sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        up = np.triu(np.ones((len(x), len(x)), bool), 1)
        c, w = ((sx * sy > 0) & up).sum(), ((sx * sy < 0) & up).sum()
        tau = (c - w) / math.sqrt((up.sum() - ((sx == 0) & up).sum()) * (up.sum() - ((sy == 0) & up).sum()))
        assert (got[g].agree, got[g].disagree, got[g].tau) == (c, w, pytest.approx(tau))
        x, y = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
        centred = lambda m: m - m.mean(0) - m.mean(1)[:, None] + m.mean()
        a, b = centred(np.abs(x[:, None] - x)), centred(np.abs(y[:, None] - y))
        assert far[g].dcor == pytest.approx(math.sqrt(max((a * b).mean(), 0) / math.sqrt((a * a).mean() * (b * b).mean())), rel=1e-6)
        n = len(x)

        def u(m):
            m = m - m.sum(0) / (n - 2) - m.sum(1)[:, None] / (n - 2) + m.sum() / ((n - 1) * (n - 2))
            np.fill_diagonal(m, 0)
            return m

        a, b = u(np.abs(x[:, None] - x)), u(np.abs(y[:, None] - y))
        assert far[g].corrected == pytest.approx((a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum()), abs=1e-6)


def test_concordance_has_no_limit_of_levels(spark):
    rows = [(None if i % 2 else "g", float(i * 7919 % 3001), float(i % 97), i % 3 > 0) for i in range(3000)]
    got = {r.q: r for r in survival.concordance(spark.createDataFrame(rows, "q string, risk double, t double, e boolean"), "risk", "t", "e", ["q"]).collect()}
    for q in ("g", None):
        own = [r for r in rows if r[0] == q]
        r, t, e = (np.array([x[i] for x in own]) for i in (1, 2, 3))
        ok = (t[:, None] < t) & e[:, None]
        assert got[q].comparable == ok.sum() and got[q].c == pytest.approx((ok & (r[:, None] > r)).sum() / ok.sum())


def test_curves_where_all_end(spark):
    rows = [("x", 1.0, False), ("x", 2.0, True), ("x", 2.0, False), ("y", 1.0, True), (None, 3.0, False)]
    got = {(r["__g"].q, r["__t"]): (r.s_left, r.s, r.g_left, r.g) for r in d.survival_curves(spark.createDataFrame(rows, "q string, t double, e boolean"), "t", "e", ["q"]).collect()}
    want = {("x", 1.0): (1, 1, 1, 2 / 3), ("x", 2.0): (1, 0.5, 2 / 3, 0), ("y", 1.0): (1, 0, 1, 1), (None, 3.0): (1, 1, 1, 0)}
    assert {k: pytest.approx(v) for k, v in want.items()} == got
    c = {r.q: r.c for r in d.uno_c(spark.createDataFrame([(*r, 1.0) for r in rows], "q string, t double, e boolean, r double"), "r", "t", "e", ["q"]).collect()}
    assert c == {"x": None, "y": None, None: None}


def test_restricted_mean_and_alerts_of_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0, True), (None, 1.0, True), ("a", 5.0, False)], "q string, t double, e boolean")
    assert {r.q: r.rmst for r in survival.restricted_mean(df, "t", "e", ["q"], 60.0).collect()} == {None: 1.0, "a": 60.0}


def v9(sequence, domain, *sets, boot=1000, seconds=1_700_000_000):
    return struct.pack(">HHIIII", 9, len(sets), boot, seconds, sequence, domain) + b"".join(struct.pack(">HH", n, len(b) + 4) + b for n, b in sets)


def v10(sequence, domain, *sets, seconds=1_700_000_000):
    body = b"".join(struct.pack(">HH", n, len(b) + 4) + b for n, b in sets)
    return struct.pack(">HHIII", 10, 16 + len(body), seconds, sequence, domain) + body


def told(number, *fields):
    return struct.pack(">HH", number, len(fields)) + b"".join(struct.pack(">HH", *f[:2]) + (struct.pack(">I", f[2]) if len(f) > 2 else b"") for f in fields)


def test_templates_that_come_late_change_and_go(spark):
    one, two = told(256, (7, 2), (11, 2)), told(256, (11, 2), (7, 2))
    data = lambda *v: (256, struct.pack(f">{len(v)}H", *v))
    rows = [
        ("x", 1, v9(1, 5, data(1, 2))), ("x", 2, v9(2, 5, (0, one), data(3, 4, 5, 6))), ("x", 3, v9(3, 5, (0, two))), ("x", 4, v9(4, 5, data(7, 8) )), ("x", 5, v9(5, 5, (0, one), data(9, 10), (0, two), data(11, 12))),
        ("x", 6, v9(6, 6, data(1, 1))), ("y", 1, v9(1, 5, data(1, 1))), (None, 1, v9(1, 5, (0, one), data(21, 22))),
        ("z", 1, v10(1, 5, (2, told(300, (7, 2), (0x8000 | 9, 0xFFFF, 77))), (300, struct.pack(">HB", 5, 3) + b"abc" + struct.pack(">HBH", 6, 255, 2) + b"hi"))),
        ("z", 2, v10(2, 5, (2, struct.pack(">HH", 300, 0)))), ("z", 3, v10(3, 5, (300, struct.pack(">HB", 7, 0) + b"\0"))), ("z", 4, v10(4, 5, (2, told(300, (11, 2), (4, 1))))),
        ("z", 5, v10(5, 5, (2, struct.pack(">HH", 2, 0)), (300, b"\0\x01\x02"))), ("z", 6, v10(6, 5, (3, struct.pack(">HHH", 400, 2, 1) + struct.pack(">HHHH", 10, 2, 34, 4)), (400, struct.pack(">HI", 3, 100)))),
        ("q", 1, b"\0\x05junk"), ("q", 2, v9(1, 1, (256, b"ab"))[:-1]), ("q", 3, v10(1, 1)[:-1]), ("q", 4, None), ("q", 6, v10(1, 1, (300, b"abcd"))[:-1]), ("q", 5, v9(1, 1, (0, told(12, (7, 2))))),
    ]
    df = spark.createDataFrame(rows, "e string, n long, raw binary").repartition(5)
    good, bad = exports.decoded(exports.export_sets(df, "e", "n", "raw"))
    ports = defaultdict(list)
    for r in good.orderBy("n", "place", "number").collect():
        ports[r.exporter, r.n].append((r.src_port, r.dst_port))
        if r.exporter == "z" and r.n == 1:
            assert bytes(r.other["77:9"]) == (b"abc", b"hi")[r.number]
        if r.n == 6 and r.exporter == "z":
            assert (r.scope, r.sampling, r.input) == (1, 100, 3)
    assert ports == {("x", 1): [(1, 2)], ("x", 2): [(3, 4), (5, 6)], ("x", 4): [(8, 7)], ("x", 5): [(9, 10), (12, 11)], (None, 1): [(21, 22)], ("z", 1): [(5, None), (6, None)], ("z", 3): [(None, 7)], ("z", 6): [(None, None)]}
    why = {(r.exporter, r.n): r._quarantine for r in bad.collect()}
    assert why == {
        ("x", 6): "no template 256", ("y", 1): "no template 256", ("z", 5): "no template 300", ("q", 1): "no version 9 or 10", ("q", 2): "set 256 of length 6", ("q", 3): "header is cut", ("q", 6): "length 24 of 23 bytes",
        ("q", 4): "no version 9 or 10", ("q", 5): "template number 12",
    }


def test_sequence_gaps_wrap(spark):
    rows = [(1, 1, (1 << 32) - 2, 1), (1, 2, (1 << 32) - 1, 1), (1, 3, 2, 1), (1, 4, 1, 1), (1, 5, 2, None), (1, 6, 90, 1), (None, 1, 5, 1)]
    got = [(r.k, r.n, r.lost, r.early) for r in exports.sequence_gaps(spark.createDataFrame(rows, "k int, n int, s long, a int"), ["k"], "n", "s", "a").orderBy("k", "n").collect()]
    assert got == [(None, 1, None, False), (1, 1, None, False), (1, 2, 0, False), (1, 3, 2, False), (1, 4, 0, True), (1, 5, 0, False), (1, 6, None, False)]
