"""Calibration against slow definitions, with null groups, ties and single rows."""

import math
import random

import numpy as np
import pytest

from tessera.operators import calibrate as c


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = [(g, p, rng.random() < p**k) for g, k, n in (("low", 1.0, 400), (None, 2.5, 300), ("flat", 0.2, 60)) for p in (round(rng.random(), rng.choice([1, 2, 6])) for _ in range(n))]
    return [*out, ("one", 0.3, True), ("same", 0.5, True), ("same", 0.5, False), ("none", None, True), ("low", 0.4, None)]


def own(rows, g):
    return zip(*[(p, float(y)) for h, p, y in rows if h == g and p is not None and y is not None])


def bins_of(p, b):
    p = np.array(p)
    s = np.sort(p)
    edges = [s[np.searchsorted(np.arange(1, len(s) + 1), len(s) * j / b - 1e-9)] for j in range(1, b)]
    return np.array([sum(e <= v for e in edges) for v in p])


def test_bins_of_equal_mass_and_sweep(spark, rows):
    df = spark.createDataFrame(rows, "g string, p double, y boolean").repartition(3)
    mass = {r.g: r for r in c.mass_calibration(df, "p", "y", ["g"], 7).collect()}
    sweep = {r.g: r for r in c.sweep_calibration(df, "p", "y", ["g"]).collect()}
    assert set(mass) == set(sweep) == {"low", None, "flat", "one", "same"}
    for g in mass:
        p, y = map(np.array, own(rows, g))

        def ece(b, p=p, y=y):
            k = bins_of(p, b)
            return sum(abs(y[k == i].sum() - p[k == i].sum()) for i in set(k.tolist())) / len(p)

        assert mass[g].ece == pytest.approx(ece(7))
        best = 1
        for b in range(2, len(p) + 1):
            k = bins_of(p, b)
            f = [y[k == i].mean() for i in sorted(set(k.tolist()))]
            if len(f) < 2 or any(u > v for u, v in zip(f, f[1:])):
                break
            best = b
        assert sweep[g].bins == best and sweep[g].ece == pytest.approx(ece(best))


def test_temperature(spark, rows):
    got = {r.g: r.temperature for r in c.temperature(spark.createDataFrame(rows, "g string, p double, y boolean"), "p", "y", ["g"]).collect()}
    assert set(got) == {"low", None, "flat", "one", "same"} and got["one"] == 20.0
    for g in ("low", None, "flat"):
        p, y = map(np.array, own(rows, g))
        q = np.clip(p, 1e-12, 1 - 1e-12)
        z = np.log(q) - np.log1p(-q)
        loss = lambda t: np.logaddexp(0, -z / t * (2 * y - 1)).sum()
        at = loss(got[g])
        assert all(at <= loss(t) + 1e-9 for t in [got[g] * f for f in (0.9, 0.999, 1.001, 1.1)] if 0.05 <= t <= 20)
    assert abs(got["low"] - 1) < 0.35


def test_several_classes(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0, 0.0], 0), (None, [0.25, 0.75, 0.0], 0), ("x", [0.5, 0.0, 0.5], 1)], "g string, q array<double>, l int")
    got = {r.g: r for r in c.multiclass(df, "q", "l", ["g"], 2).collect()}
    assert got[None].n == 2 and got[None].brier == pytest.approx((0 + 0.75**2 * 2) / 2) and got[None].log_loss == pytest.approx(-math.log(0.25) / 2)
    # class 0: 1.0 and 0.25 in bins of their own, both right; class 1: 0 and 0.75, none right; class 2 is never there nor predicted
    assert got[None].classwise == pytest.approx(((0 + 0.75) / 2 + (0 + 0.75) / 2) / 2) and got["x"].log_loss == math.inf
