"""Slow definitions of operators that had only loose tests."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import drift, labels


def components_by_hand(rows, tolerance, least):
    """Smallest key of each component of all similar pairs of distinct rows; rows without a partner aren't there."""
    first = {}
    for key, *cells in rows:
        first[tuple(cells)] = min(key, first.get(tuple(cells), key))
    reps = [(k, c) for c, k in first.items()]
    slog = lambda v: math.copysign(math.log1p(abs(v)), v)
    root = {k: k for k, _ in reps}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    linked = set()
    for i, (a, x) in enumerate(reps):
        for b, y in reps[:i]:
            same = sum((u is None and v is None) or (u is not None and v is not None and (u == v if isinstance(u, str) else abs(slog(u) - slog(v)) <= tolerance)) for u, v in zip(x, y))
            if same / len(x) >= least - 1e-12:
                linked |= {a, b}
                a1, b1 = find(a), find(b)
                root[max(a1, b1)] = min(a1, b1)
    return {k: find(k) for k in linked}


@pytest.mark.parametrize("least", [0.95, 0.75])
def test_near_duplicate_groups_are_the_components_of_all_pairs(spark, least):
    from tessera.operators.dedup import near_duplicate_groups

    rng = random.Random(11)
    rows = []
    for i in range(240):  # a dense chain, which is one large bucket, and scattered rows
        dense = i < 150
        x = 100.0 + i * 0.4 if dense else rng.choice([None, rng.random() * 3000])
        rows.append((i, x, 5.0 + (i % 7) * (0.01 if dense else 3.0), "a" if dense else rng.choice("abc"), None if i % 50 == 0 else "z"))
    rows += [(900 + i, *rows[i][1:]) for i in range(3)]  # equal rows are one
    df = spark.createDataFrame(rows, "id long, x double, y double, c string, d string").repartition(3)
    got = {r.id: r.component for r in near_duplicate_groups(df, "id", ["x", "y"], ["c", "d"], least=least, rows=3, most=16).collect()}
    assert got == components_by_hand(rows, 0.05, least)


def cuts_by_hand(x, delta):
    """The window of Bifet and Gavalda with every value kept by itself: after each value the oldest go while any cut differs."""
    window, out = [], []
    for v in x:
        window.append(v)
        cut = 0
        while len(window) > 1:
            n, spread, log = len(window), np.var(window), math.log(2 * math.log(max(len(window), 2)) / delta)
            differs = False
            for m in range(5, n - 4):
                inverse = 1 / m + 1 / (n - m)
                if abs(np.mean(window[:m]) - np.mean(window[m:])) > math.sqrt(2 * inverse * spread * log) + 2 / 3 * inverse * log:
                    differs = True
                    break
            if not differs:
                break
            window.pop(0)
            cut = 1
        out.append(cut)
    return out


def test_adwin_equals_its_definition():
    rng = np.random.default_rng(3)
    x = np.clip(np.r_[rng.normal(0.2, 0.1, 60), rng.normal(0.7, 0.1, 60), rng.normal(0.5, 0.05, 40)], 0, 1)
    got = drift.Adwin(0.002, buckets=1000).scan(x).tolist()
    assert got == cuts_by_hand(x.tolist(), 0.002) and sum(got) > 0
    coarse = drift.Adwin(0.002).scan(x)
    assert abs(int(coarse.argmax()) - got.index(1)) <= 16  # blocks only delay a cut


def test_logistic_weights_on_a_known_rule(spark):
    from tessera.operators.forecast import logistic

    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 2))
    y = rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0])))
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    out = logistic(df, ["a", "b"], "y").transform(df)
    assert out.filter("prediction = y").count() / 4000 > 0.78  # the rule itself is right in about 0.82 of the rows
    ranked = out.select("a", "b", "prediction").toPandas()
    assert ranked[ranked.a > 0.5].prediction.mean() > 0.95 and ranked[ranked.a < -1].prediction.mean() < 0.05
    assert abs(ranked[ranked.b > 0].prediction.mean() - ranked[ranked.b <= 0].prediction.mean()) < 0.1


def test_labels_that_are_mapped_in_two_ways(spark):
    df = spark.createDataFrame([(1, "Web Attack \x96 XSS"), (2, "webattackxss"), (3, None), (4, "new")], "i int, l string")
    one = spark.createDataFrame([("WEB-attack xss", 1), ("web attack XSS", 1)], "raw string, malicious int")
    assert sorted((r.i, r.malicious, r.mapped) for r in labels.mapped_labels(df, "l", one).collect()) == [(1, 1, True), (2, 1, True), (3, None, True), (4, None, False)]
    with pytest.raises(ValueError, match="two ways"):
        labels.mapped_labels(df, "l", one.union(spark.createDataFrame([("webattackxss", 0)], one.schema)))


def test_alerts_of_groups_without_times_and_null_groups(spark):
    from tessera.operators.audit import alerts_per_day

    day = 86_400_000_000
    rows = [("a", 1, 0, True), ("a", 1, 2 * day, True), ("p", 2, None, True), (None, 3, 0, True), (None, 3, day, False)]
    got = {r.g: (r.alerts, r.days, r.per_day) for r in alerts_per_day(spark.createDataFrame(rows, "g string, n int, us long, alert boolean"), F.col("alert"), "us", ["n"], ["g"]).collect()}
    assert got == {"a": (2, 2.0, 1.0), "p": (1, None, None), None: (1, 1.0, 1.0)}
