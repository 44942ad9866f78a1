"""Steps that a reviewer found slow, or less than their whole job: the same results by brute force."""

import numpy as np


def _ways(low, high, unknown):
    """By brute force: for each node of low, how many of high's it reaches over one between, the least and the largest time."""
    best = {}
    for v, x, t in low:
        for u, y, s in high:
            if x == y and u != v:
                later, before = max(t, s), best.setdefault(v, {}).get(u, unknown)
                best[v][u] = later if before == unknown else before if later == unknown else min(before, later)
    times = {v: [t for t in us.values() if t != unknown] or [unknown] for v, us in best.items()}
    return {v: (len(us), min(times[v]), max(times[v])) for v, us in best.items()}


def test_least_times_look_at_two_nodes_once(monkeypatch):
    from tessera.operators import graph

    rng = np.random.default_rng(21)

    def side(nodes, n, between):
        met = {(int(v), int(x)): graph.NONE if rng.random() < 0.2 else int(rng.integers(-3, 30)) for v, x in zip(rng.integers(*nodes, n), rng.integers(0, between, n))}
        return [(v, x, t) for (v, x), t in met.items()]

    def found(out):
        return {int(v): (int(n), int(lo), int(hi)) for o in out for v, n, lo, hi in zip(*o) if n}

    columns = lambda rows: tuple(np.array(c, np.int64) for c in zip(*rows))
    for cells, ways in ((1 << 23, 1 << 20), (1 << 23, 5), (40, 1 << 20), (1, 1)):
        monkeypatch.setattr(graph, "CELLS", cells)
        monkeypatch.setattr(graph, "WAYS", ways)
        for n, between in ((1, 1), (60, 80), (150, 9), (900, 4)):
            low, high = side((0, 300), n, between), side((500, 530), n, between)
            assert found(graph._least_times(columns(low))) == _ways(low, low, graph.NONE)
            assert found(graph._least_times(columns(low), columns(high))) == _ways(low, high, graph.NONE) | _ways(high, low, graph.NONE)


def test_few_contacts_are_cut_for_all_cores(spark, monkeypatch):
    from tessera.operators import graph

    ranges, real = [], graph.ranged
    monkeypatch.setattr(graph, "ranged", lambda df, value, parts: (ranges.append(parts), real(df, value, parts))[1])
    monkeypatch.setattr(graph, "LEAST_CONTACTS", 10)
    rows = [(i, i % 7, i) for i in range(100)]
    got = {r.v: (r.n, r["first"], r["last"]) for r in graph.second_contact_times(spark.createDataFrame(rows, "v long, x long, t long")).collect()}
    assert got == _ways(rows, rows, None) and ranges[0] >= 4


def test_triads_are_those_of_all_triples(spark):
    from itertools import combinations, permutations

    from tessera.operators import graph

    classes = {  # arcs between A, B, C = 0, 1, 2 as the reference has them
        "003": [], "012": ["01"], "102": ["01", "10"], "021D": ["10", "12"], "021U": ["01", "21"], "021C": ["01", "12"], "111D": ["01", "10", "21"], "111U": ["01", "10", "12"], "030T": ["01", "21", "02"],
        "030C": ["10", "21", "02"], "201": ["01", "10", "12", "21"], "120D": ["10", "12", "02", "20"], "120U": ["01", "21", "02", "20"], "120C": ["01", "12", "02", "20"],
        "210": ["01", "12", "21", "02", "20"], "300": ["01", "10", "12", "21", "02", "20"],
    }
    name = {frozenset((p[int(a)], p[int(b)]) for a, b in arcs): c for c, arcs in classes.items() for p in permutations(range(3))}
    rng = np.random.default_rng(22)
    for n, m in ((14, 60), (25, 60), (12, 130), (40, 30)):
        edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))]
        edges += edges[:5] + [(n + 1, n + 1)]
        arcs = {(a, b) for a, b in edges if a != b}
        want = dict.fromkeys(classes, 0)
        for t in combinations(sorted({v for a in arcs for v in a}), 3):
            want[name[frozenset((i, j) for i in range(3) for j in range(3) if (t[i], t[j]) in arcs)]] += 1
        assert {r.triad: int(r.n) for r in graph.triad_census(spark.createDataFrame(edges, "src long, dst long")).collect()} == want
    assert {int(r.n) for r in graph.triad_census(spark.createDataFrame([(1, 1)], "src long, dst long")).collect()} == {0}
    many = spark.range(2_000_000).selectExpr("2 * id AS src", "2 * id + 1 AS dst")  # more triples than 64 bits hold
    got = {r.triad: int(r.n) for r in graph.triad_census(many).collect()}
    n = 4_000_000
    assert got["003"] == n * (n - 1) * (n - 2) // 6 - got["012"] > 1 << 63 and got["012"] == n // 2 * (n - 2) and sum(map(bool, got.values())) == 2


def _cores(pairs):
    near, core, k = {}, {}, 0
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    while near:
        v = min(near, key=lambda x: len(near[x]))
        k = max(k, len(near[v]))
        core[v] = k
        for u in near.pop(v):
            near[u].discard(v)
    return core


def test_settled_nodes_leave_the_graph(spark, monkeypatch):
    from tessera.operators import graph

    names, real = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: (names.append(name), real(df, name))[1])
    rng = np.random.default_rng(23)
    parts = {(int(a), 100 + int(b)) for a, b in zip(rng.integers(0, 6, 900), rng.integers(0, 200, 900))}
    mixed = {(int(min(p)), int(max(p))) for p in rng.integers(0, 40, (160, 2)) if p[0] != p[1]}
    chain = {(i, i + 1) for i in range(12)} | {(20, 21), (21, 22), (20, 22)}
    for pairs in (parts, mixed, chain, parts | {(100 + a, 120 + b) for a, b in mixed if a != b + 20}):
        pairs = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
        assert {r.v: r.core for r in graph.core_numbers(spark.createDataFrame(sorted(pairs), "a long, b long").coalesce(1)).collect()} == _cores(pairs)
    assert names.count("core-edges") > 4  # not only the pairs of each graph as given
    assert graph.core_numbers(spark.createDataFrame([], "a long, b long")).collect() == []


def test_only_late_ways_are_looked_at_one_by_one(monkeypatch):
    from tessera.operators import graph

    rng = np.random.default_rng(24)
    columns = lambda rows: tuple(np.array(c, np.int64) for c in zip(*rows))
    found = lambda out: {int(v): (int(n), int(lo), int(hi)) for v, n, lo, hi in zip(*out) if n}
    done = 0
    for ways, early in ((1 << 20, 1), (1, 1), (1 << 20, 8)):
        monkeypatch.setattr(graph, "WAYS", ways)
        monkeypatch.setattr(graph, "EARLY", early)
        for nodes, n, between, days in ((300, 700, 40, 3000), (40, 300, 10, 3000), (60, 90, 5, 40), (3, 4, 2, 9), (200, 900, 30, 2)):
            low = [(v, x, int(rng.integers(-3, days))) for v, x in {(int(v), int(x)) for v, x in zip(rng.integers(0, nodes, n), rng.integers(0, between, n))}]
            high = [(500 + v % 30, x, t) for v, x, t in {(v % 30, x): (v, x, t) for v, x, t in low}.values()]
            for a, b in ((low, low), (low, high), (high, low)):
                out = graph._late_times(columns(a), columns(b), a is b)
                done += out is not None
                assert out is None or found(out) == _ways(a, b, None)
    assert done >= 30
    assert graph._late_times(columns([(1, 1, graph.NONE), (2, 1, 5)]), columns([(1, 1, graph.NONE), (2, 1, 5)]), True) is None
