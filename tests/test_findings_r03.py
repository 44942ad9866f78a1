"""Steps that a reviewer found slow or large: the same results by brute force, and what made them so is gone."""

import numpy as np


def _plan(df):
    return df._jdf.queryExecution().toString().lower()


def test_next_other_role_reads_each_row_once(spark):
    from tessera.operators import splits

    rng = np.random.default_rng(1)
    rows = [(int(g), int(t), i, r) for i, (g, t, r) in enumerate(zip(rng.integers(0, 2, 300), rng.integers(0, 60, 300), rng.choice(["a", "b", "c", "excluded"], 300).tolist()))]
    got = splits.next_other_role(spark.createDataFrame(rows, "g int, us long, id long, role string"), ["g"], ["us", "id"], "us", "role", ["a", "b", "c"])
    want = {i: min((u for h, u, j, q in rows if h == g and (u, j) > (t, i) and q not in (r, "excluded")), default=None) for g, t, i, r in rows}
    assert {x.id: x.limit for x in got.collect()} == want
    assert "unboundedfollowing" not in _plan(got)


def test_adf_of_many_lags_is_no_sum_per_pair_of_columns(spark, monkeypatch):
    from tessera.operators import series as s
    from test_series import slow_adf

    monkeypatch.setattr(s, "BLOCK", 100)
    y = np.cumsum(np.random.default_rng(2).normal(size=901))
    out = s.adf(spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(y)], "k int, i long, v double"), ["k"], "ct", "aic", 20)
    got, (p, rows, tau) = out.first(), slow_adf(y, "ct", "aic", 20)
    assert (got.lags, got.rows) == (p, rows) and abs(got.tau - tau) < 1e-6 * abs(tau)
    assert _plan(out).count("sum(") < 50


def test_components_are_contracted(spark, monkeypatch):
    from tessera.operators import graph

    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(int(a), int(b)) for a, b in rng.integers(100, 400, (200, 2))] + [(500, 500), (70, 3), (3, 70)]
    label = {v: v for p in pairs for v in p}
    while True:
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    sizes, real = [], graph.stored

    def stored(df, name):
        out = real(df, name)
        if name == "components-edges":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "stored", stored)
    assert {x.v: x.component for x in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == label
    assert sizes[-1] == 0 and all(b <= a / 2 for a, b in zip(sizes, sizes[1:]))
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_core_numbers_send_no_table_around(spark, monkeypatch):
    from tessera.operators import graph

    plans, real = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: (plans.append(_plan(df)), real(df, name))[1])
    got = graph.core_numbers(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "a long, b long"))
    assert {tuple(x) for x in got.collect()} == {(1, 2), (2, 2), (3, 2), (4, 1)}
    assert not any("broadcasthashjoin" in p for p in plans)


def test_replicates_are_drawn_where_the_series_is(spark, monkeypatch):
    from tessera.operators import resampling as r

    rng = np.random.default_rng(4)
    rows = [(k, i, float(v)) for k, n in (("a", 90), (None, 41), ("b", 1)) for i, v in enumerate(rng.normal(size=n))]
    x = spark.createDataFrame(rows, "g string, i long, v double")
    lengths = spark.createDataFrame([("a", 90, 3.5), (None, 41, 1.0), ("b", 1, 1.0)], "g string, n long, length double")
    want = {(y.g, y.replicate): y.mean for y in r.replicate_means(x, ["g"], r.stationary_blocks(lengths, ["g"], 30, 7)).collect()}
    for reach in (1 << 22, 16):
        got = {(y.g, y.replicate): y.mean for y in r.stationary_means(x, ["g"], lengths, 30, 7, reach, 8).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    monkeypatch.setattr(r, "stationary_blocks", None)  # no row for each block of each replicate
    assert r.mean_interval(x, ["g"], 30).count() == 3


def test_near_duplicate_rows_send_no_table_around(spark, monkeypatch):
    from tessera.operators import dedup

    plans, real = [], dedup.stored
    monkeypatch.setattr(dedup, "stored", lambda df, name: (plans.append(_plan(df)), real(df, name))[1])
    many = spark.createDataFrame([(i, 100.0 + i % 7 + i / 1000, "c") for i in range(150)], "id long, x double, c string")
    got = dedup.near_duplicate_rows(many, "id", ["x"], ["c"], rows=2)
    assert got.count() >= 149
    assert not any("broadcasthashjoin" in p for p in [*plans, _plan(got)])


def test_harmonic_numbers_add_nothing_up_at_a_row(spark):
    from pyspark.sql import functions as F

    from tessera.operators import drift

    got = {x.m: x.h for x in spark.createDataFrame([(m,) for m in (1, 2, 30, 31, 100, 5000)], "m long").select("m", drift.harmonic(F.col("m")).alias("h")).collect()}
    assert all(abs(h - sum(1 / i for i in range(1, m + 1))) < 1e-10 for m, h in got.items())
    df = spark.createDataFrame([(0, i / 100) for i in range(40)], "f int, p double")
    out = drift.fdr(df, "p", ["f"], "by")
    assert abs(min(x.adjusted for x in out.filter("p > 0").collect()) - min(1.0, min(i / 100 * 40 / (i + 1) for i in range(1, 40)) * sum(1 / i for i in range(1, 41)))) < 1e-9
    assert "sequence(1" not in _plan(out)


def test_templates_in_force_are_no_join_on_ranges(spark):
    from tessera.sources import exports

    field, at = "array<struct<enterprise:int,element:int,length:int>>", "struct<n:bigint,place:int>"
    ranges = [("x", 0, 256, None, (10, 1), 0, [(0, 1, 4)]), ("x", 0, 256, (10, 1), (20, 0), 0, [(0, 2, 4)]), ("x", 0, 256, (30, 0), None, 1, [(0, 3, 4)]), (None, 0, 256, (5, 0), None, 0, [(0, 4, 4)])]
    r = spark.createDataFrame(ranges, f"exporter string, domain bigint, template int, since {at}, until {at}, scope int, fields {field}")
    d = spark.createDataFrame([(e, 0, 256, n, p) for e in ("x", None, "y") for n in range(40) for p in (0, 1)], "exporter string, domain bigint, template int, n bigint, place int")
    got = exports.in_force(d, r)
    assert not any(x in _plan(got) for x in ("nestedloop", "cartesian"))

    def want(e, a):
        return next((f[0][1] for x, _, _, s, u, _, f in ranges if x == e and (s is None or s <= a) and (u is None or a < u)), None)

    rows = got.collect()
    assert len(rows) == 240
    assert all((x.fields[0].element if x.fields else None) == want(x.exporter, (x.n, x.place)) for x in rows)


def test_second_contacts_are_counted_without_a_row_for_two_nodes(spark):
    from tessera.operators import graph

    rng = np.random.default_rng(11)
    met = {(int(v), int(x)): None if rng.random() < 0.3 else int(rng.integers(0, 40)) for v, x in zip(rng.integers(999_970, 1_000_030, 260), rng.integers(0, 45, 260))}
    met |= {(7, 99): 3, (8, 99): None, (9, 98): 5, (10, 97): None, (11, 97): None}  # no time of its own; nobody else; no time at all
    want = {}
    for (v, x), t in met.items():
        for (u, y), s in met.items():
            if x == y and u != v:
                later = max((w for w in (t, s) if w is not None), default=None)
                before = want.setdefault(v, {}).get(u)
                want[v][u] = later if before is None else before if later is None else min(before, later)
    want = {v: (len(us), min((t for t in us.values() if t is not None), default=None), max((t for t in us.values() if t is not None), default=None)) for v, us in want.items()}
    rows = spark.createDataFrame([(v, x, t) for (v, x), t in met.items()], "v long, x long, t long")
    for size in (40, 1 << 20):
        assert {r.v: (r.n, r["first"], r["last"]) for r in graph.second_contact_times(rows, size).collect()} == want
    assert 9 not in want and want[10] == (1, None, None)


def test_rarity_sends_lists_of_slots_and_no_row_for_each(spark, monkeypatch):
    from tessera.llm import linejoin
    from tessera.llm.textblocks import digests

    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 400) % 5000) for _ in range(30)] + ["", None, "Å one\nONE"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    sent, mapped = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: sent.append(mapped(self, *a, **k)) or sent[-1])
    got, count = linejoin.rarity(df, 16), {}
    for w in (w for t in texts if t for w in "".join(c.lower() if c < "\x7f" else c for c in t).split()):
        data = np.frombuffer(w.encode(), np.uint8)
        slot = int(digests(data, np.array([0]), np.array([len(data)]))[0] >> np.uint64(48))
        count[slot] = count.get(slot, 0) + 1
    want = np.zeros(1 << 16, np.uint8)
    for slot, n in count.items():
        want[slot] = min(255, 1 + int(8 * np.log2(n)))
    assert (got == want).all() and len(count) > 10 * linejoin.PARTS
    assert sent[0].count() <= linejoin.PARTS


def test_triangles_make_no_wedges_that_their_ends_rule_out(spark, monkeypatch):
    from tessera.operators import graph

    kept = {}
    monkeypatch.setattr(graph, "stored", lambda df, name, keep=graph.stored: kept.setdefault(name, []).append(keep(df, name)) or kept[name][-1])
    rng = np.random.default_rng(13)
    pairs = {(int(min(p)), int(max(p))) for p in rng.integers(0, 40, (200, 2)) if p[0] != p[1]} | {(100 + i, 200 + j) for i in range(20) for j in range(3)}
    want = sorted((a, b, c) for a, b in pairs for d, c in pairs if d == b and (a, c) in pairs)
    df = spark.createDataFrame(sorted(pairs), "a long, b long")
    assert sorted(tuple(sorted(r)) for r in graph.triangles(df).select("x", "y", "z").collect()) == want and len(want) > 50
    assert kept["pairs-long"][-1].filter("x >= 100").isEmpty()  # two sides without a triangle


def test_run_lengths_work_out_gammas_once(monkeypatch):
    from tessera.operators import series as s

    asked, gamma = [], s.log_gamma
    monkeypatch.setattr(s, "log_gamma", lambda x: asked.append(len(x)) or gamma(x))
    x = np.random.default_rng(14).normal(size=300).tolist()
    state, plain = s.RunLengths("normal", 1 / 50, 0.0, 1.0, 0.0, None), s.RunLengths("normal", 1 / 50, 0.0, 1.0, 0.0, None)

    def density(v):
        mean, k, shape, rate = plain.seen
        wide = 2 * rate * (k + 1) / k
        return gamma(shape + 0.5) - gamma(shape) - 0.5 * np.log(np.pi * wide) - (shape + 0.5) * np.log1p((v - mean) ** 2 / wide)

    plain._density = density
    assert [state.add(v) for v in x] == [plain.add(v) for v in x]
    assert 0 < len(asked) < 10


def test_multiclass_counts_equal_rows_once(spark, monkeypatch):
    from tessera.operators import calibrate as c

    kept = {}
    monkeypatch.setattr(c, "stored", lambda df, name, keep=c.stored: kept.setdefault(name, []).append(keep(df, name)) or kept[name][-1])
    rows = [(0, [0.5, 0.5, 0.0], 0), (0, [0.2, 0.3, 0.5], 2), (1, [1.0, 0.0, 0.0], 1)]
    one = c.multiclass(spark.createDataFrame(rows, "g int, q array<double>, l int"), "q", "l", ["g"], 10).toPandas().set_index("g")
    many = c.multiclass(spark.createDataFrame(rows * 40, "g int, q array<double>, l int"), "q", "l", ["g"], 10).toPandas().set_index("g")
    assert one.n.to_dict() == {0: 2, 1: 1} and many.n.to_dict() == {0: 80, 1: 40} and many.log_loss[1] == float("inf")
    for name in ("brier", "log_loss", "classwise", "adaptive"):
        assert np.allclose(one[name].sort_index(), many[name].sort_index())
    assert kept["forecasts-told-apart"][-1].count() == 3


def test_words_are_counted_so_many_at_a_time_and_parts_one_after_another(spark, monkeypatch):
    from tessera.llm import linejoin

    rng = np.random.default_rng(15)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 400) % 5000) for _ in range(30)] + ["", None, "Å one\nONE"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    whole = linejoin.rarity(df, 16)
    sent, mapped = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: sent.append((_plan(self), mapped(self, *a, **k))) or sent[-1][1])
    monkeypatch.setattr(linejoin, "COUNTED_WORDS", 1000)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "4")
    try:
        assert (linejoin.rarity(df, 16) == whole).all() and whole.any()
        assert sent[0][1].count() > linejoin.PARTS  # several lists of a part
    finally:
        spark.conf.set(rows, before)
    assert "sort [part" in sent[1][0]


def test_pairs_are_dealt_into_parts_of_so_many_rows(spark, monkeypatch):
    from tessera.operators import graph

    monkeypatch.setattr(graph, "PART_ROWS", 50)
    rng = np.random.default_rng(16)
    rows = [(int(a), int(b), f) for (a, b), f in zip(rng.integers(0, 30, (600, 2)), rng.choice(["x", "y"], 600).tolist())] + [(None, 1, "x"), (2, None, "y")]
    df = spark.createDataFrame(rows, "s long, t long, f string")
    layered = graph.linked(df, "s", "t", ["f"])
    want = {(min(a, b), max(a, b), f) for a, b, f in rows if a is not None and b is not None and a != b}
    assert sorted(tuple(x) for x in layered.collect()) == sorted(want)
    assert layered.rdd.getNumPartitions() >= len(rows) // 50 and _plan(layered.limit(1)).count("count(") == 0
    stored = []
    monkeypatch.setattr(graph, "stored", lambda d, name, keep=graph.stored: stored.append(name) or keep(d, name))
    degree = {}
    for a, b, f in want:
        for v in (a, b):
            degree.setdefault(v, {}).setdefault(f, []).append(1)
    got = {x.v: (x.degree, round(x.participation, 9)) for x in graph.participation(layered, "f").collect()}
    k = {v: [len(x) for x in d.values()] for v, d in degree.items()}
    assert got == {v: (sum(x), round(2 * (1 - sum(n * n for n in x) / sum(x) ** 2), 9)) for v, x in k.items()}
    assert stored == ["layer-degrees"]


def test_adwin_looks_closely_only_where_a_cut_is_near(monkeypatch):
    from tessera.operators import drift

    rng, asked, differs = np.random.default_rng(17), [], drift.Adwin._differs
    monkeypatch.setattr(drift.Adwin, "_differs", lambda self: asked.append(1) or differs(self))
    x = np.concatenate([np.clip(rng.normal(m, 0.1, n), 0, 1) for m, n in ((0.3, 3000), (0.5, 40), (0.2, 2000), (0.9, 7))] + [np.full(300, 0.5), 1e6 + rng.random(300)])
    whole = drift.Adwin().scan(x)
    close, one, two = len(asked), drift.Adwin(), drift.Adwin()
    assert whole.tolist() == [one.update(v) for v in x.tolist()] == np.concatenate([two.scan(x[:777]), two.scan(x[777:])]).tolist()
    assert whole.sum() > 3 and close < len(x) / 4 and one.blocks == two.blocks


def test_few_candidates_are_lists_and_many_are_arrays(monkeypatch):
    from tessera.operators import series as s

    rng, asked, costs = np.random.default_rng(18), [], s.Segments._costs
    x = [float(v) for v in np.concatenate([rng.poisson(m, n) for m, n in ((2, 30), (40, 5), (0, 60), (40, 50))] + [rng.integers(0, 100, 200)])]
    monkeypatch.setattr(s.Segments, "_costs", lambda self, *a: asked.append(1) or costs(self, *a))
    found, arrays = {}, {}
    for few in (-1, 4, 16, 1000):
        monkeypatch.setattr(s.Segments, "FEW", few)
        asked.clear()
        state = s.Segments("poisson", 6.0, 2, 1.0)
        found[few] = [state.add(v) for v in x]
        arrays[few] = len(asked)
    for few in (4, 16, 1000):
        assert [a and a[0] for a in found[few]] == [a and a[0] for a in found[-1]]
        assert all(a is b is None or abs(a[1] - b[1]) < 1e-9 for a, b in zip(found[few], found[-1]))
    assert arrays[1000] == 0 < arrays[16] < arrays[-1] / 2


def test_equal_lines_of_a_batch_are_dealt_once(spark, monkeypatch):
    from tessera.llm import linejoin

    many = ["a b c d e f\nx1 x2 x3 x4 x5\nb a c d e f", "x5 x4 x3 x2 x1\n\nfew words", None, "", "a b c d e f"] * 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate(many)][::-1], "doc_id long, text string").coalesce(1)
    kept = {}
    monkeypatch.setattr(linejoin, "stored", lambda d, name, keep=linejoin.stored: kept.setdefault(name, keep(d, name)))
    got = {(x.doc_id, x.line): (x.match_doc_id, x.match_line) for x in linejoin.later_lines(df).collect()}
    first, want = {}, {}
    for i, t in enumerate(many):
        for j, line in enumerate((t or "").split("\n")):
            if len(words := frozenset(line.split())) >= 5 and first.setdefault(words, (i, j)) != (i, j):
                want[i, j] = first[words]
    assert got == want and len(want) > 90
    lines = linejoin.line_sets(df, np.ones(1 << 16, np.uint8), 80, 5).collect()
    assert sorted(x.copies for x in lines if x.copies) == [40, 60] and all(x.copies or not x.prefix for x in lines)


def test_words_of_a_line_are_told_apart_by_whole_digests():
    from tessera.llm import linejoin

    line, code = np.array([0, 0, 0, 1, 1]), np.array([1, 1, 1, 2, 1], np.uint8)
    h = np.array([(5 << 32) + 2, (5 << 32) + 1, (5 << 32) + 2, 7, 9], np.uint64)
    assert h[linejoin.by_line(line, code, h)].tolist() == [h[1], h[0], h[0], 9, 7]


def test_line_passes_let_an_encoder_go(spark):
    from tessera.llm import common, linejoin

    passes, held = [], common.kept("encoder", lambda: [0])
    assert common.kept("encoder", lambda: [1]) is held

    class Frame:
        sparkSession = spark
        select = filter = lambda self, *a: self
        mapInArrow = lambda self, run, schema: passes.append(run)

    linejoin.line_sets(Frame(), np.ones(1 << 16, np.uint8), 80, 5)
    assert list(passes[0](iter([]))) == [] and common.kept("encoder", lambda: [1]) is not held
    common.let_go()
