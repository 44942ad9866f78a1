"""Near duplicates, lines, passages, benchmark items and the pipeline, against brute force."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline
from tessera.llm import decontaminate, linejoin, minhash, passages, registry

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingle_set(t, k):
    w = WORDS.findall(lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(docs, k, percent=80):
    """(n_shingles, component, kept) by doc_id, over all pairs that share a shingle."""
    sets, near, root = {i: shingle_set(t, k) for i, t in docs.items()}, defaultdict(list), {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        shared = defaultdict(int)
        for g in s:
            for j in near[g]:
                shared[j] += 1
            near[g].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in docs}


def brute_lines(docs, percent=80, least=5):
    """doc_id -> {line: earlier match} by comparing each line with all before it."""
    seen, out = [], defaultdict(dict)
    for i in sorted(docs):
        for n, line in enumerate((docs[i] or "").split("\n")):
            s = frozenset(WORDS.findall(lower(line)))
            if len(s) < least:
                continue
            equal = next((p for p, o in seen if o == s), None)
            match = equal or next((p for p, o in seen if 100 * len(s & o) >= percent * len(s | o)), None)
            if match:
                out[i][n] = match
            seen.append(((i, n), s))
    return out


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def base(n=60):
    return " ".join(f"w{i * 7919 % 1009}" for i in range(n))


def copies():
    """Exact copies, chains of near copies in which only neighbours are linked, short texts and empty ones."""
    words = base().split()
    chain = [" ".join([*(f"x{i}" for i in range(c)), *words[c:]]) for c in range(0, 24, 3)]
    return [base(), base(), base().upper(), *chain, "a b", "a b", "A  b", "a", "", None, None, " \t", "q " * 3000, "q " * 2999]


def frame(spark, texts, extra="component_id"):
    return spark.createDataFrame([(i, t, "zz", None) for i, t in enumerate(texts)], f"doc_id long, text string, {extra} string, lang string")


def test_near_duplicates_contract(spark, data, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in registry.QUERIES["op5_near_duplicates"](spark, data).collect()}
    assert got == brute_components(docs, 4)


def test_near_duplicates_of_awkward_rows(spark):
    texts = copies()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, texts), 5).collect()}
    assert got == brute_components(dict(enumerate(texts)), 5)
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "other words of no kind at all here"), (None, "a b c d e f"), (2, "other words of no kind at all here")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.component_id or 0, r.kept) for r in minhash.near_duplicates(df, 5).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert minhash.near_duplicates(df.limit(0), 5).collect() == []


def test_texts_of_one_doc_id_are_one_node(spark):
    a, b = base(), " ".join(f"v{i}" for i in range(60))
    near = b.replace("v59", "other")
    for last in (b, near):
        df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, last), (4, "nothing like the others")], "doc_id long, text string")
        got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df, 5).collect())
        assert got == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_every_coordinate_is_filled():
    import numpy as np

    s = np.arange(1, 8, dtype=np.uint64)
    out = minhash.sketch(s, np.array([0, 1, 1, 7]))
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    assert (out[[0, 2]] != none).all() and (out[1] == none).all()


def test_sketches_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    share = []
    for _ in range(40):
        x = rng.integers(0, 1 << 62, 1200).astype(np.uint64)
        a, b = np.sort(x[:1000]), np.sort(x[200:])
        out = minhash.sketch(np.concatenate([a, b]), np.array([0, 1000, 2000]))
        share.append((out[0] == out[1]).mean())
    assert abs(np.mean(share) - 800 / 1200) < 0.02


def test_line_dedup_equals_all_pairs(spark, data, docs):
    want = brute_lines(docs)
    got = registry.QUERIES["op3_line_dedup"](spark, data).collect()
    assert {r.doc_id: list(r.removed) for r in got} == {i: sorted(want[i]) for i in docs}
    assert all(r.n_removed == len(r.removed) and r.n_lines == (len(docs[r.doc_id].split("\n")) if docs[r.doc_id] else 0) for r in got)


def test_lines_of_awkward_rows(spark):
    line = "one two three four five six seven eight nine ten"
    near = "one two three four five six seven eight nine eleven"
    texts = [f"{line}\nshort line\n{line}", f"short line\n{near}\nfresh words stand in this line here", None, "", line.upper(), "b " * 40_000 + "c d e f", f"{near}\n\n{near}"]
    df = frame(spark, texts, "line")
    want = brute_lines(dict(enumerate(texts)))
    got = defaultdict(dict)
    for r in linejoin.later_lines(df).collect():
        got[r.doc_id][r.line] = (r.match_doc_id, r.match_line)
    assert got == want
    kept = {r.doc_id: r.text for r in linejoin.without_later_lines(df).collect()}
    assert kept == {0: f"{line}\nshort line", 1: "short line\nfresh words stand in this line here", 2: None, 3: "", 5: texts[5]}
    assert linejoin.without_later_lines(df.limit(0)).collect() == [] and linejoin.without_later_lines(df).columns == df.columns
    assert linejoin.later_lines(spark.createDataFrame([(None, line), (None, line)], "doc_id long, text string")).collect() == []


def test_short_lines_equal_all_pairs(spark, data, docs):
    want = brute_lines(docs, least=1)
    got = {r.doc_id: list(r.removed) for r in registry.QUERIES["op3_line_dedup_short"](spark, data).collect()}
    assert got == {i: sorted(want[i]) for i in docs} and got != {i: sorted(x) for i, x in brute_lines(docs).items()}
    texts = ["one two three\nRead more\nz", "Read more\none two four\nread  MORE\none two", "z\na b c d\n\nthree two one", "a b c"]
    for percent in (50, 66, 75, 80, 100):
        got = defaultdict(dict)
        for r in linejoin.later_lines(frame(spark, texts, "line"), percent, 1).collect():
            got[r.doc_id][r.line] = (r.match_doc_id, r.match_line)
        assert got == brute_lines(dict(enumerate(texts)), percent, 1)


def test_n_chars_follows_the_text(spark):
    line = "one two three four five six"
    df = spark.createDataFrame([(1, line, 27), (2, line + "\nété", 31)], "doc_id long, text string, n_chars long")
    assert {r.doc_id: (r.text, r.n_chars) for r in linejoin.without_later_lines(df).collect()} == {1: (line, 27), 2: ("été", 3)}


def brute_removed_words(docs, least_line=8):
    """Per document the words (by place) inside lines of least_line words or more that stand earlier."""
    first, out = {}, defaultdict(set)
    for i in sorted(docs):
        at = 0
        for line in (docs[i] or "").split("\n"):
            w = tuple(WORDS.findall(lower(line)))
            if len(w) >= least_line:
                if w in first:
                    out[i] |= set(range(at, at + len(w)))
                first.setdefault(w, i)
            at += len(w)
    return out


def places(text, start, end):
    """The word places inside a span of characters."""
    return {n for n, m in enumerate(WORDS.finditer(text)) if start <= m.start() and m.end() <= end}


def test_repeated_passages_hold_every_repeated_line(spark, data, docs):
    spans = registry.QUERIES["op6_repeated_passages"](spark, data).collect()
    got = defaultdict(set)
    for r in spans:
        assert 0 <= r.start < r.end <= len(docs[r.doc_id]) and r.first_doc_id <= r.doc_id
        inside = places(docs[r.doc_id], r.start, r.end)
        assert len(inside) == r.n_words
        got[r.doc_id] |= inside
    for i, want in brute_removed_words(docs).items():
        assert want <= got[i]
    # what is removed stands earlier: each five words in it are in the same or an earlier document
    grams = defaultdict(list)
    for i in sorted(docs):
        w = WORDS.findall(lower(docs[i]))
        for n in range(len(w) - 4):
            grams[tuple(w[n : n + 5])].append((i, n))
    for r in spans:
        w = WORDS.findall(lower(docs[r.doc_id]))
        inside = sorted(places(docs[r.doc_id], r.start, r.end))
        for n in inside[:1]:
            g = tuple(w[n : n + 5])
            assert len(g) < 5 or min(grams[g]) < (r.doc_id, n)


def test_a_passage_inside_a_line_is_found_and_the_first_stays(spark):
    passage = base(60)
    texts = [f"first words of one kind {passage} and the end", f"quite another beginning stands here {passage} with more", None, "", "short", f"{passage}"]
    df = frame(spark, texts, "start")
    spans = passages.repeated_spans(df).collect()
    assert {r.doc_id for r in spans} == {1, 5} and all(r.n_words >= 40 and r.first_doc_id == 0 for r in spans)
    kept = {r.doc_id: r.text for r in passages.without_spans(df, passages.repeated_spans(df)).collect()}
    assert kept[0] == texts[0] and kept[2] is None and kept[4] == "short" and kept[1].startswith("quite another") and len(kept[1]) < len(texts[1]) - 150
    assert passages.repeated_spans(df.limit(0)).collect() == []


def brute_items(text, items, threshold=0.7, overlap=0.8):
    """Items whose weights in some passage add up to the threshold and whose question and answer are there, term by term."""
    import numpy as np

    found = set()
    data = (text or "").encode()
    if not data:
        return found
    index = decontaminate.build_index(items)
    raw = np.frombuffer(data, np.uint8)
    h, _ = decontaminate.terms(raw, np.array([0, len(raw)]))
    stride = max(32, index.longest)
    for lo in range(0, max(1, len(h)), stride):
        window = h[lo : lo + 2 * stride]
        there = set(window.tolist())
        score = defaultdict(float)
        for t, term in enumerate(index.vocabulary.tolist()):
            if term in there:
                for item, w in zip(index.postings[t], index.weights[t]):
                    score[item] += w
        for item, s in score.items():
            wanted, k = index.question[item]
            own = set(decontaminate.grams(window, k).tolist())
            asked = sum(g in own for g in wanted.tolist()) / len(wanted)
            answered = sum(g in there for g in index.answer[item].tolist()) / len(index.answer[item])
            if s >= threshold - 1e-9 and asked >= overlap and answered >= overlap:
                found.add(index.items[item])
    return found


def test_benchmark_items_equal_all_pairs(spark, data, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    got = defaultdict(set)
    for r in registry.QUERIES["op10_benchmark_passages"](spark, data).collect():
        got[r.doc_id].add(r.item_id)
    want = {i: f for i, t in docs.items() if (f := brute_items(t, items))}
    assert want and dict(got) == want


def test_benchmark_of_awkward_rows(spark):
    item = "What is the height of the old tower by the river gate? It is ninety four metres."
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "..."), (None, "Another question of a quite different kind? Yes.")], "item_id long, text string")
    texts = [f"before {item} after", item.upper(), None, "", "the river gate is old", "z " * 50_000 + item, f"{item}\n" * 3]
    df = frame(spark, texts, "item_id")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect())
    assert got == [(d, i) for d in (0, 1, 5, 6) for i in (1, 2)]
    kept = decontaminate.without_contaminated(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4}
    assert decontaminate.contaminated(df.limit(0), bench).collect() == []
    assert decontaminate.contaminated(df, bench.limit(0)).collect() == [] and decontaminate.without_contaminated(df, bench.limit(0)).count() == len(texts)


def test_items_with_an_empty_part_and_blocks_of_items(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"What is the name of town {i} by river number {i * 7}? It is place {i} of the land.") for i in range(30)] + [(99, "The sum of nine and seventeen and forty. = ?")], "item_id long, text string")
    texts = [r.text for r in bench.collect()] + ["What is the name of town 3 by river? It is place 3 of the land.", "of the land"]
    df = frame(spark, texts, "item_id")
    whole = sorted(tuple(r) for r in decontaminate.contaminated(df, bench).collect())
    assert (30, 99) in {r[:2] for r in whole} and {(i, i) for i in range(30)} <= {r[:2] for r in whole}
    monkeypatch.setattr(decontaminate, "INDEX_ITEMS", 8)
    assert sorted(tuple(r) for r in decontaminate.contaminated(df, bench).collect()) == whole


def test_pipeline_equals_its_stages_by_brute_force(spark, data, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    scores = {r.doc_id: r.predicted for r in registry.QUERIES["op4_quality_scores"](spark, data).collect()}
    left = {i: t for i, t in docs.items() if scores[i]}
    gone, cut = brute_lines(left), {}
    for i, t in left.items():
        kept = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone[i])
        if not gone[i] or WORDS.search(kept):
            cut[i] = kept if gone[i] else t
    left = {i: cut[i] for i, (_, _, kept) in brute_components(cut, 5).items() if kept}
    left = {i: t for i, t in left.items() if not brute_items(t, items)}
    from test_text_operators import _library, _want

    t = _library()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, data).collect()}
    assert got == {i: _want(t, x) for i, x in left.items()}


def test_stages_keep_columns_and_take_awkward_rows(spark, data):
    df = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "x", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, data)
            assert out.columns == df.columns and out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() == docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "decontamination", "bpe"]


def test_texts_of_one_doc_id_lose_their_own_lines(spark):
    line, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    df = spark.createDataFrame([(1, line), (2, line), (2, other), (3, other), (3, other)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in linejoin.without_later_lines(df).collect()) == [(1, line), (2, other)]


def test_a_large_group_of_near_copies_goes_through_blocks(spark, monkeypatch):
    """Lines that differ from a common one in some words each: few match the first, many match some other."""
    import random

    rng, words = random.Random(5), base(40).split()
    texts = []
    for i in range(60):
        w = list(words)
        for at in rng.sample(range(40), rng.randint(2, 6)):
            w[at] = f"z{rng.randint(0, 400)}"
        texts.append(" ".join(w))
    monkeypatch.setattr(linejoin, "BLOCK_LINES", 8)
    got = {(r.doc_id, r.line): (r.match_doc_id, r.match_line) for r in linejoin.later_lines(frame(spark, texts, "line")).collect()}
    assert got == {(i, n): m for i, x in brute_lines(dict(enumerate(texts))).items() for n, m in x.items()}
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 200)
    near = [" ".join(words * 3) + " " + " ".join(f"y{i % (7 + j)}" for i in range(8 + j)) for j in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, texts + near), 5).collect()}
    assert got == brute_components(dict(enumerate(texts + near)), 5)


def test_runs_of_few_words_are_cut(spark):
    run = "buy now " * 40
    spans = passages.repeated_spans(frame(spark, [f"first of all {run} end", f"another one {run}"], "start")).collect()
    assert {1} <= {r.doc_id for r in spans}


def test_marked_holds_all_its_keys(spark):
    import numpy as np

    from tessera.llm.common import Marked

    keys = spark.range(1000).selectExpr("xxhash64(id) AS key")
    marked = Marked(keys, "key")
    own = np.array([r.key for r in keys.collect()])
    assert marked.holds(own).all() and marked.holds(np.arange(10_000, dtype=np.int64) * 7919).mean() < 0.1


def test_spans_are_cut_out_of_their_own_text(spark):
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    p, fresh = words("p", 60), words("fresh", 80)
    rows = [(1, words("a", 20) + " " + p), (2, p + " " + words("b", 5)), (2, fresh), (2, fresh), (3, None), (None, p), (4, "")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, text_id string, start int")
    spans = passages.repeated_spans(df)
    assert {(r.doc_id, r.first_doc_id) for r in spans.collect()} == {(2, 1)}
    got = sorted(((r.doc_id, r.text) for r in passages.without_spans(df, spans).collect()), key=repr)
    assert len(got) == len(rows) and got.count((2, fresh)) == 2 and (None, p) in got and (3, None) in got and (4, "") in got and (1, rows[0][1]) in got
    (left,) = [t for i, t in got if i == 2 and t != fresh]
    assert left.endswith("b3 b4") and len(left.split()) < 30


def test_many_texts_of_one_opening(spark):
    texts = [f"please see the other page for w{i}" for i in range(3000)] + [f"one two three four w{i}" for i in range(1500)] + ["one two three four w7"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    gone = minhash.near_duplicates(df, 4, 80).filter("NOT kept").collect()
    assert [(r.doc_id, r.component_id) for r in gone] == [(4500, 3007)]
