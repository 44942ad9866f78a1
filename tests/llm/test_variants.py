"""Spelling variants against SQL, brute force, and awkward rows."""

import re
import zlib
from collections import Counter

from conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import registry
from tessera.llm.variants import damaged_words, spelling_variants

NAME = "op13_spelling_variants"


def test_equals_sql(spark, duck, data):
    got, want = registry.QUERIES[NAME](spark, data).toPandas(), duck.execute(registry.ORACLE[NAME]).df()
    assert len(want) and want.form.notna().any() and rows_of(got) == rows_of(want)


def near(a, b):
    """Whether one edit makes a and b equal: what is left between their common beginning and end is one code point at most."""
    if a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j == 1


def brute(counts, times=10):
    out = {}
    for w, n in counts.items():
        others = sorted((-m, v) for v, m in counts.items() if near(w, v))
        form = others[0] if others and -others[0][0] >= times * n else None
        out[w] = [form and form[1], n, len(others), form and -form[0]]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].insert(1, root)
    return {(w, *v) for w, v in out.items()}


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.text("abé", min_size=1, max_size=5), st.integers(1, 2000), min_size=1, max_size=40))
def test_any_words(spark, counts):
    got = spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long").coalesce(2), times=3)
    assert {tuple(r) for r in got.collect()} == brute(counts, 3)


def words_by_hand(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {(w, k) for w, k in n.items() if len(w) >= 7 and k >= 2}


def test_awkward_rows(spark):
    long = " ".join(f"Wörter{c}×ÉÀ-lengthy" for c in "abcdefgh") * 3000
    rows = [(1, None), (1, ""), (None, "NullKeyWord nullkeyword"), (2, long), (2, long), (-5, "éclairage ÉCLAIRAGE Éclairage abcdef-ghijkl"), *((i, "commonword rareword" + "x" * (i % 2)) for i in range(200))]
    df = spark.createDataFrame([(*r, "w", 7) for r in rows], "doc_id long, text string, word string, n int")
    words = damaged_words(df)
    assert {tuple(r) for r in words.collect()} == words_by_hand(rows)
    assert {tuple(r) for r in spelling_variants(words).collect()} == brute(dict(words_by_hand(rows)))
    assert spelling_variants(damaged_words(df.limit(0))).collect() == []
