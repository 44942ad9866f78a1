"""Phrase collocations against SQL, brute force, and awkward rows."""

import re
from collections import Counter, defaultdict

import pytest
from conftest import rows_of

from tessera.llm import collocations as c
from tessera.llm import registry

NAME = "op12_collocations"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_equals_sql(spark, duck, data):
    got, want = registry.QUERIES[NAME](spark, data).toPandas(), duck.execute(registry.ORACLE[NAME]).df()
    assert len(want) and rows_of(got) == rows_of(want)


def brute(rows, least, most=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", "".join(x.lower() if x.isascii() else x for x in text or "")):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for d in range(1, 5):
                f[lang].update(tuple(words[i : i + d]) for i in range(len(words) - d + 1))
    out = set()
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            longer = [q for q, b in counts.items() if len(q) > len(p) and b >= least and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q)))]
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if not longer:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out |= {(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:most], 1)}
    return out


def corpus():
    """Words of a skewed order, so that phrases overlap, repeat and share parts; no two seeds alike."""
    rows, x = [], 12345
    vocabulary = ["the", "of", "Net", "été", "x\x0bbreak", "a.b", "über", "new", "york", "\x01"]
    for i in range(160):
        words = []
        for _ in range(60):
            x = (x * 1103515245 + 12345) % (1 << 31)
            words.append(vocabulary[min(x >> 16 & 31, x >> 22 & 15) % len(vocabulary)])
        rows.append((("en", "de", None)[i % 3], (" ", "\t", "  ")[i % 3].join(words) + (". New York of the" if i % 2 else "!")))
    return rows


@pytest.mark.parametrize(("shard", "most"), [(1 << 21, 2000), (500, 2000), (3000, 7)])
def test_equals_brute_force(spark, monkeypatch, shard, most):
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    monkeypatch.setattr(c, "SHARD", shard)
    got = {tuple(r[x] for x in COLUMNS) for r in c.collocations(df, least=12, most=most).collect()}
    assert got and got == brute(rows, 12, most)


def test_awkward_rows(spark):
    rows = [("en", None), ("en", ""), (None, " \t.,"), ("und", "one two " * 3), (None, "One, two one two"), ("", "same words here"), ("", "same words here"), ("es", "en de en de"), ("en", "es es"), ("xx", "word " * 20_000)]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "lang string, text string, word string, n int")
    got = {tuple(r[x] for x in COLUMNS) for r in c.collocations(df, least=2).collect()}
    assert got == brute(rows, 2)
    assert c.collocations(df.limit(0)).collect() == []


def test_scores_are_exact(spark):
    big = 3_000_000_000_000_000_001
    df = spark.createDataFrame([("en", "a b", 2, big)], "lang string, phrase string, size int, a long")
    below = spark.createDataFrame([("en", "a", big, [], []), ("en", "b", big + 4, [], [])], "lang string, phrase string, a long, l array<long>, r array<long>")
    row = c.linked(df, below).selectExpr("2000000 * CAST(a AS DECIMAL(20, 0)) div (CAST(l[0] AS DECIMAL(20, 0)) + CAST(r[0] AS DECIMAL(20, 0))) AS s").first()
    assert row.s == 2_000_000 * big // (2 * big + 4)
