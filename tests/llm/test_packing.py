"""Best-fit packing: ids, contract, bounds, awkward rows."""

import struct
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing, registry

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def holds(got, capacity):
    """Every sequence is gapless from 0 and within its capacity; gives their number."""
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_contract(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = registry.QUERIES["op11_best_fit_packing"](spark, data).collect()
    pieces = {(r.doc_id, r.piece): r for r in got}
    lengths = []
    for d in docs:
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            r = pieces.pop((d.doc_id, p))
            assert (r.start, r.length, r.ids_crc32) == (at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            lengths.append(len(part))
    assert not pieces
    n = holds(got, 4096)
    alone = len(packing.best_fit(sorted((x for x in lengths if x < 4096), reverse=True), 4096)[2]) + lengths.count(4096)
    assert packing.lower_bound(np.bincount(lengths, minlength=4097)) <= n <= alone


@pytest.mark.parametrize("text", ["", " \n\t", "It's 42% CAFÉ Σ\u0085ΟΣ x\x1cy", "a<|endoftext|>B <|startoftext|>", "é ́x ﬁ 漢字 😀", "word " * 9, "x" * 300, "don't we'LL'S"])
def test_ids_are_the_librarys(text, library, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 7)
    ids = packing.Ids(PATH)
    for _ in range(2):
        assert np.frombuffer(ids.encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB1' \n\x0b\x1c\x85 é́ß.<|endoftext>Σ"), max_size=40))
def test_any_text(text):
    ids = packing._loaded.get(PATH) or packing._loaded.setdefault(PATH, packing.Ids(PATH))
    assert np.frombuffer(ids.encode(text.encode()), "<u4").tolist() == ids.whole.encode(text, add_special_tokens=False).ids


def least(sizes, capacity):
    """The fewest sequences, by trying every subset."""
    n = len(sizes)
    fits = [sum(s for i, s in enumerate(sizes) if m >> i & 1) <= capacity for m in range(1 << n)]
    best = [0] + [n] * ((1 << n) - 1)
    for m in range(1, 1 << n):
        sub = m
        while sub:
            if fits[sub]:
                best[m] = min(best[m], best[m ^ sub] + 1)
            sub = sub - 1 & m
    return best[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_bounds_and_best_fit_of_small_cases(sizes):
    exact = least(sizes, 12)
    where, offset, free = packing.best_fit(sorted(sizes, reverse=True), 12)
    assert packing.lower_bound(np.bincount(sizes, minlength=13)) <= exact <= len(free)
    for b, left in enumerate(free):
        inside = [s for s, w in zip(sorted(sizes, reverse=True), where, strict=True) if w == b]
        assert sum(inside) + left == 12


def test_bounds_see_what_sums_do_not():
    assert packing.lower_bound(np.bincount([7] * 10, minlength=13)) == 10  # no two fit
    assert packing.lower_bound(np.bincount([5] * 9, minlength=13)) == 5  # two fit, three don't
    assert all(packing.lower_bound(np.bincount([a, b], minlength=13)) == 1 + (a + b > 12) for a, b in combinations(range(1, 13), 2))


def test_exchange_closes_the_gaps(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "CAST(0 AS INT) AS piece", "0L AS start", "1 + (id * id * 7919) % 63 AS length", "0L AS ids_crc32").repartition(5)
    got = packing.packed(df, capacity=64, rows=400, release=8)
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == list(range(4000))
    alone = len(packing.best_fit(sorted((r.length for r in rows), reverse=True), 64)[2])
    n, bound = packing.certificate(got, 64)
    assert holds(rows, 64) == n and bound <= n <= 1.003 * alone
    same = packing.packed(spark.range(900).selectExpr("1L AS doc_id", "33L AS length"), capacity=64, rows=100, release=2)  # one key, one length, no two fit
    assert holds(same.collect(), 64) == 900


def test_awkward_rows(spark):
    rows = [(1, None, "a"), (1, "", "b"), (None, "one two", "c"), (2, "x " * 9000, None), (3, "same", "d"), (3, "same", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    got = packing.packed(packing.token_pieces(df, PATH)).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in got) == [(0, 0, 3), (1, 0, 1), (1, 0, 1), (2, 0, 4096), (2, 1, 4096), (2, 2, 809), (3, 0, 2), (3, 0, 2)]
    assert holds(got, 4096) == 3
    assert packing.packed(packing.token_pieces(df.limit(0), PATH)).collect() == []
