"""Passages of a benchmark in training texts: BM25 over an inverted index of test items, block-max WAND, verification.

Each training text is cut into overlapping passages, and every passage is a query. Weights of an item's terms are
divided by the score that the item gives itself, so that one threshold serves all items. The sums of block maxima are
first taken for many passages at once over the rarer terms (what the frequent terms could add is a slack per block);
passages in which some block may reach the threshold then run block-max WAND over the posting lists, and what it finds
is verified on the words of question and answer.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.textblocks import LOWER, blocks, digests, mix, runs

#: Items in one index, which is broadcast; a larger benchmark is taken in blocks of so many items, one after another.
INDEX_ITEMS = 20_000
BLOCK_ITEMS = 8
INSIDE = np.zeros(256, bool)
INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
GRAM = 5


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the terms (runs of ASCII letters and digits, lower case, and of other letters), and rows' first ones."""
    start, end = runs(INSIDE[data], offsets)
    return digests(LOWER[data], start, end), np.searchsorted(start, offsets)


def _terms(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return terms(data, np.array([0, len(data)]))[0]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    if len(h) < k or not k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return out


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence of an item is its answer, what comes before is its question; a single sentence is both."""
    parts = re.split(r"(?<=[.?!])\s+", text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


@dataclass
class Index:
    """Posting lists by term, each sorted by item, with the largest weight of every block of items."""

    items: list[int]
    vocabulary: np.ndarray
    postings: list[list[int]]
    weights: list[list[float]]
    block_max: list[dict[int, float]]
    rare: np.ndarray
    slack: np.ndarray
    first: np.ndarray
    cells: np.ndarray
    values: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    longest: int
    most: list[float] = field(default_factory=list)


def build_index(rows: list[tuple[int, str]], k1: float = 1.2, b: float = 0.75, most_slack: float = 0.2, whole: tuple | None = None) -> Index | None:
    """None if no item has a term. Items without terms are left out. `whole` holds what the weights take from the whole
    benchmark where rows are a part of it: items, mean and greatest length, sorted terms and the items of each."""
    found = [(i, t, h) for i, t in rows if t is not None and len(h := _terms(t))]
    if not found:
        return None
    found.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    vocabulary, coded = np.unique(np.concatenate([h for _, _, h in found]), return_inverse=True)
    bounds = np.cumsum([0, *(len(h) for _, _, h in found)])
    n, mean = len(found), bounds[-1] / len(found)
    own = [np.unique(coded[bounds[i] : bounds[i + 1]], return_counts=True) for i in range(n)]
    df = np.bincount(np.concatenate([t for t, _ in own]), minlength=len(vocabulary))
    items, longest = n, int(np.diff(bounds).max())
    if whole is not None:
        items, mean, longest, known, counts = whole
        df = counts[np.searchsorted(known, vocabulary)]
    idf = np.log1p((items - df + 0.5) / (df + 0.5))
    postings: list[list[int]] = [[] for _ in vocabulary]
    weights: list[list[float]] = [[] for _ in vocabulary]
    block_max: list[dict[int, float]] = [{} for _ in vocabulary]
    share = []
    for i, (t, tf) in enumerate(own):
        w = idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * (bounds[i + 1] - bounds[i]) / mean))
        w = w / w.sum()
        share.append((t, w))
        for term, x in zip(t.tolist(), w.tolist()):
            postings[term].append(i)
            weights[term].append(x)
            block = i // BLOCK_ITEMS
            block_max[term][block] = max(block_max[term].get(block, 0.0), x)
    # the most frequent terms whose weights stay within most_slack in every item are left to the slack
    rare, used = np.ones(len(vocabulary), bool), np.zeros(n)
    for term in np.argsort(idf, kind="stable"):
        use = used[postings[term]] + weights[term]
        if use.max() > most_slack:
            break
        used[postings[term]], rare[term] = use, False
    slack = np.zeros(-(-n // BLOCK_ITEMS))
    np.maximum.at(slack, np.arange(n) // BLOCK_ITEMS, used)
    counts = [len(m) if r else 0 for m, r in zip(block_max, rare)]
    cells = np.array([c for m, r in zip(block_max, rare) if r for c in m], np.int64)
    values = np.array([v for m, r in zip(block_max, rare) if r for v in m.values()])
    parts = [question_and_answer(t) for _, t, _ in found]
    asked = [np.unique(grams(q, min(GRAM, len(q)))) for q in (_terms(p[0]) for p in parts)]
    sizes = [min(GRAM, len(_terms(p[0]))) for p in parts]
    index = Index(
        [i for i, _, _ in found], vocabulary, postings, weights, block_max, rare, slack, np.concatenate([[0], np.cumsum(counts)]), cells, values,
        list(zip(asked, sizes)), [np.unique(_terms(p[1])) for p in parts], longest, [max(w) for w in weights],
    )
    return index


def block_max_wand(query: list[int], index: Index, threshold: float) -> list[tuple[int, float]]:
    """(item, score) of all items whose weights of the query's terms add up to the threshold or more."""
    lists = [[index.postings[t][0], 0, t] for t in query]
    out, eps = [], 1e-9
    while lists:
        lists.sort()
        total, pivot = 0.0, -1
        for i, (_, _, t) in enumerate(lists):
            total += index.most[t]
            if total >= threshold - eps:
                pivot = i
                break
        if pivot < 0:
            break
        item = lists[pivot][0]
        while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
            pivot += 1
        block = item // BLOCK_ITEMS
        if sum(index.block_max[t].get(block, 0.0) for _, _, t in lists[: pivot + 1]) < threshold - eps:
            to = min([(block + 1) * BLOCK_ITEMS, *(x[0] for x in lists[pivot + 1 : pivot + 2])])
        elif lists[0][0] == item:
            score = sum(index.weights[t][at] for _, at, t in lists[: pivot + 1])
            if score >= threshold - eps:
                out.append((item, score))
            to = item + 1
        else:
            to = item
        moved = []
        for x in lists[: pivot + 1]:
            places = index.postings[x[2]]
            if x[0] < to:
                x[1] = bisect_left(places, to, x[1])
                if x[1] == len(places):
                    continue
                x[0] = places[x[1]]
            moved.append(x)
        lists = moved + lists[pivot + 1 :]
    return out


def search_block(data: np.ndarray, offsets: np.ndarray, index: Index, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
    """(row, item, score, question overlap, answer overlap) of verified matches, each item once a row."""
    h, first = terms(data, offsets)
    stride = max(32, index.longest)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    if not len(h):
        return []
    at = np.minimum(np.searchsorted(index.vocabulary, h), len(index.vocabulary) - 1)
    known = np.flatnonzero((index.vocabulary[at] == h) & index.rare[at])
    # passage p of a row holds its strides p and p + 1
    strides = np.maximum(1, -(-count // stride))
    base = np.concatenate([[0], np.cumsum(strides)])
    mine = base[row[known]] + (known - first[row[known]]) // stride
    back = mine > base[row[known]]
    passage = np.concatenate([mine, mine[back] - 1])
    term = np.concatenate([at[known], at[known][back]])
    pair = np.unique(passage * len(index.vocabulary) + term)
    passage, term = pair // len(index.vocabulary), pair % len(index.vocabulary)
    size = index.first[term + 1] - index.first[term]
    total = np.cumsum(size)
    cell = np.repeat(index.first[term] - (total - size), size) + np.arange(total[-1] if len(total) else 0)
    n = len(index.slack)
    bound = np.bincount(np.repeat(passage, size) * n + index.cells[cell], weights=index.values[cell], minlength=base[-1] * n).reshape(-1, n)
    live = np.flatnonzero((bound + index.slack >= threshold - 1e-6).any(axis=1))
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for p in live.tolist():
        r = int(np.searchsorted(base, p, "right") - 1)
        lo = first[r] + (p - base[r]) * stride
        inside = slice(int(lo), int(min(lo + 2 * stride, first[r + 1])))
        query = np.unique(at[inside][index.vocabulary[at[inside]] == h[inside]]).tolist()
        for item, score in block_max_wand(query, index, threshold):
            wanted, k = index.question[item]
            # a part without terms asks for nothing
            asked = float(np.isin(wanted, grams(h[inside], k)).mean()) if len(wanted) else 1.0
            answered = float(np.isin(index.answer[item], h[inside]).mean()) if len(index.answer[item]) else 1.0
            if asked >= overlap and answered >= overlap:
                best[r, item] = max(best.get((r, item), (0.0, 0.0, 0.0)), (score, asked, answered))
    return [(r, item, *scores) for (r, item), scores in best.items()]


def _indexes(benchmark: DataFrame):
    """Indexes of blocks of at most about INDEX_ITEMS items; each block is chosen by a hash and collected by itself.
    Numbers of items, lengths and document frequencies are those of all items, so that scores don't depend on the blocks."""
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    parts = -(-items.count() // INDEX_ITEMS)
    if parts > 1:

        def spread(batches):
            for batch in batches:
                for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if text is not None and len(h := _terms(text)):
                        own = np.unique(h)
                        sizes = np.concatenate([[len(h)], np.zeros(len(own) - 1, np.int64)])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part), pa.int32()), pa.array(own.view(np.int64)), pa.array(sizes, pa.int64())], names=["part", "term", "size"])

        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int")
        held = stored(items.select(block.alias("part"), "text").mapInArrow(spread, "part int, term long, size long"), "benchmark-terms")
        n, total, longest = held.filter("size > 0").agg(F.count("*"), F.sum("size"), F.max("size")).first()
        frequencies = stored(held.groupBy("term").agg(F.count("*").alias("n"), F.collect_set("part").alias("parts")), "benchmark-frequencies")
    for part in range(parts):
        rows, whole = items, None
        if parts > 1:
            rows = items.filter(block == part)
            own = frequencies.filter(F.array_contains("parts", part)).select("term", "n").toArrow()
            known = own.column("term").to_numpy().view(np.uint64)
            order = np.argsort(known)
            whole = (n, total / n if n else 0.0, longest, known[order], own.column("n").to_numpy()[order])
        if index := build_index([tuple(r) for r in rows.collect()], whole=whole):
            yield index


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.7, overlap: float = 0.8) -> DataFrame:
    """One row per document and item that it contains: doc_id, item_id, score (of the best passage, 1 for the item
    itself), question_overlap (of its shingles of five words), answer_overlap (of its words).

    An item counts if a passage scores threshold or more and both overlaps reach `overlap`. Null and empty texts match
    nothing, nor do items without words; a question or answer without words counts as fully overlapped; equal items are each reported; rows of equal doc_id are each searched. Empty
    tables give no rows, other columns aren't looked at. There is no shuffle: texts are searched where they are read.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], schema)
    for index in _indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                for lo, hi, data, offsets in blocks(batch.column(1)):
                    found = search_block(data, offsets, shared.value, threshold, overlap)
                    if found:
                        rows = pa.array([lo + f[0] for f in found], pa.int64())
                        cols = [batch.column(0).take(rows), pa.array([shared.value.items[f[1]] for f in found], pa.int64())]
                        yield pa.RecordBatch.from_arrays([*cols, *(pa.array([round(f[i], 9) for f in found], pa.float64()) for i in (2, 3, 4))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
        out = part if out.isLocal() else out.union(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.7, overlap: float = 0.8) -> DataFrame:
    """The rows of docs that contain no item, as they are."""
    spark, place = docs.sparkSession, docs.columns.index("text")
    for index in _indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                clean = np.ones(len(batch), bool)
                for lo, _, data, offsets in blocks(batch.column(place)):
                    clean[[lo + f[0] for f in search_block(data, offsets, shared.value, threshold, overlap)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
