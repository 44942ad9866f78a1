"""Phrase collocations from count tries of shards: sorted runs merged by prefix range, parents for left parts, suffix links for right."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Marked, group_starts, sized, small_batches, stored
from tessera.llm.textblocks import LOWER, blocks, digests, mix, runs

#: Words of a shard, after which a task writes what it has counted.
SHARD = 1 << 21
DEPTH = 4
#: Ranges of two-word prefixes, of which each shard's trie is a row: this many, or one for each 2**20 words if that's more.
RANGES = 256
#: Bytes that end a piece, and those that end a word.
CUT = np.zeros(256, bool)
CUT[[*b".,;:!?", *range(10, 14)]] = True
GAP = CUT.copy()
GAP[[9, 32]] = True


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[start:end] for each pair, as Arrow strings."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    take = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data[take]))


class Shard:
    """Words of one shard of texts, in order: 64-bit keys of language and word, and whether the next one follows in the same
    piece. Of each distinct key the language and the word are kept. (Keys meet by chance once in some 10^7 shards.)"""

    def __init__(self):
        self.keys, self.joint, self.names, self.n = [], [], [], 0

    def add(self, keys, joint, langs, words, first):
        self.keys.append(keys)
        self.joint.append(joint)
        self.names.append((keys[first], langs, words))
        self.n += len(keys)

    def named(self) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """The distinct keys, their languages and words."""
        keys, at = np.unique(np.concatenate([x[0] for x in self.names]), return_index=True)
        at = pa.array(at)
        return keys, pa.chunked_array([x[1] for x in self.names]).take(at).combine_chunks(), pa.chunked_array([x[2] for x in self.names]).take(at).combine_chunks()


def shards(batches: Iterator[pa.RecordBatch], chosen: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> Iterator[Shard]:
    """Shards of (lang, text) batches. `chosen` gets a block's keys and joints, and says which words to take and which of
    the joints are left; without it all are taken."""
    shard = Shard()
    for batch in batches:
        named = batch.column(0).fill_null("und").dictionary_encode()
        langs, raw = named.dictionary.cast(pa.large_string()), [x.encode() for x in named.dictionary.to_pylist()]
        sizes = np.cumsum([0, *map(len, raw)])
        seeds = mix(digests(np.frombuffer(b"".join(raw), np.uint8), sizes[:-1], sizes[1:]), 1)  # else 'en' in es would be 'es' in en
        code = named.indices.to_numpy()
        for lo, hi, data, offsets in blocks(batch.column(1)):
            low = LOWER[data]
            start, end = runs(~GAP[low], offsets)
            if not len(start):
                continue
            row = np.repeat(np.arange(lo, hi), np.diff(np.searchsorted(start, offsets)))
            keys = mix(digests(low, start, end) ^ seeds[code[row]])
            cuts = np.zeros(len(low) + 1, np.int64)
            np.cumsum(CUT[low], out=cuts[1:])
            joint = np.zeros(len(keys), bool)
            joint[:-1] = (row[1:] == row[:-1]) & (cuts[start[1:]] == cuts[end[:-1]])
            if chosen:
                take, joint = chosen(keys, joint)
                keys, joint, start, end, row = keys[take], joint[take], start[take], end[take], row[take]
                if not len(keys):
                    continue
            _, first = np.unique(keys, return_index=True)
            shard.add(keys, joint, langs.take(pa.array(code[row[first]])), strings(low, start[first], end[first]), first)
            if shard.n >= SHARD:
                yield shard
                shard = Shard()
    if shard.n:
        yield shard


def _batches(columns: dict[str, pa.Array] | pa.Table, most: int = 65_536) -> Iterator[pa.RecordBatch]:
    rows = columns if isinstance(columns, pa.Table) else pa.table(columns)
    plain = pa.schema([(f.name, pa.string() if f.type == pa.large_string() else f.type) for f in rows.schema])
    yield from rows.cast(plain).to_batches(max_chunksize=most)


def word_counts(batches):
    """(lang, word, key, n) of each shard, and all its words by lang where word is null."""
    for shard in shards(batches):
        keys, langs, words = shard.named()
        _, n = np.unique(np.concatenate(shard.keys), return_counts=True)
        n = pa.array(n)
        yield from _batches({"lang": langs, "word": words, "key": pa.array(keys.view(np.int64)), "n": n})
        total = pa.table({"lang": langs, "n": n}).group_by("lang").aggregate([("n", "sum")])
        none = pa.nulls(len(total))
        yield from _batches({"lang": total.column("lang"), "word": none.cast(pa.large_string()), "key": none.cast(pa.int64()), "n": total.column("n_sum")})


def pair_keys(keys: np.ndarray) -> np.ndarray:
    """Keys of each word with the one after it."""
    return mix(keys[:-1] * np.uint64(0x9E3779B97F4A7C15) + keys[1:])


def pair_counts(frequent: Marked):
    def chosen(keys, joint):
        held = frequent.holds(keys.view(np.int64))
        joint[:-1] &= held[:-1] & held[1:]
        return slice(None), joint

    def run(batches):
        for shard in shards(batches, chosen):
            keys, joint = np.concatenate(shard.keys), np.concatenate(shard.joint)
            found, n = np.unique(pair_keys(keys)[joint[:-1]], return_counts=True)
            yield from _batches({"key": pa.array(found.view(np.int64)), "n": pa.array(n)})

    return run


def tries(frequent: Marked, pairs: Marked, ranges: int):
    """The count trie of each shard, down to DEPTH, of which every two neighbours may be a frequent pair, serialised: for each
    range of two-word prefixes and language, phrases and counts of all nodes below them, sorted by phrase."""

    def chosen(keys, joint):
        held = frequent.holds(keys.view(np.int64))
        joint[:-1] &= held[:-1] & held[1:]
        at = np.flatnonzero(joint)
        joint[at] = pairs.holds(mix(keys[at] * np.uint64(0x9E3779B97F4A7C15) + keys[at + 1]).view(np.int64))
        take = joint.copy()
        take[1:] |= joint[:-1]
        return take, joint

    def run(batches):
        for shard in shards(batches, chosen):
            known, langs, words = shard.named()
            code, joint = np.searchsorted(known, np.concatenate(shard.keys)), np.concatenate(shard.joint)
            node, phrases, lang, found = code, words, langs, []  # a node is its parent and one more word
            at = np.arange(len(code))
            for depth in range(1, DEPTH):
                on = joint[at + depth - 1]
                at, node = at[on], node[on]
                edges, node, n = np.unique(node * len(known) + code[at + depth], return_inverse=True, return_counts=True)
                up, last = edges // len(known), edges % len(known)
                if depth == 1:
                    prefix = mix(known[up] * np.uint64(0x9E3779B97F4A7C15) + known[last]) >> np.uint64(32)
                    part = (prefix * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                else:
                    part = part[up]
                parent = pa.array(up)
                lang = lang.take(parent)
                phrases = pc.binary_join_element_wise(phrases.take(parent), words.take(pa.array(last)), pa.scalar(" ", pa.large_string()))
                found.append({"part": pa.array(part), "lang": lang, "phrase": phrases, "n": pa.array(n)})
            rows = pa.concat_tables(map(pa.table, found)).sort_by([("part", "ascending"), ("lang", "ascending"), ("phrase", "ascending")]).combine_chunks()
            if len(rows):
                part, lang = rows.column("part").to_numpy(), rows.column("lang").combine_chunks().dictionary_encode().indices.to_numpy()
                starts = group_starts(part, lang)
                lists = pa.array(starts, pa.int32())
                cells = [rows.column(c).combine_chunks().cast(k) for c, k in (("phrase", pa.string()), ("n", pa.int64()))]
                head = rows.select(["part", "lang"]).take(pa.array(starts[:-1]))
                yield from _batches(head.append_column("phrases", pa.ListArray.from_arrays(lists, cells[0])).append_column("counts", pa.ListArray.from_arrays(lists, cells[1])), 64)

    return run


def merged(least: int):
    """A function of the sorted runs of one range and language: they are merged, and nodes of `least` or more stay."""

    def run(table: pa.Table) -> pa.Table:
        phrases = pa.concat_arrays([x.flatten() for x in table.column("phrases").chunks])
        counts = pa.concat_arrays([x.flatten() for x in table.column("counts").chunks])
        order = pc.sort_indices(phrases)
        phrases, counts = phrases.take(order), counts.take(order).to_numpy()
        new = np.ones(len(phrases), bool)
        new[1:] = pc.not_equal(phrases.slice(1), phrases.slice(0, len(phrases) - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        n = np.add.reduceat(counts, starts) if len(starts) else counts[:0]
        keep = n >= least
        phrases = phrases.take(pa.array(starts[keep]))
        lang = pa.array([table.column("lang")[0].as_py()] * len(phrases), pa.string())
        return pa.table({"lang": lang, "phrase": phrases, "size": pc.add(pc.count_substring(phrases, " "), 1).cast(pa.int32()), "a": pa.array(n[keep])})

    return run


def linked(nodes: DataFrame, below: DataFrame) -> DataFrame:
    """Nodes of one depth, with l and r: the counts of the first k and of the other words, for each k. `below` has the same of
    the depth above them in the trie: the parent is the phrase without its last word, the suffix link that without its first."""
    cut = nodes.withColumns({"parent": F.expr("substring_index(phrase, ' ', size - 1)"), "suffix": F.expr("substring_index(phrase, ' ', 1 - size)")})
    up = below.select("lang", F.col("phrase").alias("parent"), F.array_append("l", F.col("a")).alias("l"))
    on = below.select("lang", F.col("phrase").alias("suffix"), F.array_prepend("r", F.col("a")).alias("r"))
    return cut.join(up, ["lang", "parent"]).join(on, ["lang", "suffix"]).select("lang", "phrase", "size", "a", "l", "r")


def ranked(df: DataFrame, by: str, order: list, most: int) -> DataFrame:
    """The first `most` rows of each `by` with their rank (from 1). Rows are dealt out by ranges of the whole order, so that no
    task gets a group; a range's offset is the number of its group's rows in the ranges before."""
    rows = df.repartitionByRange(*[F.col(by), *order]).sortWithinPartitions(F.col(by), *order).withColumn("__id", F.monotonically_increasing_id())
    rows = stored(rows.withColumns({"__range": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    sizes = rows.groupBy(by, "__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(sizes.withColumn("__before", before).filter(F.col("__before") < most), "ranked-offsets")
    rank = F.col("__at") - F.col("__first") + F.col("__before") + 1
    return rows.join(sized(offsets), [by, "__range"]).withColumn("rank", rank).filter(F.col("rank") <= most)


def collocations(df: DataFrame, least: int = 30, inside: int = 80, most: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase is 2 to 4 words in one piece that occur `least` times or more (a). It's scored by its weakest cut into a first
    part (l) and the rest (r): floor(2,000,000 a / (l + r)); of equal cuts the first counts. A phrase inside a longer one
    that has at least `inside` percent of its occurrences is left out. n is the number of all words of the language.

    Three passes over the texts, each in shards of some SHARD words, counted before the shuffle: words; pairs of frequent
    words; and tries of what only frequent pairs make up. Passes know frequent words and pairs by maps of hashed keys of at
    most 32 MB (see Marked), which let more through where they are full, and lose nothing. Every count that comes out is one
    of whole strings. A shard's trie is serialised into sorted runs, one for each range of two-word prefixes, and the runs of a
    range are merged; so a range has the whole subtrees of its prefixes, and they are few enough for a task.

    A null lang is 'und', a null or empty text has no words; rows count one by one; other columns aren't looked at. An empty
    table gives an empty one."""
    spark = df.sparkSession
    small_batches(spark)
    texts = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    words = texts.mapInArrow(word_counts, "lang string, word string, key long, n long")
    words = words.groupBy("lang", "word", "key").agg(F.sum("n").alias("a"))
    words = stored(words.filter(F.col("word").isNull() | (F.col("a") >= least)), "collocation-words")
    frequent = Marked(words.filter("word IS NOT NULL"), "key")
    pairs = texts.mapInArrow(pair_counts(frequent), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    pairs = Marked(stored(pairs.filter(F.col("n") >= least).select("key"), "collocation-pairs"), "key")
    total = words.filter("word IS NULL").select("lang", F.col("a").alias("n"))
    ranges = max(RANGES, (total.agg(F.sum("n")).first()[0] or 0) >> 20)
    parts = texts.mapInArrow(tries(frequent, pairs, ranges), "part long, lang string, phrases array<string>, counts array<long>")
    nodes = stored(parts.groupBy("part", "lang").applyInArrow(merged(least), "lang string, phrase string, size int, a long"), "collocation-nodes")
    none = F.array().cast("array<bigint>")
    level = words.filter("word IS NOT NULL").select("lang", F.col("word").alias("phrase"), "a", none.alias("l"), none.alias("r"))
    found = None
    for size in range(2, DEPTH + 1):
        level = stored(linked(nodes.filter(F.col("size") == size), level), "collocation-level")
        found = level if found is None else found.unionByName(level)
    long = nodes.filter("size > 2")
    over = long.selectExpr("lang", "substring_index(phrase, ' ', size - 1) AS phrase", "a").union(long.selectExpr("lang", "substring_index(phrase, ' ', 1 - size)", "a"))
    over = over.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = "CAST({} AS DECIMAL(20, 0))"
    free = F.expr(f"longer IS NULL OR 100 * {wide.format('longer')} < {inside} * {wide.format('a')}")
    found = found.join(over, ["lang", "phrase"], "left").filter(free)
    cuts = f"transform(sequence(1, size - 1), k -> named_struct('score', 2000000 * {wide.format('a')} div ({wide.format('l[k - 1]')} + {wide.format('r[k - 1]')}), 'k', k))"
    found = found.withColumn("cut", F.array_min(F.expr(cuts)))
    found = found.select("lang", "phrase", "a", F.expr("l[cut.k - 1]").alias("l"), F.expr("r[cut.k - 1]").alias("r"), F.col("cut.score").alias("score"))
    first = ranked(found, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], most)
    return first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
