"""Near-equal lines by an exact set-similarity join, in the manner of PPJoin (Xiao and others, 2008).

Every line is its set of words. Words are ordered by rarity over the whole table, so that the first few of a line (its
prefix) are rare; two lines of Jaccard similarity t share a word of their prefixes, have sizes within t of each other,
and have enough words left after their first common one. Candidates that pass these filters are compared on all their
words, each as a digest of 64 bits. Equal sets are one class, which is joined once.

What is wanted is the earliest match of each line, not all pairs of a large group of near copies. So a semi-join tells
first which words hold candidates at all. The lines with such words are compared with the earliest line of the word
alone; those that may still have an earlier match are compared with the rest block by block inside tasks, which give one
row for each line at most.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BATCH, Marked, group_starts, let_go, settled, small_batches, stored, whole_groups
from tessera.llm.textblocks import LOWER, blocks, digests, mix, runs, words

LINES = "doc_id long, text_id long, line int, n int, hi long, lo long, skip int, parity long, parity2 long, copies int, prefix array<long>"
PLACE = ["doc_id", "text_id", "line"]
#: Lines of a bucket that one group holds of either side.
BLOCK_LINES = 2048
#: Parts of all words that are joined one after another, so that a part of them is on disk at a time.
SLICES = 2
#: Words are counted in 2**SLOT_BITS slots by digest; any order of words is exact, and slots only make it near to rarity.
SLOT_BITS, PARTS = 24, 64
#: Words that a task counts at a time.
COUNTED_WORDS = 1 << 21


def rarity(df: DataFrame, slot_bits: int = SLOT_BITS) -> np.ndarray:
    """One byte for each slot of word digests: 0 none, 1 one occurrence, then 8 steps for each doubling.

    Each task counts its own words, so many at a time, and sends the slots that it met, part by part as lists of steps and counts: a
    row for each slot would cost more than the counting, and a table of all slots more memory than the words. Whoever gets a part adds
    its lists up as they come, one part after another, and 2**slot_bits bytes come to the driver, however large the table is."""
    width = (1 << slot_bits) // PARTS

    def lists(held):
        slots, n = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(slots, np.arange(PARTS + 1) * width)
        for part, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            if lo < hi:
                steps = np.diff(slots[lo:hi], prepend=np.uint32(part * width))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([steps.tobytes()], pa.binary()), pa.array([n[lo:hi].astype(np.uint32).tobytes()], pa.binary())], names=["part", "steps", "counts"])

    def count(batches):
        let_go()
        held, n = [], 0
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                start, end, _ = words(data, offsets)
                held.append((digests(LOWER[data], start, end) >> np.uint64(64 - slot_bits)).astype(np.uint32))
                n += len(start)
                if n >= COUNTED_WORDS:
                    yield from lists(held)
                    held, n = [], 0
        if n:
            yield from lists(held)

    def packed(part, n):
        out = np.zeros(width, np.uint8)
        met = np.flatnonzero(n)
        out[met] = np.minimum(255, 1 + np.floor(8 * np.log2(n[met])))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["part", "codes"])

    def pack(batches):
        last, total = None, None
        for batch in batches:
            for part, steps, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if part != last:
                    if last is not None:
                        yield packed(last, total)
                    last, total = part, np.zeros(width, np.int64)
                total[np.cumsum(np.frombuffer(steps, np.uint32), dtype=np.int64)] += np.frombuffer(counts, np.uint32)
        if last is not None:
            yield packed(last, total)

    spark, codes = df.sparkSession, np.zeros((PARTS, width), np.uint8)
    before = spark.conf.get(BATCH)
    small_batches(spark)  # lists are long
    try:
        counted = df.select("text").mapInArrow(count, "part int, steps binary, counts binary")
        for r in counted.repartition("part").sortWithinPartitions("part").mapInArrow(pack, "part int, codes binary").collect():  # 2**slot_bits bytes at most
            codes[r["part"]] = np.frombuffer(r["codes"], np.uint8)
    finally:
        spark.conf.set(BATCH, before)
    return codes.reshape(-1)


def by_line(line: np.ndarray, code: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order of words by line, code and digest: by one key of the line, the code and the digest's upper half where that tells
    all words apart that differ, else by all three."""
    if line[-1] < 1 << 24:
        key = line.astype(np.uint64) << np.uint64(40) | code.astype(np.uint64) << np.uint64(32) | h >> np.uint64(32)
        order = np.argsort(key)
        key, word = key[order], h[order]
        if not ((key[1:] == key[:-1]) & (word[1:] != word[:-1])).any():
            return order
    return np.lexsort((h, code, line))


def line_sets(df: DataFrame, codes: np.ndarray, percent: int, least_words: int) -> DataFrame:
    """For every line of least_words distinct words or more: set size, a digest of 128 bits, and the digests of the prefix
    without its first `skip` words, which occur once in the whole table and so match nothing. Each word flips one of the 128
    bits of `parity` and `parity2`: lines that differ in d words differ in d bits at most. 64 bits would tell nothing of
    lines of a hundred words. text_id tells texts of one doc_id apart. Of equal sets in a batch the first has their number as
    `copies`, the others have 0 and no prefix."""
    shared = df.sparkSession.sparkContext.broadcast(codes)
    bits = int(np.log2(len(codes)))

    def sets(batch):
        rare = shared.value
        ids, texts = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
        for lo, hi, data, offsets in blocks(batch.column(1)):
            start, end, _ = words(data, offsets)
            if not len(start):
                continue
            h = digests(LOWER[data], start, end)
            code = rare[(h >> np.uint64(64 - bits)).astype(np.int64)]
            l0, _, row, number = numbered(data, offsets)
            line = np.searchsorted(l0, start, "right") - 1
            order = by_line(line, code, h)
            h, code, line = h[order], code[order], line[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
            h, code, line = h[new], code[new], line[new]
            first = np.searchsorted(line, np.arange(len(l0) + 1))
            n = np.diff(first)
            keep = np.flatnonzero(n >= least_words)
            if not len(keep):
                continue
            n, begin, row, number = n[keep], first[keep], row[keep], number[keep]
            total = np.zeros((2, len(h) + 1), np.uint64)
            for i in (0, 1):
                np.cumsum(mix(h, 201 + i), out=total[i, 1:])
            upper, lower = (mix(t[begin + n] - t[begin]) for t in total)
            bit = mix(h, 203)
            flips = np.zeros((2, len(h) + 1), np.uint64)
            for i in (0, 1):
                np.bitwise_xor.accumulate((bit >> np.uint64(6) & np.uint64(1) == i).astype(np.uint64) << (bit & np.uint64(63)), out=flips[i, 1:])
            parity = [f[begin + n] ^ f[begin] for f in flips]
            size = n - (percent * n + 99) // 100 + 1
            size[100 * n < percent * (n + 1)] = 0  # only equal sets match, and those are classes already
            seen = np.concatenate([[0], np.cumsum(code == 1)])
            skip = np.minimum(size, seen[begin + size] - seen[begin])
            left = size - skip
            at = np.repeat(begin + skip - np.concatenate([[0], np.cumsum(left)[:-1]]), left) + np.arange(left.sum())
            yield ids[lo:hi][row], texts[lo:hi][row], number, n, upper, lower, skip, *parity, left, h[at]

    def run(batches):
        let_go()
        for batch in batches:
            parts = list(sets(batch))
            if not parts:
                continue
            doc, text, line, n, upper, lower, skip, parity, parity2, left, prefix = map(np.concatenate, zip(*parts))
            copies = np.ones(len(doc), np.int32)
            order = np.argsort(upper)
            equal = upper[order[1:]] == upper[order[:-1]]
            order = order[np.append(equal, False) | np.insert(equal, 0, False)]
            order = order[np.lexsort((line[order], text[order], doc[order], lower[order], upper[order]))]
            if len(order):
                first = group_starts(upper[order], lower[order])
                copies[order] = 0
                copies[order[first[:-1]]] = np.diff(first)
                prefix, left = prefix[np.repeat(copies > 0, left)], np.where(copies > 0, left, 0)
            ends = np.concatenate([[0], np.cumsum(left)]).astype(np.int32)
            columns = [doc, text, line.astype(np.int32), n.astype(np.int32), upper.view(np.int64), lower.view(np.int64), skip.astype(np.int32), parity.view(np.int64), parity2.view(np.int64), copies]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(ends, prefix.view(np.int64))], names=[x.split()[0] for x in LINES.split(", ")])

    return df.select(F.col("doc_id").cast("long"), "text", text_id()).filter(F.col("doc_id").isNotNull()).mapInArrow(run, LINES)


def text_id() -> Column:
    return F.xxhash64("text").alias("text_id")


def line_words(df: DataFrame, wanted: Marked) -> DataFrame:
    """(place, words): the distinct words of the lines whose place_key is wanted, as digests."""

    def run(batches):
        for batch in batches:
            ids, texts = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            for lo, hi, data, offsets in blocks(batch.column(1)):
                l0, l1, row, number = numbered(data, offsets)
                doc, text = ids[lo:hi][row], texts[lo:hi][row]
                use = np.flatnonzero(wanted.holds(text ^ (doc << 3) ^ (number.astype(np.int64) << 17)))
                doc, text, number, l0, size = doc[use], text[use], number[use], l0[use], (l1 - l0)[use]
                ends = np.concatenate([[0], np.cumsum(size)])
                data = data[np.repeat(l0 - ends[:-1], size) + np.arange(ends[-1])]  # these lines alone
                start, end, _ = words(data, ends)
                if not len(start):
                    continue
                line = np.searchsorted(ends, start, "right") - 1
                h = digests(LOWER[data], start, end)
                order = by_line(line, np.zeros(len(h), np.uint8), h)
                h, line = h[order], line[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
                h, line = h[new], line[new]
                first = group_starts(line)
                at = line[first[:-1]]
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(text[at]), pa.array(number[at], pa.int32()), lists], names=[*PLACE, "words"])

    rows = df.select(F.col("doc_id").cast("long"), "text", text_id()).filter(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, text_id long, line int, words array<long>")
    return rows.select(F.struct(*PLACE).alias("place"), "words").dropDuplicates(["place"])


def numbered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and number of each line that isn't empty: the number counts the newlines before it in its text."""
    start, end = runs(data != 10, offsets)
    row = np.searchsorted(offsets, start, "right") - 1
    breaks = np.flatnonzero(data == 10)
    return start, end, row, np.searchsorted(breaks, start) - np.searchsorted(breaks, offsets)[row]


def place_key(place: str) -> Column:
    return F.expr(f"{place}.text_id ^ shiftleft({place}.doc_id, 3) ^ shiftleft(cast({place}.line as long), 17)")


def words_of(df: DataFrame, places: DataFrame) -> DataFrame:
    """The words of these places (column p), stored."""
    keys = stored(places.select(place_key("p").alias("key")).distinct(), "line-keys")
    return stored(line_words(df, Marked(keys, "key")), "line-words")


def similar(a: str, b: str, percent: int) -> str:
    """SQL: lines that share a token may have the similarity, by their sizes, by what is left after the token, and by
    the parity bits. True at the first common token of all lines that have it."""
    return (
        f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)"
        f" AND least({a}.n - {a}.at, {b}.n - {b}.at) * {100 + percent} >= {percent} * ({a}.n + {b}.n)"
        f" AND {apart(a, b)} * {100 + percent} <= {100 - percent} * ({a}.n + {b}.n)"
    )


def apart(a: str, b: str) -> str:
    """SQL: bits in which the parities of two lines differ."""
    return f"(bit_count({a}.parity ^ {b}.parity) + bit_count({a}.parity2 ^ {b}.parity2))"


def verified(pairs: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """The pairs of places (y, x) whose full sets of words have 100 * common >= percent * all."""
    both = pairs.join(words.select(F.col("place").alias("y"), F.col("words").alias("b")), "y").join(words.select(F.col("place").alias("x"), F.col("words").alias("a")), "x")
    common = F.size(F.array_intersect("a", "b"))
    return both.filter(100 * common >= percent * (F.size("a") + F.size("b") - common)).select("y", "x")


def _first_similar(mine: np.ndarray, n: np.ndarray, sets: np.ndarray, ends: np.ndarray, order: np.ndarray, percent: int) -> int:
    """The first of the sets in `order` that is similar to `mine`, or -1."""
    mine, at, step = np.sort(mine), 0, 16
    while at < len(order):
        some = order[at : at + step]
        size = n[some]
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        tokens = sets[np.repeat(ends[some] - begin, size) + np.arange(size.sum())]
        place = np.minimum(np.searchsorted(mine, tokens), len(mine) - 1)
        common = np.add.reduceat((mine[place] == tokens).astype(np.int64), begin)
        good = np.flatnonzero(100 * common >= percent * (size + len(mine) - common))
        if len(good):
            return int(some[good[0]])
        at, step = at + step, step * 4
    return -1


def earliest_in_blocks(live: DataFrame, tokens: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """(y, x): for each live line the earliest match x before its bound, from each pair of blocks of its buckets.

    live: token, place, n, at, parity, parity2, bound. Buckets of the same lines count once. The lines of a bucket and its live
    lines are dealt into blocks, so that a group is of bounded size however large the bucket is."""
    same = tokens.join(live.select("token").distinct(), "token").groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("place")).alias("h0"), F.bit_xor(F.xxhash64("place", F.lit(1))).alias("h1"), F.sum(F.xxhash64("place", F.lit(2)).cast("decimal(20,0)")).alias("h2")
    )
    first = same.groupBy("n", "h0", "h1", "h2").agg(F.min("token").alias("first"))
    same = stored(same.join(first, ["n", "h0", "h1", "h2"]).select("token", "first", "n"), "line-buckets")
    live = live.join(same, "token").groupBy(F.col("first").alias("token"), "place", "bound", "parity", "parity2").agg(F.lit(0).alias("one")).drop("one")
    sizes = live.groupBy("token").agg(F.ceil(F.count("*") / BLOCK_LINES).cast("int").alias("ys")).join(same.filter("token = first"), "token")
    sizes = stored(sizes.select("token", "ys", F.ceil(F.col("n") / BLOCK_LINES).cast("int").alias("xs")), "line-blocks")

    def dealt(rows: DataFrame, own: str, other: str, asks: bool, bound: str) -> DataFrame:
        rows = rows.join(sizes, "token").withColumns({own: F.pmod(F.xxhash64("place"), F.col(own + "s")).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(other + "s") - 1))})
        return rows.select("token", "x", "y", F.lit(asks).alias("asks"), "place", F.col(bound).alias("bound"), "parity", "parity2")

    rows = dealt(tokens, "x", "y", False, "place").union(dealt(live, "y", "x", True, "bound")).join(words, "place")
    flat = rows.select("token", "x", "y", "asks", "parity", "parity2", *(F.col(f"place.{c}").alias(c) for c in PLACE), *(F.col(f"bound.{c}").alias(f"b_{c}") for c in PLACE), "words")
    out = ", ".join(f"{side}_{c} {'int' if c == 'line' else 'long'}" for side in "yx" for c in PLACE)

    def run(batches):
        for t in whole_groups(batches, ["token", "x", "y"]):
            c = {name: t.column(name).to_numpy() for name in t.column_names if name != "words"}
            lists = t.column("words").combine_chunks()
            ends, sets = lists.offsets.to_numpy(), lists.values.to_numpy()
            n, starts, found = np.diff(ends), group_starts(c["token"], c["x"], c["y"]), []
            parity, parity2 = (c[name].view(np.uint64) for name in ("parity", "parity2"))
            for lo, hi in zip(starts[:-1], starts[1:]):
                asks = c["asks"][lo:hi]
                mine, old = lo + np.flatnonzero(asks), lo + np.flatnonzero(~asks)
                if not len(mine) or not len(old):
                    continue
                old = old[np.lexsort(tuple(c[k][old] for k in reversed(PLACE)))]
                rank = np.lexsort((np.repeat([1, 0], [len(old), len(mine)]), *(np.concatenate([c[k][old], c["b_" + k][mine]]) for k in reversed(PLACE))))
                before = np.empty(len(rank), np.int64)  # lines of `old` before each bound
                before[rank] = np.cumsum(rank < len(old)) - (rank < len(old))
                for i, limit in zip(mine, before[len(old) :]):
                    x = old[:limit]
                    ok = 100 * np.minimum(n[x], n[i]) >= percent * np.maximum(n[x], n[i])
                    bits = np.bitwise_count(parity[x] ^ parity[i]).astype(np.int64) + np.bitwise_count(parity2[x] ^ parity2[i])
                    ok &= bits * (100 + percent) <= (100 - percent) * (n[x] + n[i])
                    j = _first_similar(sets[ends[i] : ends[i + 1]], n, sets, ends, x[ok], percent)
                    if j >= 0:
                        found.append((i, j))
            if found:
                pair = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(c[k][side]) for side in pair for k in PLACE], names=[x.split()[0] for x in out.split(", ")])

    pairs = flat.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(run, out)
    return pairs.select(*(F.struct(*(F.col(f"{side}_{c}").alias(c) for c in PLACE)).alias(side) for side in "yx"))


def live_tokens(reps: DataFrame, percent: int) -> DataFrame:
    """A row for each word in the prefix of a class that shares it with another class, such that the two pass all filters:
    token, place, n, at, parity, parity2. Both sides of the semi-join are the same shuffle, read twice."""
    tokens = reps.select("hi", "parity", "parity2", F.col("n").cast("long").alias("n"), "skip", F.posexplode("prefix").alias("i", "token"))
    tokens = tokens.select("token", "hi", "parity", "parity2", (F.shiftleft("n", 32) + F.col("i") + F.col("skip")).alias("n_at"))
    nx, ny, ax, ay = "shiftright(x.n_at, 32)", "shiftright(y.n_at, 32)", "(x.n_at & 4294967295)", "(y.n_at & 4294967295)"
    both = F.expr(
        f"x.token = y.token AND NOT (x.hi = y.hi AND x.parity = y.parity AND x.parity2 = y.parity2) AND 100 * least({nx}, {ny}) >= {percent} * greatest({nx}, {ny})"
        f" AND least({nx} - {ax}, {ny} - {ay}) * {100 + percent} >= {percent} * ({nx} + {ny})"
        f" AND {apart('x', 'y')} * {100 + percent} <= {100 - percent} * ({nx} + {ny})"
    )
    parts = []
    for part in range(SLICES):
        own = tokens.filter(F.pmod("token", F.lit(SLICES)) == part)
        parts.append(stored(own.alias("x").join(own.alias("y"), both, "left_semi"), "line-tokens"))
    rows = functools.reduce(DataFrame.union, parts).join(reps.select("hi", "parity", "parity2", "place"), ["hi", "parity", "parity2"])
    return rows.select("token", "place", F.shiftright("n_at", 32).alias("n"), F.col("n_at").bitwiseAND(F.lit(4294967295)).alias("at"), "parity", "parity2")


def earliest_links(df: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """(y, x): the earliest match x of each class y that has one, as places of their first lines."""
    hubs = tokens.groupBy("token").agg(F.min(F.struct("place", "n", "at", "parity", "parity2")).alias("h")).select("token", "h.*")
    tried = tokens.alias("b").join(hubs.alias("a"), F.expr(f"a.token = b.token AND a.place < b.place AND {similar('a', 'b', percent)}"))
    tried = stored(tried.groupBy(F.col("b.place").alias("y")).agg(F.min("a.place").alias("x")), "line-tried")
    words = words_of(df, tokens.select(F.col("place").alias("p")))
    known = stored(verified(tried, words, percent), "line-known")
    state = tried.join(known.select("y", F.col("x").alias("match")), "y", "left").select(F.col("y").alias("place"), F.col("x").alias("tried"), F.coalesce("match", "y").alias("bound"))
    asked = tokens.join(state, "place", "left").withColumn("bound", F.coalesce("bound", "place"))
    live = asked.alias("b").join(tokens.alias("a"), F.expr(f"a.token = b.token AND a.place < b.bound AND NOT (a.place <=> b.tried) AND {similar('a', 'b', percent)}"), "left_semi")
    live = stored(live.drop("tried"), "line-live")
    more = stored(earliest_in_blocks(live, tokens, words, percent), "line-more")
    return known.select("y", "x").union(more).groupBy("y").agg(F.min("x").alias("x"))


def later_lines(df: DataFrame, percent: int = 80, least_words: int = 5) -> DataFrame:
    """One row per line to remove: doc_id, text_id, line (counted from 0), and the earlier line that it matches
    (match_doc_id, match_line).

    A line goes if an earlier line (by doc_id, text_id, then place; kept or not) has 100 * common >= percent * all of the
    distinct words of both. Words are runs other than ASCII white space, A-Z lower case. Lines of fewer than
    least_words distinct words stay, as their equality says little. Rows without doc_id or text have no lines. text_id is
    a digest of the text: rows that share a doc_id are told apart by it, and rows equal in both are one text. The match
    named is the first line with the same set, or else the earliest similar one.
    """

    place = F.struct(*PLACE)

    def build() -> DataFrame:
        lines = stored(line_sets(df, rarity(df), percent, least_words), "lines")
        # equal sets of a batch are one row by now: rows are dealt and sorted once, and not counted before they are dealt
        reps = lines.filter("copies > 0").repartition("hi", "lo").groupBy("hi", "lo").agg(F.min(place).alias("place"), F.sum("copies").alias("copies"), *(F.first(c).alias(c) for c in ("n", "skip", "parity", "parity2", "prefix")))
        reps = stored(reps, "line-classes")
        tokens = stored(live_tokens(reps.filter("size(prefix) > 0"), percent), "line-live-tokens")
        links = earliest_links(df, tokens, percent)
        classes = reps.select("hi", "lo", "place", "copies").join(links.withColumnRenamed("y", "place"), "place", "left").filter("copies > 1 OR x IS NOT NULL")
        found = lines.select(*PLACE, "hi", "lo").join(classes.select("hi", "lo", "place", "x"), ["hi", "lo"]).withColumn("m", F.when(place != F.col("place"), F.col("place")).otherwise(F.col("x")))
        return found.filter("m IS NOT NULL").select(*PLACE, F.col("m.doc_id").alias("match_doc_id"), F.col("m.line").alias("match_line"))

    return settled(df.sparkSession, "lines-later", build)


def without_later_lines(df: DataFrame, percent: int = 80, least_words: int = 5) -> DataFrame:
    """df with those lines cut out of its texts, row by row. A document that loses a line and has no word left goes as a
    whole; documents that lose nothing stay as they are, empty ones too. n_chars, where there is one, counts what is left."""
    by = [F.col("doc_id").alias("__doc"), F.col("text_id").alias("__id")]
    gone = settled(df.sparkSession, "lines-gone", lambda: later_lines(df, percent, least_words).groupBy(by).agg(F.collect_set("line").alias("__gone")))
    kept = F.filter(F.split("text", "\n"), lambda body, i: ~F.array_contains("__gone", i))
    rows = df.join(gone, (df["doc_id"].cast("long") == F.col("__doc")) & (F.xxhash64(df["text"]) == F.col("__id")), "left").withColumn("__text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    rows = rows.filter(F.col("__gone").isNull() | F.col("__text").rlike(r"[^\x20\x09-\x0D]"))
    out = rows.select(*(F.col("__text").alias(c) if c == "text" else F.when(F.col("__gone").isNull(), F.col(c)).otherwise(F.length("__text").cast(t)).alias(c) if c == "n_chars" else F.col(c) for c, t in df.dtypes))
    return out
