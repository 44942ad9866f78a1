"""Near duplicates: fast similarity sketching (Dahlgaard, Knudsen and Thorup, 2017), banding, exact verification.

A sketch has one coordinate per bin. In each of the first T rounds every shingle falls into one bin by a fresh hash; in
round T + i every shingle falls into bin i, so that all bins fill at last. A bin keeps the value of the earliest round
that reached it, and the least hash of that round. Bands of coordinates give buckets; texts in one bucket are compared
on their full sets of shingles: each with a hub of the bucket first, and then, block by block inside tasks, with
whatever isn't in its component yet. A task gives a spanning forest of the links that it verifies, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Marked, group_starts, settled, stored, whole_groups
from tessera.llm.graphs import components
from tessera.llm.textblocks import LOWER, blocks, digests, mix, words

BINS, ROWS = 200, 5
#: One bit of each of the first 192 coordinates: pairs with a hub that differ in more than 48 aren't worth a look. They
#: stay apart, and what is apart is compared in full later on, so that no link hangs on these bits.
BITS, MOST_BITS = 192, 48
#: Buckets are cut into blocks of about this many shingles; a task holds two blocks.
BLOCK_SHINGLES = 1 << 19
#: Texts of a block, whatever their sizes: pairs inside a task are a matrix of twice as many rows and columns.
BLOCK_TEXTS = 2048
SIGNED = "doc_id long, n_shingles long, hi long, lo long, s0 long, s1 long, s2 long, bands array<long>"
BIT_COLUMNS = ("s0", "s1", "s2")


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle digests of each row, row by row and sorted, and where each row's begin. A row of fewer
    than k words is one shingle; a row without words has none."""
    start, end, first = words(data, offsets)
    count = np.diff(first)
    h = digests(LOWER[data], start, end)
    row = np.repeat(np.arange(len(count)), count)
    n = len(h)
    s = np.zeros(n, np.uint64)
    place = np.arange(n) - first[:-1][row]
    span = np.minimum(k, count)[row]
    for i in range(k):
        inside = i < span
        later = np.minimum(np.arange(n) + i, n - 1)
        s = np.where(inside, mix(s * np.uint64(0x9E3779B97F4A7C15) + h[later]), s)
    whole = place + span <= count[row]
    s, row = s[whole], row[whole]
    s = mix(s + span[whole].astype(np.uint64))
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return s[new], np.searchsorted(row[new], np.arange(len(count) + 1))


def sketch(s: np.ndarray, first: np.ndarray, bins: int = BINS) -> np.ndarray:
    """(rows, bins) coordinates; rows without shingles stay at the largest value."""
    rows = len(first) - 1
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(rows * bins, none)
    live = np.flatnonzero(np.diff(first))
    row = np.repeat(np.arange(rows), np.diff(first))
    for turn in range(2 * bins):
        if not len(live):
            break
        if turn:
            active = np.zeros(rows, bool)
            active[live] = True
            keep = active[row]
            s, row = s[keep], row[keep]
        h = mix(s, turn + 1)
        at = (h >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24) if turn < bins else np.full(len(h), turn - bins, np.uint64)
        key = row * bins + at.astype(np.int64)
        value = mix(h, 7) >> np.uint64(8) | np.uint64(min(turn, 255)) << np.uint64(56)
        # later rounds have larger values by their leading byte, so that a plain minimum keeps the earliest round
        np.minimum.at(out, key, value)
        live = live[(out.reshape(rows, bins)[live] == none).any(axis=1)]
    return out.reshape(rows, bins)


def signed(df: DataFrame, k: int) -> DataFrame:
    """doc_id, size and 128-bit digest of the shingle set, and a key for each band of the sketch."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                s, first = shingles(data, offsets, k)
                n = np.diff(first)
                total = np.zeros((2, len(s) + 1), np.uint64)
                for i in (0, 1):
                    np.cumsum(mix(s, 101 + i), out=total[i, 1:])
                upper, lower = (mix(t[first[1:]] - t[first[:-1]]) for t in total)
                coordinates = sketch(s, first)
                bits = np.packbits((mix(coordinates[:, :BITS], 11) & np.uint64(1)).astype(bool), axis=1).view(np.int64)
                bands = coordinates.reshape(hi - lo, BINS // ROWS, ROWS)
                key = np.broadcast_to(np.arange(BINS // ROWS, dtype=np.uint64), bands.shape[:2]).copy()
                for i in range(ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i])
                lists = pa.ListArray.from_arrays(np.arange(hi - lo + 1, dtype=np.int32) * (BINS // ROWS), key.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(upper.view(np.int64)), pa.array(lower.view(np.int64)), *(pa.array(bits[:, i]) for i in range(3)), lists],
                    names=[x.split()[0] for x in SIGNED.split(", ")],
                )

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SIGNED)


def shingle_sets(df: DataFrame, k: int, wanted: Marked) -> DataFrame:
    """(rep, shingles): the full sets of the texts whose doc_id is wanted."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(wanted.holds(batch.column(0).to_numpy())))
            for lo, hi, data, offsets in blocks(batch.column(1)):
                s, first = shingles(data, offsets, k)
                sets = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), sets], names=["rep", "shingles"])

    sets = df.select(F.col("doc_id").cast("long").alias("rep"), "text").filter("rep IS NOT NULL").mapInArrow(run, "rep long, shingles array<long>")
    return sets.groupBy("rep", F.xxhash64("shingles").alias("d")).agg(F.first("shingles").alias("shingles")).drop("d")  # repeated rows are one


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * common >= percent * all."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def forest(sets: list[np.ndarray], component: np.ndarray, second: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) between rows of different components whose sets are similar: enough of them to connect whatever all
    of them connect. Where some rows are of a second block, links inside a block are left to other groups."""
    n, size = len(sets), np.array([len(s) for s in sets])
    cross = bool(second.any() and not second.all())
    left, right = (np.flatnonzero(~second), np.flatnonzero(second)) if cross else (np.arange(n), np.arange(n))
    kind, members = np.unique(component, return_inverse=True)
    if len(kind) < 2:
        return []
    if not cross:  # a pair across components has an end outside the largest one
        left = np.flatnonzero(members != np.bincount(members).argmax())
    row = np.repeat(np.arange(n), size)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times[column] > 1
    row, column = row[often], (np.cumsum(times > 1) - 1)[column[often]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    at = np.full((2, n), -1)
    at[0, left], at[1, right] = np.arange(len(left)), np.arange(len(right))
    width, last = 4096, int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, last, width):
        part = slice(*np.searchsorted(column, (lo, lo + width)))
        r, c = row[part], column[part] - lo
        one, two = np.zeros((len(left), min(width, last - lo)), np.float32), np.zeros((len(right), min(width, last - lo)), np.float32)
        one[at[0, r[at[0, r] >= 0]], c[at[0, r] >= 0]] = 1
        two[at[1, r[at[1, r] >= 0]], c[at[1, r] >= 0]] = 1
        common += one @ two.T
    good = np.zeros((n, n), bool)
    good[np.ix_(left, right)] = (common > 0) & (100 * common.astype(np.int64) >= percent * (size[left][:, None] + size[right][None, :] - common.astype(np.int64)))
    good |= good.T
    good &= members[:, None] != members[None, :]
    links, fresh = [], np.ones(n, bool)
    for start in range(n):
        if not fresh[start]:
            continue
        fresh[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(good[i] & fresh):
                fresh[j] = False
                todo.append(int(j))
                links.append((i, int(j)))
    return links


def links_across(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect whatever similar texts of one bucket and different components connect. rows: key, rep,
    n, component. Buckets of the same texts count once; large ones are dealt into blocks, and each pair of blocks is one
    group of bounded size."""
    keys = rows.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.xxhash64("rep", F.lit(1)).cast("decimal(20,0)")).alias("y"))
    keys = keys.groupBy("total", "members", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.greatest(F.col("total") / BLOCK_SHINGLES, F.col("members") / BLOCK_TEXTS)).cast("int").alias("blocks"))
    dealt = rows.join(keys, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.select("key", "rep", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "component", (F.col("own") > F.col("other")).alias("second"))
    dealt = dealt.join(sets, "rep").select("key", "i", "j", "rep", "component", "second", "shingles")

    def run(batches):
        for t in whole_groups(batches, ["key", "i", "j"], 2048):
            key, i, j, rep, component = (t.column(c).to_numpy() for c in ("key", "i", "j", "rep", "component"))
            second, lists = t.column("second").to_numpy(), t.column("shingles").combine_chunks()
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            found = []
            starts = group_starts(key, i, j)
            for lo, hi in zip(starts[:-1], starts[1:]):
                if hi - lo > 1:
                    own = [values[ends[x] : ends[x + 1]] for x in range(lo, hi)]
                    found += [(lo + a, lo + b) for a, b in forest(own, component[lo:hi], second[lo:hi], percent)]
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], names=["a", "b"])

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    Words are runs of bytes other than ASCII white space, A-Z lower case; a set holds the distinct shingles of k words,
    or the whole text if it has fewer. Texts are linked if 100 * common >= percent * all; a component is named by its
    smallest doc_id, whose row is kept. Null and empty texts are linked with nothing. Rows that share a doc_id are one
    node. A row without doc_id is linked with nothing: its component_id is null, and it is kept.

    Texts with equal sets are one class; its smallest doc_id stands for it. At a similarity of 0.8 a pair shares a bucket
    but for a chance of 2e-7. In each bucket every class is compared with a hub, `rounds` times with another one where
    there are several components still; what is then apart is compared in full (links_across).
    """
    return settled(docs.sparkSession, "minhash-groups", lambda: _near_duplicates(docs, k, percent, rounds))


def _near_duplicates(docs: DataFrame, k: int, percent: int, rounds: int) -> DataFrame:
    marks = stored(signed(docs, k), "minhash")
    bits = list(BIT_COLUMNS)
    real = marks.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = real.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), *(F.first(c).alias(c) for c in (*bits, "bands")))
    reps = stored(reps, "minhash-reps")
    several = reps.filter("copies > 1").select("hi", "lo", "rep")
    copies = stored(real.select("doc_id", "hi", "lo").join(several, ["hi", "lo"]).filter("doc_id <> rep").distinct(), "minhash-copies")
    # a doc_id with several texts joins the classes of all of them
    twice = real.groupBy("doc_id").agg(F.count_distinct("hi", "lo").alias("n")).filter("n > 1").select("doc_id")
    edges = stored(copies.join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "minhash-edges")
    narrow = reps.select("rep", "n", *bits)
    # a set so small that one shingle more or less is too much has only equal partners, and those are its class
    placed = reps.filter(F.col("n") * (100 - percent) >= percent).select("rep", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("far")).filter("hub <> far").drop("far")
    placed = stored(placed.join(shared, "key").select("key", "rep", "hub"), "minhash-placed")
    sets = stored(shingle_sets(docs, k, Marked(placed.select("rep").distinct(), "rep")), "minhash-sets")
    differ = " + ".join(f"bit_count({c} ^ {c}_b)" for c in bits)
    close = F.expr(f"100 * least(n, n_b) >= {percent} * greatest(n, n_b) AND {differ} <= {MOST_BITS}")
    other = narrow.select(F.col("rep").alias("hub"), F.col("n").alias("n_b"), *(F.col(c).alias(f"{c}_b") for c in bits))

    def with_hub(pairs: DataFrame) -> DataFrame:
        near = pairs.distinct().join(narrow, "rep").join(other, "hub").filter(close)
        return stored(verified(near.select(F.col("rep").alias("a"), F.col("hub").alias("b")), sets, percent), "minhash-edges")

    edges = edges.union(with_hub(placed.filter("rep <> hub").select("rep", "hub")))
    for turn in range(rounds):
        labels = components(edges)
        rows = placed.select("key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        split = rows.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min_by(F.struct("rep", "component"), F.xxhash64("rep", F.lit(turn))).alias("h")).filter("c0 <> c1").select("key", "h")
        rows = stored(rows.join(split, "key").select("key", "rep", "component", F.col("h.rep").alias("hub"), F.col("h.component").alias("of_hub")), "minhash-apart")
        if rows.isEmpty():
            break
        if turn < rounds - 1:
            edges = edges.union(with_hub(rows.filter("component <> of_hub").select("rep", "hub")))
        else:
            rows = rows.join(narrow.select("rep", "n"), "rep")
            edges = edges.union(stored(links_across(rows, sets, percent), "minhash-edges"))
            labels = components(edges)
    of_copies = copies.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    known = labels.select(F.col("node").alias("doc_id"), "component").union(of_copies).groupBy("doc_id").agg(F.min("component").alias("component"))
    found = marks.select("doc_id", "n_shingles").join(known, "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
