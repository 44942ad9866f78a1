"""Graphs as edge tables: building, degrees, triangles, mixing, multiplex layers, and iterated joins."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import ratio
from tessera.operators.ranks import PART, ranged
from tessera.sources.stored import stored

#: Contacts of a range of nodes; a task holds those of two ranges.
RANGE_CONTACTS = 1 << 20
#: Contacts below which a range isn't cut for more tasks.
LEAST_CONTACTS = 1 << 15
#: Rows of a part of a table that is dealt by its pairs.
PART_ROWS = 1 << 20
#: Cells of a table of least times, and ways that are sorted at once.
CELLS, WAYS = 1 << 23, 1 << 20
#: One node in so many may reach all that it reaches early, where late ways are looked at one by one.
EARLY = 8
#: An unknown time of a meeting.
NONE = -(1 << 63)


def edges(df: DataFrame, source: str, target: str, extra: list[str] | None = None) -> DataFrame:
    """Directed edges (src, dst and any extra keys) with the number of rows as weight; no self-loops."""
    rows = df.select(F.col(source).alias("src"), F.col(target).alias("dst"), *(extra or [])).filter("src <> dst")
    return rows.groupBy("src", "dst", *(extra or [])).agg(F.count("*").alias("w"))


def undirected(e: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Distinct pairs a < b of linked nodes."""
    return e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), *(extra or [])).distinct()


def dyad_ways(e: DataFrame) -> DataFrame:
    """Distinct pairs a < b of linked nodes, and their way: 1 from a to b, 2 from b to a, 3 both."""
    arcs = e.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.when(F.col("src") < F.col("dst"), 1).otherwise(2).cast("tinyint").alias("way"))
    return arcs.groupBy("a", "b").agg(F.bit_or("way").alias("way"))


def turned(way: str) -> Column:
    """The way of a pair as its other end sees it."""
    return F.when(F.col(way) == 3, F.col(way)).otherwise(3 - F.col(way)).cast("tinyint")


def linked(df: DataFrame, source: str, target: str, extra: list[str] | None = None) -> DataFrame:
    """Distinct pairs a < b (and any extra keys) of linked nodes from rows, which aren't counted first. Rows are dealt by their pairs into
    as many parts as PART_ROWS asks, so that a task's memory doesn't grow with the table; most pairs are met once, so that nothing
    is gained by putting them together before the shuffle."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / PART_ROWS))
    rows = df.filter(F.col(source) != F.col(target)).select(F.least(source, target).alias("a"), F.greatest(source, target).alias("b"), *(extra or []))
    return rows.repartition(parts, "a", "b", *(extra or [])).distinct()


def both_ways(pairs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    x = extra or []
    return pairs.select(F.col("a").alias("v"), F.col("b").alias("u"), *x).unionByName(pairs.select(F.col("b").alias("v"), F.col("a").alias("u"), *x))


def degrees(pairs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("v"), *(extra or [])).groupBy("v", *(extra or [])).agg(F.count("*").alias("degree"))


def degree_ccdf(pairs: DataFrame) -> DataFrame:
    """For each degree: nodes that have it, and the share of nodes that have it or more."""
    counts = degrees(pairs).groupBy("degree").agg(F.count("*").alias("n"))
    up = Window.partitionBy(F.lit(0)).orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("ccdf", F.sum("n").over(up) / F.sum("n").over(Window.partitionBy(F.lit(0))))


def triangles(pairs: DataFrame) -> DataFrame:
    """Each triangle once, as x, y, z upwards. Pairs point from the end of smaller degree to the other (ties: by id), so that no node
    has many outgoing pairs, however many neighbours a hub has.

    A triangle is a lower pair (x, y), an upper one (y, z) and a long one (x, z). Pairs are kept for a part only where their ends
    can have it: y has pairs both in and out, z ends an upper pair, x starts a lower and a long one. Two pairs of x are put together after
    that, so that a node makes no wedges which its ends rule out. `pairs` are read several times and should be stored. Where they have
    ways (`dyad_ways`), a triangle has those from x to y, from x to z and from y to z, as xy, xz and yz."""
    ways = "way" in pairs.columns
    way = lambda name: [F.col("way").alias(name)] if ways else []
    d = degrees(pairs)
    ranked = pairs.join(d.withColumnRenamed("v", "a").withColumnRenamed("degree", "da"), "a").join(d.withColumnRenamed("v", "b").withColumnRenamed("degree", "db"), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    seen = [F.when(up, F.col("way")).otherwise(turned("way")).alias("way")] if ways else []
    out = ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"), F.greatest("da", "db").alias("dy"), *seen)
    out = stored(out, "pairs-upwards")
    between = stored(out.select("x").distinct().join(out.select(F.col("y").alias("x")).distinct(), "x", "left_semi"), "between")
    upper = stored(out.join(between, "x", "left_semi").select(F.col("x").alias("y"), F.col("y").alias("z"), *way("yz")), "pairs-upper")
    long = stored(out.join(upper.select(F.col("z").alias("y")).distinct(), "y", "left_semi").select("x", F.col("y").alias("z"), F.col("dy").alias("dz"), *way("xz")), "pairs-long")
    lower = out.join(between.withColumnRenamed("x", "y"), "y", "left_semi").join(long.select("x").distinct(), "x", "left_semi").select("x", "y", "dy", *way("xy"))
    wedge = lower.join(long, "x").filter((F.col("dy") < F.col("dz")) | ((F.col("dy") == F.col("dz")) & (F.col("y") < F.col("z"))))
    return wedge.select("x", "y", "z", *(["xy", "xz"] if ways else [])).join(upper, ["y", "z"])


def clustering(pairs: DataFrame) -> DataFrame:
    """Per node: degree, triangles and the local coefficient (0 below degree 2). Pairs are stored once for all that reads them."""
    pairs = stored(pairs, "pairs")
    t = triangles(pairs).select(F.explode(F.array("x", "y", "z")).alias("v")).groupBy("v").agg(F.count("*").alias("triangles"))
    k = F.col("degree")
    rows = degrees(pairs).join(t, "v", "left").fillna(0, ["triangles"])
    return rows.withColumn("local", F.when(k >= 2, 2.0 * F.col("triangles") / (k * (k - 1))).otherwise(0.0))


def clustering_summary(pairs: DataFrame) -> DataFrame:
    c = clustering(pairs)
    k = F.col("degree")
    return c.agg(F.count("*").alias("nodes"), (F.sum("triangles") / 3).cast("bigint").alias("triangles"), F.avg("local").alias("mean_local"), ratio(F.sum("triangles"), F.sum(k * (k - 1) / 2)).alias("transitivity"))


def dyads(e: DataFrame) -> DataFrame:
    """Numbers of mutual and asymmetric pairs, and the share of edges that are returned."""
    p = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count_distinct("src").alias("ways"))
    agg = p.agg(F.sum((F.col("ways") == 2).cast("bigint")).alias("mutual"), F.sum((F.col("ways") == 1).cast("bigint")).alias("asymmetric"))
    return agg.withColumn("reciprocity", ratio(2 * F.col("mutual"), 2 * F.col("mutual") + F.col("asymmetric")))


def assortativity(pairs: DataFrame) -> DataFrame:
    """Pearson's r of the degrees at both ends, over both directions of each pair."""
    d = degrees(pairs)
    ends = both_ways(pairs).join(d.withColumnRenamed("degree", "x"), "v").join(d.select(F.col("v").alias("u"), F.col("degree").alias("y")), "u")
    return ends.agg(F.count("*").alias("ends"), F.corr("x", "y").alias("r"))


def attribute_assortativity(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Newman's r of a label (v, label), over both directions: (sum e_ii - sum a_i b_i) / (1 - sum a_i b_i)."""
    ends = both_ways(pairs).join(labels.withColumnRenamed("label", "x"), "v").join(labels.select(F.col("v").alias("u"), F.col("label").alias("y")), "u")
    mix = ends.groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    share = mix.withColumn("e", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
    rows = share.groupBy("x").agg(F.sum("e").alias("a"), F.sum(F.when(F.col("x") == F.col("y"), F.col("e")).otherwise(0.0)).alias("own"))
    return rows.agg(F.sum("own").alias("t"), F.sum(F.col("a") ** 2).alias("ab")).select(F.when(F.col("ab") < 1, (F.col("t") - F.col("ab")) / (1 - F.col("ab"))).alias("r"))


def edge_overlap(layered: DataFrame, layer: str) -> DataFrame:
    """Over pairs (a, b) of all layers: number of pairs, and the mean share of the layers in which a pair is linked."""
    per = layered.groupBy("a", "b").agg(F.count_distinct(layer).alias("k"))
    m = layered.agg(F.count_distinct(layer).alias("m"))
    return per.agg(F.count("*").alias("pairs"), F.sum("k").alias("k")).crossJoin(m).select("pairs", (F.col("k") / (F.col("m") * F.col("pairs"))).alias("overlap"))  # one row each


def layer_jaccard(layered: DataFrame, layer: str) -> DataFrame:
    """Jaccard index of the pairs of every two layers."""
    sizes = layered.groupBy(layer).agg(F.count("*").alias("n"))
    other = layered.select("a", "b", F.col(layer).alias("other"))
    common = layered.join(other, ["a", "b"]).filter(F.col(layer) < F.col("other")).groupBy(layer, "other").agg(F.count("*").alias("common"))
    x = common.join(sizes, layer).join(sizes.select(F.col(layer).alias("other"), F.col("n").alias("m")), "other")
    return x.select(layer, "other", "common", (F.col("common") / (F.col("n") + F.col("m") - F.col("common"))).alias("jaccard"))


def participation(layered: DataFrame, layer: str) -> DataFrame:
    """Per node: overlapping degree and m / (m - 1) * (1 - sum of squared shares of the m layers). Degrees are stored, as they are read twice."""
    d = stored(degrees(layered.select("a", "b", layer), [layer]), "layer-degrees")
    m = d.agg(F.count_distinct(layer).alias("m"))
    per = d.groupBy("v").agg(F.sum("degree").alias("degree"), F.sum(F.col("degree").cast("double") ** 2).alias("sq"))
    return per.crossJoin(m).select("v", "degree", (F.col("m") / (F.col("m") - 1) * (1 - F.col("sq") / (F.col("degree").cast("double") ** 2))).alias("participation"))  # m is one row


def first_contacts(df: DataFrame, source: str, target: str, time: str) -> DataFrame:
    """C1: the first time that each pair met, both ways."""
    rows = df.filter(F.col(source) != F.col(target)).groupBy(F.least(source, target).alias("a"), F.greatest(source, target).alias("b")).agg(F.min(time).alias("t"))
    return rows.select(F.col("a").alias("v"), F.col("b").alias("u"), "t").unionByName(rows.select(F.col("b").alias("v"), F.col("a").alias("u"), "t"))


def second_contacts(contacts: DataFrame, nodes: DataFrame) -> DataFrame:
    """C2 from each of the given nodes (v): the earliest time at which it had met someone who had met u: the least over
    the one between of the later of both meetings."""
    start = contacts.join(nodes.select("v"), "v", "left_semi").select("v", F.col("u").alias("x"), F.col("t").alias("t1"))
    onward = contacts.select(F.col("v").alias("x"), "u", F.col("t").alias("t2"))
    return start.join(onward, "x").filter("u <> v").groupBy("v", "u").agg(F.min(F.greatest("t1", "t2")).alias("t"))


def _least_times(low: tuple[np.ndarray, np.ndarray, np.ndarray], high: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> list[tuple[np.ndarray, ...]]:
    """Meetings (node, one between, time) of two sides without a common node, or of one side with itself. For each node of a side:
    to how many nodes of the other side it has a way over one between, and the least and the largest of the times of its ways
    (NONE where no time is known). NONE as a time is an unknown one.

    Some nodes of the low side at a time have a table of the least times to all those whom they reach; each one between makes a
    block of it. Where that table would be mostly empty, ways are sorted. On one side a pair of nodes is looked at once."""
    same, high = high is None, low if high is None else high
    names, who = np.unique(high[0], return_inverse=True)
    order = np.lexsort((who, high[1]))
    who, via = who[order], high[1][order]
    met, first = np.unique(via, return_index=True)
    size = np.diff(np.append(first, len(via)))
    place = np.minimum(np.searchsorted(met, low[1]), len(met) - 1)
    nodes, row = np.unique(low[0], return_inverse=True)
    order = np.argsort(row, kind="stable")
    order = order[met[place[order]] == low[1][order]]
    row, place = row[order], place[order]
    known = np.unique(np.concatenate([low[2], high[2]]))
    known = known[known != NONE]
    late, never = len(known) + 1, len(known) + 2
    kind = np.uint16 if never < 1 << 16 else np.uint32
    time, when = (np.where(t == NONE, 0, np.searchsorted(known, t) + 1).astype(kind) for t in (low[2][order], high[2][np.lexsort((high[0], high[1]))]))
    starts = np.searchsorted(row, np.arange(len(nodes) + 1))
    upto = np.append(0, np.cumsum(size[place]))[starts]
    mine = np.zeros(len(nodes), np.int64), np.full(len(nodes), never, kind), np.zeros(len(nodes), kind)
    theirs = mine if same else (np.zeros(len(names), np.int64), np.full(len(names), never, kind), np.zeros(len(names), kind))

    def spread(of: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each of `of` n times, beside the places begin, begin + 1, ..."""
        return np.repeat(of, n), np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())

    def part(i: int, j: int) -> None:
        mark = slice(starts[i], starts[j])
        if mark.start == mark.stop:
            return
        some, group = np.unique(place[mark], return_inverse=True)
        block, at = spread(np.arange(len(some)), first[some], size[some])
        if same:
            up = who[at] >= i
            block, at = block[up], at[up]
        col, w, n = who[at], when[at], np.bincount(block, minlength=len(some))
        reached = np.zeros(len(names), bool)
        reached[col] = True
        cols, col = np.flatnonzero(reached), (np.cumsum(reached) - 1)[col]
        cells, work = (j - i) * len(cols), upto[j] - upto[i]
        sparse = cells > 8 * work
        if j - i > 1 and (work > WAYS if sparse else cells > CELLS):
            middle = min(max(np.searchsorted(upto, (upto[i] + upto[j]) // 2), i + 1), j - 1)
            part(i, middle)
            part(middle, j)
            return
        order = np.argsort(group, kind="stable")
        r, t, group, begin = row[mark][order] - i, time[mark][order], group[order], np.cumsum(n) - n
        ends = np.searchsorted(group, np.arange(len(some) + 1))
        wide = np.zeros(len(some), bool) if sparse else np.diff(ends) * n > 64
        flock = ~wide[group]
        which, at = spread(np.flatnonzero(flock), begin[group[flock]], n[group[flock]])
        cell, later = r[which] * len(cols) + col[at], np.maximum(t[which], w[at])
        later[later == 0] = late
        own = np.flatnonzero(reached[i:j]) if same else np.empty(0, np.int64)
        own = own * len(cols) + (np.cumsum(reached) - 1)[i + own] if same else own
        if sparse:
            order = np.lexsort((later, cell))
            cell, later = cell[order], later[order]
            least = np.append(True, cell[1:] != cell[:-1]) & ~np.isin(cell, own)
            cell, later = cell[least], later[least]
            r, c = np.divmod(cell, len(cols))
            for (count, lo, hi), k, keep in ((mine, r + i, slice(None)), (theirs, cols[c], cols[c] >= j if same else slice(None))):
                k, some = k[keep], later[keep]
                np.add.at(count, k, 1)
                np.minimum.at(lo, k, some)
                np.maximum.at(hi, k, np.where(some < late, some, 0).astype(kind))
            return
        best = np.full(cells, never, kind)
        np.minimum.at(best, cell, later)
        for g in np.flatnonzero(wide):
            x, y = slice(ends[g], ends[g + 1]), slice(begin[g], begin[g] + n[g])
            later = np.maximum(t[x][:, None], w[y])
            if not t[x].all() and not w[y].all():
                later[later == 0] = late
            np.minimum.at(best, ((r[x] * len(cols))[:, None] + col[y]).ravel(), later.ravel())
        best[own] = never
        best = best.reshape(j - i, len(cols))
        sums = [((best < never).sum(axis, dtype=np.uint32), best.min(axis)) for axis in (1, 0)]
        best[best >= late] = 0
        other = np.flatnonzero(cols >= j) if same else np.arange(len(cols))
        for (count, lo, hi), (n, least), most, to, of in ((mine, sums[0], best.max(1), np.arange(i, j), slice(None)), (theirs, sums[1], best.max(0), cols[other], other)):
            count[to] += n[of]
            lo[to] = np.minimum(lo[to], least[of])
            hi[to] = np.maximum(hi[to], most[of])

    i = 0
    while i < len(nodes):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + 64 * WAYS, "right")) - 1)
        part(i, j)
        i = j
    time_of = np.concatenate([[NONE], known, [NONE, NONE]])
    return [(of, count, time_of[lo], time_of[hi]) for of, (count, lo, hi) in (((nodes, mine),) if same else ((nodes, mine), (names, theirs)))]


def _late_times(low: tuple[np.ndarray, np.ndarray, np.ndarray], high: tuple[np.ndarray, np.ndarray, np.ndarray], same: bool) -> tuple[np.ndarray, ...] | None:
    """What `_least_times` finds for the nodes of low, for which few ways are looked at one by one: whom a node reaches at all, and
    whom up to a late time, are bits that are put together over those between. The largest of its times is that of a
    node that isn't reached up to then, and only the ways after it can tell. None where a time is unknown, where bits would be
    mostly empty, or where many nodes reach all of theirs early: then tables do it."""
    if (low[2] == NONE).any() or (high[2] == NONE).any():
        return None
    names, who = np.unique(high[0], return_inverse=True)
    order = np.lexsort((high[2], high[1]))
    who, via, when = who[order], high[1][order], high[2][order]
    met, first, via, size = np.unique(via, return_index=True, return_inverse=True, return_counts=True)
    words = -(-len(names) // 64)
    if len(via) * 256 < len(met) * len(names) or len(met) * words > CELLS:
        return None
    nodes, row = np.unique(low[0], return_inverse=True)
    place = np.minimum(np.searchsorted(met, low[1]), len(met) - 1)
    order = np.argsort(row, kind="stable")
    order = order[(met[place] == low[1])[order]]
    row, place, time = row[order], place[order], low[2][order]
    starts = np.searchsorted(row, np.arange(len(nodes) + 1))
    none = np.iinfo(np.int64).max
    other = when[first][place]  # the first time of another node with the one between
    if same:
        second = np.where(size > 1, when[np.minimum(first + 1, len(when) - 1)], none)
        other = np.where(who[first][place] == row, second[place], other)
    least, last, count = np.full(len(nodes), none), np.full(len(nodes), NONE), np.zeros(len(nodes), np.int64)
    np.minimum.at(least, row, np.maximum(time, other))

    def bits(kept: np.ndarray) -> np.ndarray:
        out = np.empty((len(met), words), np.uint64)
        for k in range(0, len(met), 256):
            some = slice(first[k], first[k + 256] if k + 256 < len(met) else len(via))
            dense = np.zeros((min(256, len(met) - k), words * 64), bool)
            dense[via[some] - k, who[some]] = kept[some]
            out[k : k + 256] = np.packbits(dense, axis=1, bitorder="little").view(np.uint64)
        return out

    def put_together(table: np.ndarray, some: np.ndarray, early: np.ndarray) -> np.ndarray:
        out = np.zeros((len(some), words), np.uint64)
        for k, i in enumerate(some.tolist()):
            at = slice(starts[i], starts[i + 1])
            np.bitwise_or.reduce(table[place[at][early[at]]], axis=0, out=out[k])
        return out

    def spread(of: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(of, n), np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())

    whole, always = bits(np.ones(len(via), bool)), np.ones(len(row), bool)
    for k in range(0, len(nodes), 1024):
        some = np.arange(k, min(k + 1024, len(nodes)))
        count[some] = np.bitwise_count(put_together(whole, some, always)).sum(1)
    if same:
        count -= starts[1:] > starts[:-1]
    left = np.flatnonzero(count)
    for share in (256, 16, 1):
        if share == 1 and len(left) * EARLY > len(nodes):
            return None
        late_from = min(when.min(), time.min(initial=none)) - 1 if share == 1 else np.partition(when, -(-len(when) // share) * -1)[-(-len(when) // share) * -1]
        upto, early = bits(when <= late_from), time <= late_from
        late_n = np.bincount(via, when > late_from, len(met)).astype(np.int64)  # times of one between are sorted, late ones come last
        n = np.where(early, late_n[place], size[place])
        begin = first[place] + size[place] - n
        ways, k, found = np.append(0, np.cumsum(np.add.reduceat(np.append(n, 0), starts[:-1]) * (starts[1:] > starts[:-1])))[np.append(left, len(nodes))], 0, []
        while k < len(left):
            e = k + 1
            while e < len(left) and e - k < 1024 and ways[e] - ways[k] < WAYS:
                e += 1
            some = left[k:e]
            reached = put_together(upto, some, early).view(np.uint8)
            mark, at = spread(np.arange(len(some)), starts[some], starts[some + 1] - starts[some])
            which, way = spread(np.arange(len(at)), begin[at], n[at])
            r, u, later = mark[which], who[way], np.maximum(time[at][which], when[way])
            new = (reached[r, u >> 3] >> (u & 7).astype(np.uint8)) & 1 == 0
            if same:
                new &= u != some[r]
            r, u, later = r[new], u[new], later[new]
            order = np.lexsort((later, u, r))
            r, u, later = r[order], u[order], later[order]
            one = np.append(True, (r[1:] != r[:-1]) | (u[1:] != u[:-1]))[: len(r)]
            np.maximum.at(last, some[r[one]], later[one])
            found.append(some[np.bincount(r, minlength=len(some)) == 0])
            k = e
        left = np.concatenate(found) if found else left
        if not len(left):
            break
    return nodes, count, np.where(count > 0, least, NONE), last


def second_contact_times(meetings: DataFrame, rows: int = RANGE_CONTACTS) -> DataFrame:
    """Of meetings (v, x, t: whole numbers, each pair once) between nodes v and those between, for each v: n other nodes that had met
    one whom v met, and the first and the last of their times; a node's time is the least over the ones between of the later of both
    meetings. The same as what `second_contacts` gives, counted by v, without a row for each two nodes.

    Nodes are cut into ranges with about `rows` meetings, and fewer where there would be fewer tasks than cores. Two ranges meet in one
    task, with the meetings of those between whom both know; there some nodes of one are taken at a time, with the least times to all
    nodes of the other. So a task holds two ranges, however many met the same one; the work is one step for each two meetings with the
    same one, as the least time needs them all."""
    m = stored(meetings.select("v", "x", "t"), "meetings")
    n, cores = m.count(), m.sparkSession.sparkContext.defaultParallelism
    parts = max(math.ceil(n / rows), min(math.ceil(math.sqrt(6 * cores)), n // LEAST_CONTACTS), 1)
    own = ranged(m, "v", parts).withColumn("p", F.col(PART).cast("int")).drop(PART)
    where = own.select("x", F.col("p").alias("q")).distinct()
    sent = own.join(where, "x").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), (F.col("p") > F.col("q")).alias("upper"), F.col("v").cast("long").alias("v"), F.col("x").cast("long").alias("x"), F.coalesce("t", F.lit(NONE)).cast("long").alias("t"))
    sent = sent.repartition(min(parts * (parts + 1) // 2, 1000), "a", "b")

    def met(table: pa.Table) -> pa.Table:
        upper = table.column("upper").to_numpy()
        v, x, t = (table.column(c).to_numpy() for c in "vxt")
        same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        low, high = ((v[side], x[side], t[side]) for side in (~upper, upper))
        found = [_late_times(low, low, True)] if same else [_late_times(low, high, False), _late_times(high, low, False)]
        if any(f is None for f in found):
            found = _least_times(low) if same else _least_times(low, high)
        return pa.table({name: np.concatenate([f[i] for f in found]) for i, name in enumerate(("v", "n", "first", "last"))})

    each = sent.groupBy("a", "b").applyInArrow(met, "v long, n long, first long, last long").filter("n > 0")
    known = lambda c: F.when(F.col(c) != NONE, F.col(c))
    return each.groupBy("v").agg(F.sum("n").alias("n"), F.min(known("first")).alias("first"), F.max(known("last")).alias("last"))


def pagerank(e: DataFrame, iterations: int = 20, alpha: float = 0.85) -> DataFrame:
    """(v, rank) after a fixed number of weighted steps; the rank of nodes without outgoing edges is dealt out evenly.
    Tables are stored every few steps, so that lost executors don't undo them."""
    e = stored(e.groupBy("src", "dst").agg(F.sum("w").alias("w")), "pr-edges")
    nodes = stored(e.select(F.col("src").alias("v")).union(e.select("dst")).distinct(), "pr-nodes")
    n = nodes.count()
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    step = stored(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")), "pr-steps")
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for i in range(iterations):
        into = step.join(ranks.withColumnRenamed("v", "src"), "src").groupBy(F.col("dst").alias("v")).agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        flow = into.agg(F.sum("got")).first()[0] or 0.0  # what isn't passed on was at nodes without edges
        got = nodes.join(into, "v", "left")
        ranks = got.select("v", ((1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + F.lit((1.0 - flow) / n))).alias("rank"))
        ranks = stored(ranks, "pr-ranks")
    return ranks


def core_numbers(pairs: DataFrame) -> DataFrame:
    """(v, core), by repeated h-indices: a node's value becomes the largest h such that h of its neighbours have h or
    more, from its degree down until nothing changes. A pair has the lesser of its ends' values for both; these are counted by node and
    value before they are ranked, so that a hub needs no list of neighbours. Joins are shuffled, as a table of all nodes that is sent
    around goes through the driver each round; a task keeps its part of the nodes, so that pairs aren't sorted.

    After a round, let k be the least value that a node has come down to in it. Values cut at k don't change in any later round: whoever came
    down has k neighbours of k or more, and the others have as many as their values ask. So nodes of k or less have their core
    numbers, the others have k at least, and go on among themselves. Pairs are reduced to theirs whenever a quarter of the nodes
    is settled."""
    pairs = stored(pairs.select("a", "b"), "core-edges")
    left, floor, settled, known, fewer = stored(degrees(pairs).withColumnRenamed("degree", "core"), "core-values"), 0, [], None, False
    down = Window.partitionBy("v").orderBy(F.desc("seen")).rowsBetween(Window.unboundedPreceding, 0)
    while True:
        value = lambda c: left.select(F.col("v").alias(c), F.col("core").alias(f"core_{c}")).hint("shuffle_hash")  # noqa: B023, E731
        met = pairs.join(value("a"), "a").join(value("b"), "b").select("a", "b", F.least("core_a", "core_b").alias("seen"))
        if fewer:
            met = stored(met, "core-edges")
            pairs = met.select("a", "b")
        counts = met.select(F.explode(F.array("a", "b")).alias("v"), "seen").groupBy("v", "seen").agg(F.count("*").alias("n"))
        h = counts.withColumn("upto", F.sum("n").over(down)).groupBy("v").agg(F.max(F.least("upto", "seen")).alias("h"))
        found = left.join(h.hint("shuffle_hash"), "v", "left").select("v", F.col("core").alias("was"), F.greatest(F.lit(floor), F.coalesce("h", F.lit(0))).alias("core"))
        moved = stored(found, "core-values")
        least = moved.filter("core <> was").agg(F.min("core")).first()[0]
        settled.append(moved.select("v", "core") if least is None else moved.filter(F.col("core") <= least).select("v", "core"))
        if least is None:
            return functools.reduce(DataFrame.unionByName, settled)
        if len(settled) == 16:
            settled = [stored(functools.reduce(DataFrame.unionByName, settled), "core-settled")]
        floor, left = least, moved.filter(F.col("core") > least).select("v", "core")
        known, some = known or moved.count(), left.count()
        fewer = some <= 0.75 * known
        known = some if fewer else known


def components(pairs: DataFrame) -> DataFrame:
    """(v, component) with the smallest node of each component, by contraction: each node points to its smallest neighbour (or to
    itself), pointers are followed to where they end, and pairs are renamed by these ends. What is left are the distinct pairs
    between different ends, over at most half of the nodes of two rounds before and often far fewer, so that all rounds together
    read little more than the first. Names of nodes are then carried from round to round. Joins are shuffled, as no table of
    nodes is small."""
    left, rounds = stored(pairs.filter("a <> b"), "components-edges"), []
    alone = pairs.filter("a = b").select(F.col("a").alias("v")).distinct()
    while not left.isEmpty():
        names = stored(both_ways(left).groupBy("v").agg(F.least("v", F.min("u")).alias("to")), "components-names")
        while True:  # smaller with each step, so that pointers make no rings; the reach doubles
            ends = names.select(F.col("v").alias("to"), F.col("to").alias("end")).hint("merge")
            further = stored(names.join(ends, "to").select("v", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")), "components-names")
            names = further.select("v", "to")
            if further.filter("moved").isEmpty():
                break
        rounds.append(names)
        other = lambda c: names.select(F.col("v").alias(c), F.col("to").alias(f"__{c}")).hint("merge")  # noqa: B023, E731
        left = left.join(other("a"), "a").join(other("b"), "b").filter("__a <> __b")
        left = stored(left.select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b")).distinct(), "components-edges")
    if not rounds:
        return alone.select("v", F.col("v").alias("component"))
    known = rounds.pop().withColumnRenamed("to", "component")
    while rounds:
        below = known.withColumnRenamed("v", "to").hint("merge")
        known = stored(rounds.pop().join(below, "to", "left").select("v", F.coalesce("component", "to").alias("component")), "components-labels")
    alone = alone.join(known.select("v").hint("merge"), "v", "left_anti")
    return known.union(alone.select("v", F.col("v").alias("component")))


def modularity(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """Newman's Q of a partition (v, community) of an undirected graph."""
    m = membership
    ends = both_ways(pairs).join(m.withColumnRenamed("community", "cv"), "v").join(m.select(F.col("v").alias("u"), F.col("community").alias("cu")), "u")
    per = ends.groupBy("cv").agg(F.count("*").cast("double").alias("d"), F.sum((F.col("cv") == F.col("cu")).cast("double")).alias("own"))
    total = F.sum("d").over(Window.partitionBy(F.lit(0)))
    return per.withColumn("q", F.col("own") / total - (F.col("d") / total) ** 2).agg(F.sum("q").alias("q"))


def undirected_motifs(e: DataFrame) -> DataFrame:
    """Closed and open triples of the undirected skeleton: triangles, wedges without the third side."""
    p = stored(undirected(e), "pairs")
    d = degrees(p)
    wedges = d.agg(F.sum(F.col("degree") * (F.col("degree") - 1) / 2).cast("bigint").alias("wedges"))
    t = triangles(p).agg(F.count("*").alias("triangles"))
    return wedges.crossJoin(t).select("triangles", (F.col("wedges") - 3 * F.col("triangles")).alias("open_wedges"))  # one row each


#: Kinds of two dyads at one node, by the ways that it sees: 1 out, 2 in, 3 mutual.
WEDGES = {"021D": (1, 1), "021U": (2, 2), "021C": (1, 2), "111D": (2, 3), "111U": (1, 3), "201": (3, 3)}
#: Classes of triangles by mutual dyads and, at each node, how many one-way dyads leave it (sorted).
CLOSED = {(0, (0, 1, 2)): "030T", (0, (1, 1, 1)): "030C", (2, (0, 0, 1)): "210", (3, (0, 0, 0)): "300"}


def _corners(xy: int, xz: int, yz: int) -> tuple[tuple[int, int], ...]:
    """The ways of both dyads as each node of a triangle sees them."""
    back = {1: 2, 2: 1, 3: 3}
    return (xy, xz), (back[xy], yz), (back[xz], back[yz])


def triad_class(xy: int, xz: int, yz: int) -> str:
    """Class of a triangle by the ways of its dyads. With one mutual dyad, the node that isn't on it decides."""
    corners = _corners(xy, xz, yz)
    mutual = (xy, xz, yz).count(3)
    if mutual == 1:
        apart = next(c for c in corners if 3 not in c)
        return {(1, 1): "120D", (2, 2): "120U"}.get(apart, "120C")
    return CLOSED[mutual, tuple(sorted(c.count(1) for c in corners))]


def triad_census(e: DataFrame) -> DataFrame:
    """(triad, n): the triples of nodes in each of the 16 classes of directed graphs on three nodes (Holland and Leinhardt), among all
    nodes of edges (src, dst); self-loops and repeated edges don't count. n is a decimal, as triples go beyond 64 bits.

    Only triangles are enumerated, and counted by the ways of their dyads (27 kinds). Triples with two dyads are the wedges of each node by
    its numbers of mutual dyads, and those out and in, without the corners of triangles. A pair with a third node that is linked with
    neither: all nodes without the neighbours of both, to which those come back that both have; and 003 is what is left of all triples."""
    p = stored(dyad_ways(e), "dyads")
    seen = p.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("way").alias("way")), F.struct(F.col("b").alias("v"), turned("way").alias("way")))).alias("s")).select("s.*")
    nodes = seen.groupBy("v").agg(*(F.count(F.when(F.col("way") == w, 1)).alias(f"k{w}") for w in (1, 2, 3)))
    k, k1, k2, k3 = F.col("k1") + F.col("k2") + F.col("k3"), F.col("k1"), F.col("k2"), F.col("k3")
    two = lambda w, u: F.expr(f"k{w} * (k{w} - 1) div 2") if w == u else F.col(f"k{w}") * F.col(f"k{u}")
    exact = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(38,0)")
    sums = {**{f"w{name}": two(w, u) for name, (w, u) in WEDGES.items()}, "one_way": k1, "mutual": k3, "one_way_k": k * (k1 + k2), "mutual_k": k * k3}
    whole = nodes.agg(F.count("*").alias("nodes"), *(exact(F.sum(c.cast("decimal(19,0)"))).alias(name) for name, c in sums.items()))
    met = triangles(p).groupBy("xy", "xz", "yz").agg(F.count("*").alias("n"))
    kinds = [(x, y, z) for x in (1, 2, 3) for y in (1, 2, 3) for z in (1, 2, 3)]

    def times(count: Callable[[tuple[int, int, int]], int]) -> Column:
        """The triangles of each kind, so often."""
        some = [F.lit(x) for t in kinds for x in (t[0] * 16 + t[1] * 4 + t[2], count(t))]
        return exact(F.sum(F.col("n") * F.create_map(*some)[F.col("xy") * 16 + F.col("xz") * 4 + F.col("yz")]))

    names = sorted({triad_class(*t) for t in kinds})
    closed = met.agg(
        *(times(lambda t: int(triad_class(*t) == name)).alias(f"t{name}") for name in names),  # noqa: B023
        *(times(lambda t: sum(tuple(sorted(c)) == ways for c in _corners(*t))).alias(f"c{name}") for name, ways in WEDGES.items()),  # noqa: B023
        times(lambda t: 3 - t.count(3)).alias("one_way_t"), times(lambda t: t.count(3)).alias("mutual_t"),
    )
    one = whole.crossJoin(closed)  # one row each
    rows = {name: F.col(f"t{name}") for name in names} | {name: F.col(f"w{name}") - F.col(f"c{name}") for name in WEDGES}
    third = lambda c, pairs: F.col("nodes").cast("decimal(18,0)") * pairs.cast("decimal(18,0)") - F.col(f"{c}_k") + F.col(f"{c}_t")
    rows |= {"012": third("one_way", F.col("one_way")), "102": third("mutual", F.expr("CAST(mutual AS bigint) div 2"))}
    some = one.select("nodes", *(c.cast("decimal(38,0)").alias(f"n{name}") for name, c in rows.items()))
    # n (n - 1) (n - 2) / 6 in whole numbers: either n - 2 or the pairs are a multiple of 3
    pairs, others = F.expr("nodes * (nodes - 1) div 2"), F.expr("greatest(nodes - 2, 0)")
    all_three = F.when(F.col("nodes") % 3 == 2, pairs.cast("decimal(19,0)") * F.expr("greatest(nodes - 2, 0) div 3").cast("decimal(18,0)"))
    all_three = all_three.otherwise((F.expr("nodes * (nodes - 1) div 2 div 3")).cast("decimal(19,0)") * others.cast("decimal(18,0)")).cast("decimal(38,0)")
    some = some.withColumn("n003", (all_three - sum((F.col(f"n{name}") for name in rows), F.lit(0).cast("decimal(38,0)"))).cast("decimal(38,0)"))
    return some.select(F.explode(F.array(*(F.struct(F.lit(name).alias("triad"), F.col(f"n{name}").alias("n")) for name in ("003", *rows)))).alias("t")).select("t.*")
