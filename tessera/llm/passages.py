"""Repeated passages by hashing lines and paragraphs of a text; the earliest occurrence stays.

Lines are units. As many repeated passages begin in the middle of a line, where no line is equal, a text is also cut
into short paragraphs at places that only the words around them decide: before a pair of words whose hash is the least
among its neighbours. So a passage is cut alike wherever it stands. Units are normalised (A-Z lower case, white space
one space), their digests are grouped over all texts, and adjacent repeated units become one removed span. A first pass
counts 64-bit keys alone; a second one takes out of the texts only the units whose keys occur again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Marked, settled, stored
from tessera.llm.textblocks import LOWER, SPACE, blocks, digests, mix, runs, words

#: Words on either side that decide a cut; paragraphs of more than LONGEST words are cut again.
REACH, LONGEST = 4, 24
UNITS = "doc_id long, text_id long, line boolean, w0 int, w1 int, start int, end int, hi long, lo long, inner int"


def _sequence_digest(h: np.ndarray, first: np.ndarray, after: np.ndarray, seed: int) -> np.ndarray:
    """A digest of h[first:after] in order, for each pair."""
    x = mix(h, seed)
    n = len(x)
    base, inverse = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
    up, down = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    up[1:], down[1:] = base, inverse
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(x * up[:n], out=total[1:])
    return mix((total[after] - total[first]) * down[first] + (after - first).astype(np.uint64), seed)


def _cuts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a paragraph begins at each word; `first` are the places of each row's first word, and the number of words."""
    n, rows = len(h), len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    pair = np.empty(n, np.uint64)
    pair[:-1] = mix(h[:-1] * np.uint64(3) + mix(h[1:]))
    ends = first[1:][np.diff(first) > 0] - 1
    pair[ends] = np.uint64(0xFFFFFFFFFFFFFFFF)
    at = np.arange(n) + REACH * (row + 1)
    padded = np.full(n + REACH * (rows + 2), 0xFFFFFFFFFFFFFFFF, np.uint64)
    padded[at] = pair
    least = np.ones(n, bool)
    for k in range(1, REACH + 1):
        least &= (pair < padded[at - k]) & (pair <= padded[at + k])
    least[first[:-1][np.diff(first) > 0]] = True
    # equal pairs have no least one (runs of a few words): a long paragraph is cut again at even distances from its start
    at = np.flatnonzero(least)
    long = np.diff(np.append(at, n)) > LONGEST
    for a, b in zip(at[long], np.append(at[1:], n)[long]):
        least[a : b - LONGEST // 2 : LONGEST // 2] = True
    return least


def _units(data: np.ndarray, offsets: np.ndarray, least_words: int):
    """Places of all words and units of the texts of a block, and the two digests of each unit."""
    start, end, first = words(data, offsets)
    h = digests(LOWER[data], start, end)
    cut = np.flatnonzero(_cuts(h, first))
    l0, l1 = runs(data != 10, offsets)
    lw0, lw1 = np.searchsorted(start, l0), np.searchsorted(start, l1)
    keep = lw1 - lw0 >= least_words
    w0, w1 = np.concatenate([cut, lw0[keep]]), np.concatenate([cut[1:], [len(h)], lw1[keep]])
    line = np.arange(len(w0)) >= len(cut)
    return start, end, first, w0, w1, line, _sequence_digest(h, w0, w1, 1) + line, _sequence_digest(h, w0, w1, 2)


def repeated_units(df: DataFrame, least_words: int) -> DataFrame:
    """The 64-bit keys of units that occur twice or more: all that is shuffled of most units."""

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                if SPACE[data].all():
                    continue
                key, n = np.unique(_units(data, offsets, least_words)[6], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    counted = df.filter(F.col("doc_id").isNotNull()).select("text").mapInArrow(run, "key long, n long")
    return counted.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")


def units(df: DataFrame, least_words: int, wanted: Marked) -> DataFrame:
    """The wanted units of all texts: places in words and characters, and a digest of 128 bits. `inner` is the character
    at which the same unit first stands in the same text, if that is earlier. Lines of fewer words are no units."""

    def run(batches):
        for batch in batches:
            ids, texts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for lo, hi, data, offsets in blocks(batch.column(1)):
                if SPACE[data].all():
                    continue
                start, end, first, w0, w1, line, upper, lower = _units(data, offsets, least_words)
                use = wanted.holds(upper.view(np.int64))
                w0, w1, line, upper, lower = w0[use], w1[use], line[use], upper[use], lower[use]
                if not len(w0):
                    continue
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                chars = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
                r = row[w0]
                c0, c1, base = chars[start[w0]], chars[end[w1 - 1]], chars[offsets[:-1]][r]
                order = np.lexsort((w0, upper, line, r))
                same = np.zeros(len(w0), bool)
                a, b = order[1:], order[:-1]
                same[1:] = (r[a] == r[b]) & (line[a] == line[b]) & (upper[a] == upper[b])
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(w0))))
                inner = np.full(len(w0), -1, np.int64)
                inner[order] = np.where(same, (c0 - base)[order[head]], -1)
                who = ids[lo:hi][r]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(who, pa.int64(), from_pandas=True),
                        pa.array(texts[lo:hi][r]),
                        pa.array(line),
                        pa.array(w0 - first[r], pa.int32()),
                        pa.array(w1 - first[r], pa.int32()),
                        pa.array(c0 - base, pa.int32()),
                        pa.array(c1 - base, pa.int32()),
                        pa.array(upper.view(np.int64)),
                        pa.array(lower.view(np.int64)),
                        pa.array(inner, pa.int32(), mask=inner < 0),
                    ],
                    names=[x.split()[0] for x in UNITS.split(", ")],
                )

    return df.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_id")).filter(F.col("doc_id").isNotNull()).mapInArrow(run, UNITS)


def repeated_spans(df: DataFrame, least_words: int = 16, least_line_words: int = 8) -> DataFrame:
    """One row per span to remove: doc_id, text_id (a hash of the text), start, end (characters of the original text), n_words, and the occurrence
    that stays (first_doc_id, first_start) of the span's first unit.

    Occurrences are ranked by doc_id, text and place. A span is a run of adjacent repeated units; it counts if it has
    least_words words or more, or holds a repeated line of least_line_words or more. A passage is found whole but for
    the paragraphs at its edges, which reach about ten words in; passages of 50 words always have inner paragraphs
    but for freak hashes. Rows without doc_id or text have no units; rows that share a doc_id are told apart by
    their texts, and rows equal in both are one. Empty tables give no rows, other columns aren't looked at.
    """
    return settled(df.sparkSession, "passage-spans", lambda: _repeated_spans(df, least_words, least_line_words))


def _repeated_spans(df: DataFrame, least_words: int, least_line_words: int) -> DataFrame:
    keys = stored(repeated_units(df, least_line_words), "passage-keys")
    u = stored(units(df, least_line_words, Marked(keys, "key")), "passage-units")
    groups = u.filter(F.col("inner").isNull()).groupBy("hi", "lo", "line").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_id", "start")).alias("first"))
    groups = stored(groups.filter("copies > 1").drop("copies"), "passage-groups")
    met = u.join(groups, ["hi", "lo", "line"], "left")
    own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_id") == F.col("first.text_id"))
    elsewhere = F.coalesce(~own, F.lit(False))  # its first occurrence is in another text; otherwise it stays, and again in its text it goes
    rows = met.filter(elsewhere | F.col("inner").isNotNull()).select(
        "doc_id", "text_id", "line", "w0", "w1", "start", "end",
        F.when(elsewhere, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("first_doc_id"), F.when(elsewhere, F.col("first.start")).otherwise(F.col("inner")).alias("first_start"),
    )
    order = Window.partitionBy("doc_id", "text_id").orderBy("w0", F.col("w1").desc(), F.col("line").desc(), "first_doc_id", "first_start")
    reached = F.max("w1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = rows.withColumn("new", F.when(F.col("w0") <= reached, 0).otherwise(1))
    islands = islands.withColumns({"island": F.sum("new").over(order), "n": F.row_number().over(order)})
    spans = islands.groupBy("doc_id", "text_id", "island").agg(
        F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), (F.max("w1") - F.min("w0")).cast("long").alias("n_words"),
        F.min_by("first_doc_id", "n").alias("first_doc_id"), F.min_by("first_start", "n").cast("long").alias("first_start"), F.max("line").alias("has_line"),
    )
    return spans.filter((F.col("n_words") >= least_words) | F.col("has_line")).drop("island", "has_line")


def without_spans(df: DataFrame, spans: DataFrame) -> DataFrame:
    """df with the spans cut out of its texts; texts without spans, null texts and rows without doc_id stay as they are. A span
    is cut out of the text it was found in, in every row that has this doc_id and text. Columns of df stay, whatever their names."""
    lists = spans.groupBy(F.col("doc_id").alias("__doc"), F.col("text_id").alias("__text")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))

    def piece(state, s):
        kept = F.concat(state["out"], F.substring(F.col("text"), (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")))
        return F.struct(kept.alias("out"), s["end"].alias("at"))

    done = F.aggregate("__spans", F.struct(F.lit("").cast("string").alias("out"), F.lit(0).cast("long").alias("at")), piece, lambda s: s["out"])
    last = F.element_at("__spans", -1)["end"].cast("int")
    cut = F.concat(done, F.substring(F.col("text"), last + 1, F.length("text")))
    same = (df["doc_id"] == lists["__doc"]) & (F.xxhash64(df["text"]) == lists["__text"])
    return df.join(lists, same, "left").withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(cut)).select(df.columns)
