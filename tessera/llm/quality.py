"""A regularised quadratic discriminant over document statistics.

Statistics of the whole text, each transformed, go to two Gaussians with shrunk class covariances; the score is the
logistic of the difference of their log densities, from Mahalanobis distances by cached Cholesky factors. Spark adds up
the class moments over every labelled row, so that fitting needs no sample and the driver gets a few hundred numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import sized, stored
from tessera.llm.textblocks import LOWER, blocks, digests, mix, runs, words

NAMES = (
    "bytes", "words", "word_length", "word_spread", "upper", "digits", "symbols", "bangs", "bars", "stops", "breaks", "wide",
    "capitals", "new_words", "new_pairs", "new_lines", "twice", "top_word", "plain", "long_words",
)


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = _class("0123456789")
LETTER = _class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | (np.arange(256) >= 128)
SYMBOL = _class("#$%&*+/<=>@[\\]^_`{}~")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, statistics) of a block of texts; an empty text has zero counts and the shares of nothing (0, or 1 for
    shares of distinct things)."""
    n = np.diff(offsets)
    start, end, first = words(data, offsets)
    count, size = np.diff(first), end - start
    row = np.repeat(np.arange(len(n)), count)

    def per_row(x, bounds):
        total = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
        return total[bounds[1:]] - total[bounds[:-1]]

    def share(x, bounds, of):
        return per_row(x, bounds) / np.maximum(of, 1)

    def distinct(x, r, total):
        order = np.lexsort((x, r))
        x, r = x[order], r[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
        length = np.diff(np.append(np.flatnonzero(new), len(x)))
        most = np.zeros(len(n))
        np.maximum.at(most, r[new], length)
        return np.where(total > 0, np.bincount(r[new], minlength=len(n)) / np.maximum(total, 1), 1.0), most

    h = digests(LOWER[data], start, end)
    letters = np.concatenate([[0], np.cumsum(LETTER[data])])
    only = letters[end] - letters[start] >= size - 1
    new_words, most = distinct(h, row, count)
    inner = np.flatnonzero(row[1:] == row[:-1]) if len(row) > 1 else np.zeros(0, np.int64)
    pairs = mix(h[inner] * np.uint64(3) + mix(h[inner + 1])) if len(inner) else np.zeros(0, np.uint64)
    new_pairs, _ = distinct(pairs, row[inner], np.maximum(count - 1, 0))
    l0, l1 = runs(data != 10, offsets)
    line_row = np.searchsorted(offsets, l0, "right") - 1
    line_count = np.bincount(line_row, minlength=len(n))
    new_lines, _ = distinct(digests(LOWER[data], l0, l1), line_row, line_count)
    again = np.zeros(len(h))
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    mean = share(size, first, count)
    log, root = np.log1p, np.sqrt
    return np.column_stack(
        [
            log(n), log(count), log(mean), root(np.maximum(share(size.astype(float) ** 2, first, count) - mean**2, 0)), root(share(UPPER[data], offsets, n)),
            root(share(DIGIT[data], offsets, n)), root(share(SYMBOL[data], offsets, n)), root(share(data == 33, offsets, n)), root(share(data == 124, offsets, n)),
            root(share((data == 46) | (data == 44), offsets, n)), root(share(data == 10, offsets, n)), root(share(data >= 128, offsets, n)),
            root(share(UPPER[data[start]] if len(start) else np.zeros(0), first, count)), new_words, new_pairs, new_lines, root(share(again, first, count)),
            root(most / np.maximum(count, 1)), share(only, first, count), root(share(size > 20, first, count)),
        ]
    )


def measured(df: DataFrame) -> DataFrame:
    """doc_id and the array x of statistics of every row; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                x = statistics(data, offsets)
                lists = pa.ListArray.from_arrays(np.arange(hi - lo + 1, dtype=np.int32) * x.shape[1], x.reshape(-1).astype(np.float32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["doc_id", "x"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<float>")


@dataclass
class Discriminant:
    """Class means and Cholesky factors of the inverse problem, ready for scoring."""

    mean: np.ndarray
    factor: np.ndarray
    offset: np.ndarray
    scale: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, from the difference of log densities, divided by `scale`."""
        density = []
        for c in (0, 1):
            z = np.linalg.solve(self.factor[c], (x - self.mean[c]).T)
            density.append(self.offset[c] - 0.5 * (z * z).sum(axis=0))
        return 1 / (1 + np.exp(np.clip((density[0] - density[1]) / self.scale, -500, 500)))


def fit(labelled: DataFrame, shrink: float = 0.2, towards_common: float = 0.6, scale: float = 4.0) -> Discriminant:
    """From rows (x, label). Each class covariance is mixed with the common one (towards_common) and then with its own
    diagonal (shrink), and a thousandth of the common variances is added. Rows with a null label or x are left out; a
    class without rows takes the moments of all, and without any rows every score is the prior's.
    """
    k = len(NAMES)

    def moments(batches):
        total = np.zeros((2, 1 + k + k * k))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), np.float64).reshape(-1, k)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)])
        at = np.arange(total.shape[1])
        for c in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c), pa.int32()), pa.array(at, pa.int32()), pa.array(total[c])], names=["c", "at", "v"])

    rows = labelled.filter("x IS NOT NULL AND label IN (0, 1)").select("x", F.col("label").cast("int"))
    sums = np.zeros((2, 1 + k + k * k))
    for r in rows.mapInArrow(moments, "c int, at int, v double").groupBy("c", "at").agg(F.sum("v").alias("v")).collect():  # 2 * (1 + k + k * k) rows
        sums[r["c"], r["at"]] = r["v"]
    both = sums.sum(axis=0)

    def gaussian(s):
        n = max(s[0], 1)
        mean = s[1 : k + 1] / n
        return mean, s[k + 1 :].reshape(k, k) / n - np.outer(mean, mean)

    _, common = gaussian(both)
    parts = [gaussian(sums[c] if sums[c, 0] else both) for c in (0, 1)]
    weight = (sums[:, 0] + 1) / (both[0] + 2)
    within = sum(w * p[1] for w, p in zip(weight, parts))
    floor = np.diag(1e-3 * np.diag(common) + 1e-6)
    factors, offsets = [], []
    for c in (0, 1):
        s = (1 - towards_common) * parts[c][1] + towards_common * within
        s = (1 - shrink) * s + shrink * np.diag(np.diag(s)) + floor
        f = np.linalg.cholesky(s)
        factors.append(f)
        offsets.append(scale * np.log(weight[c]) - np.log(np.diag(f)).sum())
    return Discriminant(np.array([p[0] for p in parts]), np.array(factors), np.array(offsets), scale)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from the threshold on) of every row of docs.

    Only labels of rows that aren't held out are learned from; the score depends on the text alone. Statistics are
    computed once and stored. Null texts are scored as empty ones, labels that are null or neither 0 nor 1 are ignored,
    a doc_id with several labels counts once for each, and rows without doc_id are scored, never learned from.
    """
    x = stored(measured(docs), "quality-statistics")
    learn = labels.select(F.col("doc_id").cast("long"), F.col("quality").alias("label")).filter("label IS NOT NULL").filter(~held_out(F.col("doc_id")))
    model = fit(x.join(learn, "doc_id").select("x", "label"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = len(NAMES)

    def run(batches):
        for batch in batches:
            values = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, k)
            score = shared.value.score(values) if len(values) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    scored = x.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score reaches the threshold, as they are. Rows without doc_id can't be told apart and
    stay."""
    scores = quality_scores(docs, labels, threshold)
    rejected = stored(scores.groupBy("doc_id").agg(F.max("predicted").alias("p")).filter("p = 0").select("doc_id"), "quality-rejected")
    return docs.join(sized(rejected), "doc_id", "left_anti").select(docs.columns)
