"""Spelling variants by symmetric deletion, in columns: words that are one edit apart share a key of one deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without(word: Column, at: Column) -> Column:
    """The word without its code point at `at` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))


def damaged_words(df: DataFrame, every: int = 31, least: int = 7, twice: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased. Where `every` divides the checksum of
    '<key>:<run>' the run's code point at checksum % length is missing. Words of fewer than `least` code points or `twice`
    occurrences aren't there. A null text has none; a null key is written as nothing; rows count one by one. Shorter runs
    can't give such words, so they aren't taken up; runs are counted before the shuffle."""
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"[a-zÀ-ÿ]{{{least},}}"), F.lit(0))
    h = F.crc32(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    hashed = df.select(F.col(key), F.explode(runs).alias("run")).withColumn("h", h)
    word = F.when(F.col("h") % every == 0, without(F.col("run"), (F.col("h") % F.char_length("run")).cast("int"))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= twice)


def spelling_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n for each row of (word, n); words are unique and not empty.

    Two words are near if one insertion, deletion or replacement of a code point makes them equal. A word's form is its near
    word of largest n (ties: the first in code-point order), if that n is at least `times` its own; its root is where forms
    lead in the end.

    Every word emits itself and its distinct deletions. Near words share exactly one of these keys: a replacement the key
    without the place where they differ, an insertion the shorter word. So pairs come once, and the exact distance is verified
    on each. A key's words are bounded by the alphabet times the places of one insertion, not by rows. Forms grow by
    `times`, so that pointer doubling is over after the logarithm of a logarithm of n turns."""
    words = stored(words.select("word", "n"), "variant-words")
    deletions = F.transform(F.sequence(F.lit(0), F.char_length("word") - 1), lambda i: without(F.col("word"), i))
    keys = words.select("word", "n", F.explode(F.array_append(F.array_distinct(deletions), F.col("word"))).alias("key"))
    shared = keys.groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("own")).filter(F.size("own") > 1)
    pairs = shared.select(F.explode("own").alias("a"), "own").select("a.word", "a.n", F.explode("own").alias("b"))
    pairs = pairs.filter(F.levenshtein("word", "b.word", 1) == 1).select("word", "n", F.struct(-F.col("b.n"), F.col("b.word")).alias("other"))
    alone = words.select("word", "n", F.lit(None).cast("struct<col1:bigint,word:string>").alias("other"))
    near = alone.union(pairs).groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), F.min("other").alias("best"))
    enough = -F.col("best.col1") >= times * F.col("n")
    near = near.select("word", "n", "n_near", F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.col1")).alias("form_n"))
    near = stored(near, "variant-forms")
    roots = near.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = stored(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        roots = stepped.drop("moved")
        if stepped.filter("moved").isEmpty():
            return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
