"""Query op3_line_dedup and its SQL."""

from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.linejoin import later_lines, text_id


def _removed(docs, gone):
    gone = gone.groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_set(F.col("line").cast("long"))).alias("removed"), F.min("match_doc_id").alias("first_match"))
    n_lines = F.when(F.octet_length("text") > 0, F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).otherwise(0).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), text_id(), n_lines.alias("n_lines"))
    rows = rows.join(gone, ["doc_id", "text_id"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<bigint>")))
    return rows.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", "first_match")


def op3_line_dedup(spark, sf_dir):
    """One row per document: how many of its lines go, which, and the documents whose lines they repeat."""
    docs = table(spark, sf_dir, "documents")
    return _removed(docs, later_lines(docs))


def op3_line_dedup_short(spark, sf_dir):
    """The same, with lines of one word or more."""
    docs = table(spark, sf_dir, "documents")
    return _removed(docs, later_lines(docs, least_words=1))


QUERIES = {"op3_line_dedup": op3_line_dedup, "op3_line_dedup_short": op3_line_dedup_short}
ORACLE = {}
