"""From raw documents to token ids: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers

from tessera.llm.bpe import encode_column
from tessera.llm.common import settled, small_batches, stored, table
from tessera.llm.decontaminate import without_contaminated
from tessera.llm.linejoin import without_later_lines
from tessera.llm.minhash import near_duplicates
from tessera.llm.quality import accepted


def quality_classifier(spark, docs, sf_dir):
    """Documents that the discriminant scores below 0.3 go. Null and empty texts are scored like any text; repeated rows get
    one score; without labels all scores are 0.5 and all stay."""
    small_batches(spark)
    return accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark, docs, sf_dir):
    """Lines that nearly equal an earlier one go, and documents of which nothing is left. Null and empty texts stay; rows
    without doc_id stay whole; rows that share a doc_id are told apart by their texts, rows equal in both stay alike."""
    small_batches(spark)
    return without_later_lines(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near duplicates stays: the one with the smallest doc_id. Null and empty texts and rows
    without doc_id stay; all rows of a doc_id stay or go together."""
    small_batches(spark)
    gone = settled(spark, "near-gone", lambda: near_duplicates(docs, k=5, percent=80).filter("NOT kept").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go, all rows of their doc_id. Null and empty texts stay, and all rows where the
    benchmark is empty."""
    small_batches(spark)
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark, docs, sf_dir):
    """doc_id, n_tokens, digests of ids and decoded text, and the ids, row by row. A null text is an empty one."""
    small_batches(spark)
    return encode_column(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: The classifier, the sketches and the encoder aren't expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
