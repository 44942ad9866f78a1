"""Query op6_repeated_passages. Paragraph cuts depend on hashes that SQL doesn't have; tests compare with brute force."""

from tessera.llm.common import table
from tessera.llm.passages import repeated_spans


def op6_repeated_passages(spark, sf_dir):
    return repeated_spans(table(spark, sf_dir, "documents"))


QUERIES = {"op6_repeated_passages": op6_repeated_passages}
ORACLE = {}
