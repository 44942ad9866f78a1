"""Query op5_near_duplicates. Components need iteration; tests compare with brute force over all pairs."""

from tessera.llm.common import table
from tessera.llm.minhash import near_duplicates


def op5_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


QUERIES = {"op5_near_duplicates": op5_near_duplicates}
ORACLE = {}
