"""Query op10_benchmark_passages. Tests compare with brute force over all passages and items."""

from tessera.llm.common import table
from tessera.llm.decontaminate import contaminated


def op10_benchmark_passages(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_benchmark_passages": op10_benchmark_passages}
ORACLE = {}
