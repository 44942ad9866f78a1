"""Query op4_quality_scores. Tests hold it to accuracy on held-out labels."""

from tessera.llm.common import table
from tessera.llm.quality import quality_scores


def op4_quality_scores(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality_scores": op4_quality_scores}
ORACLE = {}
