"""Query op9_main_text. Tests hold it against pages whose article is known."""

from tessera.llm.common import table
from tessera.llm.htmltext import extracted


def op9_main_text(spark, sf_dir):
    return extracted(table(spark, sf_dir, "pages"))


QUERIES = {"op9_main_text": op9_main_text}
ORACLE = {}
