"""Query op11_best_fit_packing. Tests hold ids against the tokenizers library, and the packing against one task's."""

import public_tokenizers

from tessera.llm.common import settled, table
from tessera.llm.packing import packed, token_pieces


def op11_best_fit_packing(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    return settled(spark, "packed", lambda: packed(token_pieces(table(spark, sf_dir, "documents"), path)))


QUERIES = {"op11_best_fit_packing": op11_best_fit_packing}
ORACLE = {}
