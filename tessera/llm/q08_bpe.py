"""Query op8_word_bpe. Tests hold it against the tokenizers library."""

import public_tokenizers

from tessera.llm.bpe import encode_column
from tessera.llm.common import table


def op8_word_bpe(spark, sf_dir):
    return encode_column(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op8_word_bpe": op8_word_bpe}
ORACLE = {}
