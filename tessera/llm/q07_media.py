"""Query op7_jpeg_media. Huffman coding isn't expressed in SQL; tests hold it against the payloads and a bit-by-bit reader."""

from tessera.llm.common import table
from tessera.llm.jpeg import media_features, with_media


def op7_jpeg_media(spark, sf_dir):
    return media_features(with_media(table(spark, sf_dir, "documents")))


QUERIES = {"op7_jpeg_media": op7_jpeg_media}
ORACLE = {}
