"""Every query of this subpackage and, where SQL can express it, its SQL."""

from __future__ import annotations

import importlib

import corpus_pipeline

MODULES = (
    "q01_sharding", "q02_warc", "q03_linejoin", "q04_quality", "q05_minhash", "q06_passages", "q07_media", "q08_bpe", "q09_html", "q10_decontaminate", "q11_packing", "q12_collocations", "q13_variants",
)

QUERIES: dict = {}
ORACLE: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"tessera.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
