"""Queries and DuckDB texts of the corpus operators."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, jaccard_join, packing, pii, secret_scan, substring_dedup, topk_search, toxicity, url_filter, vector_dedup

MODULES = (url_filter, secret_scan, vector_dedup, packing, jaccard_join, topk_search, bpe, toxicity, substring_dedup, pii)


def queries():
    return {name: function for module in MODULES for name, function in module.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    texts = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
    return texts | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
