"""Queries of the training-data operators by name, with DuckDB SQL where it can express them."""

from __future__ import annotations

import importlib

#: Modules with QUERIES (name: function of (spark, sf_dir)) and ORACLE (name: SQL).
MODULES = ("fingerprint", "secret_scan", "url_filter", "jaccard_join", "decontaminate", "mixing", "pii", "token_count", "quality", "toxicity")


def _each(attribute: str) -> dict:
    found = {}
    for name in MODULES:
        found.update(getattr(importlib.import_module(f"hyperloom.llm.{name}"), attribute))
    return found


def queries() -> dict:
    import corpus_pipeline

    return _each("QUERIES") | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return _each("ORACLE")
