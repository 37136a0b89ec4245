"""The registered queries of the language-model operators and their SQL twins."""

from __future__ import annotations

from importlib import import_module

#: Module -> its query.
MODULES = {
    "lm_score": "op1_lm_score",
    "quality": "op2_quality",
    "fixity": "op3_warc_fixity",
    "token_edit": "op4_token_edit",
    "license_scan": "op5_license_scan",
    "packing": "op6_packing",
    "ngram_join": "op7_ngram_join",
    "unigram": "op8_unigram",
    "nn_descent": "op9_nn_descent",
    "pii": "op10_pii",
}


def queries() -> dict:
    """Query name -> function of (spark, sf_dir)."""
    return {name: getattr(import_module(f".{module}", __package__), name) for module, name in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    found = {name: getattr(import_module(f".{module}", __package__), "ORACLE_SQL", None) for module, name in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
