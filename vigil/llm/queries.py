"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from importlib import import_module

_WHERE = {
    "op1_fingerprints": "winnowing",
    "op2_sentencepiece": "pieces",
    "op3_toxicity": "toxicity",
    "op4_quality": "quality",
    "op5_decontamination": "decontamination",
    "op6_ngram_jaccard": "jaccard",
    "op7_line_dedup": "lines",
    "op8_sharding": "sharding",
    "op9_pii": "pii",
    "op10_language_id": "language",
    "op11_licenses": "licenses",
    "op12_yinyang": "yinyang",
    "op13_spelling_variants": "variants",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in _WHERE.items():
        sql = getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
