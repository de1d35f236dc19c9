"""The queries of this subpackage, for the driver's entry module."""

from __future__ import annotations

from importlib import import_module

MODULES = {
    "op1_license_scan": "license_scan",
    "op2_quality_fm": "quality_fm",
    "op3_language_id": "language_id",
    "op4_pii": "pii",
    "op5_best_fit_packing": "packing",
    "op6_chat_format": "chat_format",
    "op7_warc_store": "warc_store",
    "op8_decontaminate": "decontaminate",
    "op9_ngram_join": "ngram_join",
    "op10_embedding_join": "embedding_join",
    "op11_line_dedup": "line_dedup",
    "op12_token_alignment": "token_align",
    "op13_whitening": "whitening",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
