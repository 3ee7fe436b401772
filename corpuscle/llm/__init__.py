"""Operations of a training-data pipeline.  Nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

#: Query name, module, and the module's function; SQL, where there is any, is the module's ``ORACLE_SQL``.
_QUERIES = {
    "op1_pfair_mix": "pfair_mix",
    "op2_nearest": "multi_index_hash",
    "op3_ngram_join": "ngram_join",
    "op4_secrets": "secret_ledger",
    "op5_toxicity": "weak_toxicity",
    "op6_repeats": "bwt_dedup",
    "op7_language": "crf_language",
    "op8_bpe": "bpe_backtrack",
    "op9_embedding_dedup": "inverted_multi_index",
    "op10_licenses": "license_join",
}


#: Queries beside these, with the name of their SQL.
_MORE = {"license_base": ("license_join", "BASE_SQL")}


def queries() -> dict:
    modules = _QUERIES | {name: module for name, (module, _) in _MORE.items()}
    return {name: getattr(import_module(f"{__name__}.{module}"), name) for name, module in modules.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__name__}.{module}"), "ORACLE_SQL", None) for name, module in _QUERIES.items()}
    found |= {name: getattr(import_module(f"{__name__}.{module}"), sql) for name, (module, sql) in _MORE.items()}
    return {name: sql for name, sql in found.items() if sql}
