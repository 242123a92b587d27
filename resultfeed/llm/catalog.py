"""Queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import jaccard, language, mixing, packing, quality, repeats, sharding, telephony, tokens, urls

#: name -> (query, DuckDB SQL or None)
REGISTERED = {
    "op1_url_filter": (urls.op1, None),
    "op2_mixing": (mixing.op2, mixing.ORACLE_SQL),
    "op3_quality_rules": (quality.op3, None),
    "op4_suffix_dedup": (repeats.op4, repeats.ORACLE_SQL),
    "op5_packing": (packing.op5, None),
    "op6_sharding": (sharding.op6, sharding.ORACLE_SQL),
    "op7_telephony": (telephony.op7, None),
    "op8_jaccard_join": (jaccard.op8, jaccard.ORACLE_SQL),
    "op9_token_counts": (tokens.op9, None),
    "op10_language_id": (language.op10, None),
    # parts of op1 and op3 that SQL can express: what comes before the trained model, and before EM
    "url_rules": (urls.url_rules, urls.RULES_SQL),
    "quality_counts": (quality.quality_counts, quality.COUNTS_SQL),
}


def queries() -> dict:
    return {name: query for name, (query, _) in REGISTERED.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql}
