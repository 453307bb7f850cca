"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module of this folder with a function of that name.
MODULES = {
    "op1_vectors": "vectors",
    "op2_toxicity": "toxicity",
    "op3_pii": "pii",
    "op4_sharding": "sharding",
    "op5_decontam": "decontam",
    "op6_tokens": "tokenfiles",
    "op7_substrings": "substrings",
    "op8_minhash": "minhash",
    "op9_licences": "licences",
    "op10_mixing": "mixing",
    "sharding_small_limit": "sharding",
    "decontam_joined_items": "decontam",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in MODULES.items():
        if sql := getattr(import_module(f"{__package__}.{module}"), "ORACLES", {}).get(name):
            out[name] = sql
    return out
