"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

import importlib

#: Name of the query: module that has its function `opN` and, where SQL can express it, ORACLE.
MODULES = {
    "op1_pii": "pii",
    "op2_katz_lm": "katz",
    "op3_url_filter": "url_filter",
    "op4_toxicity": "toxicity",
    "op5_decontaminate": "decontaminate",
    "op6_minhash_near_dedup": "minhash",
    "op7_warc": "warc",
    "op8_fingerprints": "fingerprints",
    "op9_substring_dedup": "substring_dedup",
    "op10_packing": "packing",
}


def _module(name: str):
    return importlib.import_module(f".{MODULES[name]}", __package__)


def queries() -> dict:
    import corpus_pipeline

    return {name: getattr(_module(name), name.split("_")[0]) for name in MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in MODULES if (sql := getattr(_module(name), "ORACLE", None))}
