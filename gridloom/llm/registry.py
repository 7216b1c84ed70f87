"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

OPERATORS = {
    "op1_toxicity": "toxicity",
    "op2_media_columns": "media",
    "op3_line_dedup": "linedup",
    "op4_minhash_near_dedup": "neardup",
    "op5_exact_dedup": "exactdup",
    "op6_url_filters": "urlfilter",
    "op7_best_fit_packing": "packing",
    "op8_warc": "warczip",
    "op9_suffix_array_dedup": "suffixdup",
    "op10_mixing": "mixing",
    "op11_spelling_variants": "spelling",
    "op12_periodic_runs": "periodic",
    "op13_quality_rules": "divergence",
}
_modules = {name: import_module(f"gridloom.llm.{module}") for name, module in OPERATORS.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: m.query for name, m in _modules.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE_SQL for name, m in _modules.items() if m.ORACLE_SQL}
