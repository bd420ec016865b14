"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import ready

# query name: (module, function, name of its SQL constant or None)
QUERIES = {
    "op1_html_extraction": ("html_extraction", "op1_html_extraction", None),
    "op2_decontamination": ("decontamination", "op2_decontamination", None),
    "op3_near_duplicates": ("minhash_dedup", "op3_near_duplicates", None),
    "op4_nearest_neighbours": ("ann_search", "op4_nearest_neighbours", None),
    "op5_secret_scan": ("secret_scan", "op5_secret_scan", "OP5_SQL"),
    "op6_line_dedup": ("line_dedup", "op6_line_dedup", "OP6_SQL"),
    "op10_language_id": ("language_id", "op10_language_id", None),
    "op9_sentencepiece": ("sentencepiece_codec", "op9_sentencepiece", None),
    "op7_toxicity": ("toxicity", "op7_toxicity", None),
    "op8_sharding": ("sharding", "op8_sharding", None),
    "op11_source_divergence": ("divergence", "op11_source_divergence", "OP11_SQL"),
    "op12_best_fit_packing": ("packing", "op12_best_fit_packing", None),
    "op13_periodic_runs": ("periodic_runs", "op13_periodic_runs", None),
}


def _query(module: str, function: str) -> Callable[[SparkSession, str], DataFrame]:
    f = getattr(importlib.import_module(f"{__package__}.{module}"), function)
    return lambda spark, sf_dir: f(ready(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to function of (spark, sf_dir)."""
    return {name: _query(module, function) for name, (module, function, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those queries that SQL can express."""
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), sql) for name, (module, _, sql) in QUERIES.items() if sql}
