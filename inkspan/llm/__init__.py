"""Operators for training-data pipelines: one module per problem, ``pNN_...``.

Nothing else in the library imports this subpackage.
"""

from __future__ import annotations

import importlib
import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Functions sent to Python workers travel with their code, so that executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Module of each problem, and its queries.
QUERIES = {
    "p01_terms": ("p1_found", "p1_terms"),
    "p02_lookalikes": ("p2_found", "p2_forms", "p2_classes"),
    "p03_pieces": ("p3_found", "p3_pieces"),
    "p06_neardup": ("p6_found", "p6_groups"),
    "p04_alignment": ("p4_found",),
    "p05_spans": ("p5_found", "p5_shared_part"),
    "p08_packing": ("p8_packed", "p8_fill"),
    "p09_mixing": ("p9_mix", "p9_shares"),
    "p10_residue": ("p10_found", "p10_kept"),
    "p07_sentences": ("p7_found", "p7_sentence_stats"),
}


def _modules() -> dict[str, object]:
    return {m: importlib.import_module(f"{__name__}.{m}") for m in QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    modules = _modules()
    return {q: getattr(modules[m], q) for m, names in QUERIES.items() for q in names}


def oracle_sql() -> dict[str, str]:
    return {q: sql for m in _modules().values() for q, sql in getattr(m, "SQL", {}).items()}
