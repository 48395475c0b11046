"""Queries and DuckDB SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .audit import OP11_SQL, op11_filter_audit
from .bpe import op7_byte_bpe
from .chat import OP4_SQL, op4_chat_format
from .covertree import OP2_SQL, op2_embedding_near_dedup
from .langid import op10_language_id
from .lexical import OP12_SQL, op12_lexical_search
from .minhash import OP8_SQL, op8_minhash_near_dedup
from .packing import op9_best_fit_packing
from .pii import op13_pii
from .quality import op3_quality_classifier
from .rules import op6_quality_rules
from .secrets import op1_secret_scan
from .urls import OP5_SQL, op5_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_secret_scan, op2_embedding_near_dedup, op3_quality_classifier, op4_chat_format, op5_url_filter, op6_quality_rules, op7_byte_bpe, op8_minhash_near_dedup, op9_best_fit_packing, op10_language_id, op11_filter_audit, op12_lexical_search, op13_pii]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_near_dedup": OP2_SQL, "op4_chat_format": OP4_SQL, "op5_url_filter": OP5_SQL, "op8_minhash_near_dedup": OP8_SQL, "op11_filter_audit": OP11_SQL, "op12_lexical_search": OP12_SQL}
