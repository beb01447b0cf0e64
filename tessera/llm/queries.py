"""Queries of this package, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe import op8_byte_bpe
from tessera.llm.codes import op11_vector_codes
from tessera.llm.grades import op3_quality_classifier
from tessera.llm.language import op10_language_id
from tessera.llm.lines import op2_line_dedup
from tessera.llm.manifest import op12_merkle_manifest
from tessera.llm.minhash import op9_minhash_near_dedup
from tessera.llm.packing import op5_packing
from tessera.llm.quality import op1_quality_rules
from tessera.llm.sql import ORACLES
from tessera.llm.substrings import op6_substring_dedup
from tessera.llm.topk import op7_topk_search
from tessera.llm.urls import op13_url_filters
from tessera.llm.warc import op4_warc_transactions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_line_dedup,
        op3_quality_classifier,
        op4_warc_transactions,
        op5_packing,
        op6_substring_dedup,
        op7_topk_search,
        op8_byte_bpe,
        op9_minhash_near_dedup,
        op10_language_id,
        op11_vector_codes,
        op12_merkle_manifest,
        op13_url_filters,
    )
}

__all__ = ["ORACLES", "QUERIES"]
