"""Queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, cover_tree, decontamination, jaccard_join, resampling
from .chunk_dedup import op3_substring_dedup
from .hilbert import op5_sharding_hilbert
from .media import op1_media_flac
from .mixing import op9_mixing_sources
from .packing import op8_best_fit_packing
from .quality import op10_quality_qda
from .secrets import op7_secret_scans
from .toxicity import op2_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_flac": op1_media_flac,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_ngram_jaccard_join": jaccard_join.op4_ngram_jaccard_join,
    "op5_sharding_hilbert": op5_sharding_hilbert,
    "op6_exact_topk": cover_tree.op6_exact_topk,
    "op7_secret_scans": op7_secret_scans,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_mixing_sources": op9_mixing_sources,
    "op10_quality_qda": op10_quality_qda,
    "op11_decontamination": decontamination.op11_decontamination,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard_join": jaccard_join.ORACLE,
    "op6_exact_topk": cover_tree.ORACLE,
    "op11_decontamination": decontamination.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
    "op13_importance_resampling": resampling.ORACLE,
}
