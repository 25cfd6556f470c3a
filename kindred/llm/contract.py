"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kindred.llm.decontamination import op6_benchmark_decontamination
from kindred.llm.jaccard_join import op3_ngram_jaccard_join
from kindred.llm.language_id import op9_language_id
from kindred.llm.lm_scoring import op4_lm_scoring
from kindred.llm.mixing import ORACLE as MIXING_SQL
from kindred.llm.mixing import op10_mixing_sources
from kindred.llm.near_dedup import op1_embedding_near_dedup
from kindred.llm.pii import op8_pii_extraction
from kindred.llm.quality import op5_quality_classifier
from kindred.llm.secrets import op2_secret_scan
from kindred.llm.token_counts import op7_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_pii_extraction": op8_pii_extraction,
    "op9_language_id": op9_language_id,
    "op10_mixing_sources": op10_mixing_sources,
}

ORACLE_SQL: dict[str, str] = {"op10_mixing_sources": MIXING_SQL}
