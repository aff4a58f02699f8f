"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import chat_format, decontam, language_id, line_dedup, lm_scoring, ngram_join, ogg, packing, secrets, suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": lm_scoring.query,
    "op2_line_dedup": line_dedup.query,
    "op3_language_id": language_id.query,
    "op4_chat_format": chat_format.query,
    "op5_decontam": decontam.query,
    "op6_ogg": ogg.query,
    "op7_ngram_join": ngram_join.query,
    "op8_packing": packing.query,
    "op9_secrets": secrets.query,
    "op10_suffix_dedup": suffix_dedup.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op4_chat_format": chat_format.ORACLE,
    "op5_decontam": decontam.ORACLE,
    "op7_ngram_join": ngram_join.ORACLE,
    "op10_suffix_dedup": suffix_dedup.ORACLE,
}
