"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chunk_dedup, decontaminate, language, licenses, line_dedup, media, mixing, ngram_join, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.query,
    "op2_ngram_join": ngram_join.query,
    "op3_mixing": mixing.query,
    "op4_licenses": licenses.query,
    "op5_chunk_dedup": chunk_dedup.query,
    "op6_decontaminate": decontaminate.query,
    "op7_media": media.query,
    "op8_language": language.query,
    "op9_toxicity": toxicity.query,
    "op10_suffix_dedup": suffix_dedup.query,
}
ORACLES: dict[str, str] = {"op1_line_dedup": line_dedup.SQL, "op4_licenses": licenses.SQL, "op6_decontaminate": decontaminate.SQL}
