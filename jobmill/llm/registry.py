"""The queries of this subpackage and their SQL, by the names that __spark_entry__.py registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hnsw, licenses, media, mixing, ngram_join, preferences, quality, sentencepiece_ids, token_files, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_preference_formatting": preferences.op3_preference_formatting,
    "op4_media_columns": media.op4_media_columns,
    "op5_mixing": mixing.op5_mixing,
    "op6_hnsw": hnsw.op6_hnsw,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_sentencepiece": sentencepiece_ids.op9_sentencepiece,
    "op10_token_files": token_files.op10_token_files,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE,
    "op3_preference_formatting": preferences.ORACLE,
    "op7_license_scan": licenses.ORACLE,
}
