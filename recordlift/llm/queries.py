"""Queries of the corpus operators and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordlift.llm import decontamination, fill_middle, licenses, media, near_dedup, ngram_scores, secrets, sentencepieces, sharding, spelling, substrings, token_shards, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_shards": token_shards.op1_token_shards,
    "op2_sentencepieces": sentencepieces.op2_sentencepieces,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_secrets": secrets.op4_secrets,
    "op5_sharding": sharding.op5_sharding,
    "op6_licenses": licenses.op6_licenses,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_media": media.op9_media,
    "op10_substrings": substrings.op10_substrings,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_ngram_scores": ngram_scores.op12_ngram_scores,
    "op13_spelling": spelling.op13_spelling,
    "interleave_pages": media.interleave_pages,
}
SQL: dict[str, str] = {
    "op3_decontamination": decontamination.OP3_SQL,
    "op4_secrets": secrets.OP4_SQL,
    "op6_licenses": licenses.OP6_SQL,
    "op7_near_dedup": near_dedup.OP7_SQL,
    "op10_substrings": substrings.OP10_SQL,
    "op11_fill_middle": fill_middle.OP11_SQL,
    "op13_spelling": spelling.OP13_SQL,
}
