"""The subpackage's queries, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, clusters, exact_dedup, main_text, mixing, ngram_join, packing, periodic, personal_data, pieces, quality, suffix_dedup, top_k

_MODULES = {
    "op1_ngram_jaccard_join": ngram_join,
    "op2_quality_classifier": quality,
    "op3_exact_top_k": top_k,
    "op4_chat_formatting": chat,
    "op5_sentencepiece": pieces,
    "op6_exact_dedup": exact_dedup,
    "op7_packing": packing,
    "op8_source_mixing": mixing,
    "op9_personal_data": personal_data,
    "op10_suffix_array_dedup": suffix_dedup,
    "op11_centroid_clustering": clusters,
    "op12_html_extraction": main_text,
    "op13_periodic_runs": periodic,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _MODULES.items()} | {"sentencepiece_scores": pieces.scores_query}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _MODULES.items() if module.ORACLE_SQL}
