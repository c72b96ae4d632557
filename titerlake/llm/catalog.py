"""Queries of this subpackage and, where SQL can state them, the DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from titerlake.llm import audit, chat, graph, jaccard, language, lines, mixing, negatives, packing, quality, secrets, telephony, tokenids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_token_ids": tokenids.op3_token_ids,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_language_id": language.op9_language_id,
    "op10_telephony": telephony.op10_telephony,
    "op11_graph_neighbours": graph.op11_graph_neighbours,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_filter_audit": audit.op13_filter_audit,
}
ORACLE_SQL: dict[str, str] = {**chat.ORACLE_SQL, **lines.ORACLE_SQL, **negatives.ORACLE_SQL, **audit.ORACLE_SQL}
