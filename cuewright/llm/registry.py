"""Queries of the llm operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, jaccard, linkgraph, matroska, mixing, quality, secrets, simple8b, spelling, substring, toxicity, trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_simple8b": simple8b.op2_simple8b,
        "op3_linkgraph": linkgraph.op3_linkgraph,
        "op4_substring": substring.op4_substring,
        "op5_matroska": matroska.op5_matroska,
        "op6_secrets": secrets.op6_secrets,
        "op7_jaccard": jaccard.op7_jaccard,
        "op8_mixing": mixing.op8_mixing,
        "op9_quality": quality.op9_quality,
        "op10_chat": chat.op10_chat,
        "op11_trie": trie.op11_trie,
        "op12_spelling": spelling.op12_spelling,
        "op13_toxicity": toxicity.op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_linkgraph": linkgraph.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL, "op11_trie": trie.ORACLE_SQL, "op12_spelling": spelling.ORACLE_SQL}
