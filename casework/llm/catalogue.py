"""Registered queries of the training-data operators and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casework.llm import (ann, centroids, decontaminate, imatch, langid, licences, linededup, mixing, packing,
                          prefixtrie, sharding, simhash, toolcalls)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": packing.documents_query,
        "op2_one_bit_neighbours": ann.embeddings_query,
        "op3_imatch_fingerprints": imatch.documents_query,
        "op4_mix_sources": mixing.documents_query,
        "op5_language_id": langid.documents_query,
        "op6_fuzzy_lines": linededup.documents_query,
        "op7_tool_calls": toolcalls.conversations_query,
        "op8_simhash_near_dedup": simhash.documents_query,
        "op9_shard_placement": sharding.documents_query,
        "op10_licence_scan": licences.documents_query,
        "op11_ptolemaic_clusters": centroids.embeddings_query,
        "op12_prefix_trie": prefixtrie.conversations_query,
        "op13_benchmark_leaks": decontaminate.documents_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_imatch_fingerprints": imatch.ORACLE_SQL,
        "op4_mix_sources": mixing.ORACLE_SQL,
        "op9_shard_placement": sharding.ORACLE_SQL,
        "op10_licence_scan": licences.ORACLE_SQL,
        "op11_ptolemaic_clusters": centroids.ORACLE_SQL,
        "op13_benchmark_leaks": decontaminate.ORACLE_SQL,
    }
