"""Registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exactdedup, hilbert, mixing, packing, simhash, sketch, topk, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (warc.op1_warc_normaliser, chat.op2_chat_formatting, exactdedup.op3_suffix_dedup, simhash.op4_simhash_anchors, toxicity.op5_toxicity_grammar, mixing.op6_pfair_mixing, sketch.op7_scaled_sketch, packing.op8_best_fit_packing, topk.op9_exact_top_k, hilbert.op10_hilbert_sharding)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_normaliser": warc.OP1_SQL,
        "op2_chat_formatting": chat.OP2_SQL,
        "op3_suffix_dedup": exactdedup.OP3_SQL,
        "op6_pfair_mixing": mixing.OP6_SQL,
        "op9_exact_top_k": topk.OP9_SQL,
        "op10_hilbert_sharding": hilbert.OP10_SQL,
    }
