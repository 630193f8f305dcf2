"""The queries of this folder, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat_format, exact_dedup, language_id, media, mixing, near_dedup, pii, sentencepiece_table, toxicity, url_filter

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": near_dedup.query,
        "op2_media": media.query,
        "op3_mixing": mixing.query,
        "op4_chat_format": chat_format.query,
        "op5_url_filter": url_filter.query,
        "op6_pii": pii.query,
        "op7_toxicity": toxicity.query,
        "op8_language_id": language_id.query,
        "op9_exact_dedup": exact_dedup.query,
        "op10_sentencepiece": lambda spark, sf_dir: sentencepiece_table.query(spark, sf_dir, MODEL),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": near_dedup.SQL,
        "op3_mixing": mixing.SQL,
        "op4_chat_format": chat_format.SQL,
        "op5_url_filter": url_filter.SQL,
        "op9_exact_dedup": exact_dedup.SQL,
    }
