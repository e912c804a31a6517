"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, language, line_dedup, media, mixing, near_dedup, packing, quality, secrets, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": token_counts.query,
        "op2_line_dedup": line_dedup.query,
        "op3_language_id": language.query,
        "op4_mixing": mixing.query,
        "op5_best_fit_packing": packing.query,
        "op6_media_sniffing": media.query,
        "op7_secret_scan": secrets.query,
        "op8_quality_rules": quality.query,
        "op9_chat_formatting": chat.query,
        "op10_minhash_near_dedup": near_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.ORACLE,
        "op4_mixing": mixing.ORACLE,
        "op9_chat_formatting": chat.ORACLE,
    }
