"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, licenses, line_dedup, mixing, near_dedup, quality, substring_dedup, token_counts, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_warc": warc.op2_warc,
        "op3_chat_formatting": chat.op3_chat_formatting,
        "op4_source_mixing": mixing.op4_source_mixing,
        "op5_decontamination": decontamination.op5_decontamination,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_minhash_near_dedup": near_dedup.op7_minhash_near_dedup,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_line_dedup": line_dedup.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.OP2_SQL,
        "op3_chat_formatting": chat.OP3_SQL,
        "op4_source_mixing": mixing.OP4_SQL,
        "op5_decontamination": decontamination.OP5_SQL,
        "op7_minhash_near_dedup": near_dedup.OP7_SQL,
        "op9_substring_dedup": substring_dedup.OP9_SQL,
    }
