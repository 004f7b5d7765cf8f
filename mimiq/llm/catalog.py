"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .additive import op8_additive, op8_sql
from .byte_bpe import op10_byte_bpe
from .chat import op7_chat, op7_sql
from .digests import op4_digests
from .html_text import op3_html_text
from .langid import op6_langid
from .lines import op5_line_dedup
from .packing import op1_packing
from .secrets import op2_secrets, op2_sql
from .simhash import op9_simhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_secrets": op2_secrets,
        "op3_html_text": op3_html_text,
        "op4_digests": op4_digests,
        "op5_line_dedup": op5_line_dedup,
        "op6_langid": op6_langid,
        "op7_chat": op7_chat,
        "op8_additive": op8_additive,
        "op9_simhash": op9_simhash,
        "op10_byte_bpe": op10_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secrets": op2_sql(),
        "op7_chat": op7_sql(),
        "op8_additive": op8_sql(),
    }
