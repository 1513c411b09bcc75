"""The queries of this subpackage by name, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, html, language, neighbours, ngrams, packing, quality, sharding, sql, substrings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.query,
    "op2_ngrams": ngrams.query,
    "op3_neighbours": neighbours.query,
    "op4_decontamination": decontamination.query,
    "op5_chat": chat.query,
    "op6_sharding": sharding.query,
    "op7_html": html.query,
    "op8_substrings": substrings.query,
    "op9_language": language.query,
    "op10_quality": quality.query,
}

ORACLE_SQL: dict[str, str] = {"op2_ngrams": sql.NGRAMS, "op5_chat": sql.CHAT, "op8_substrings": sql.SUBSTRINGS}
