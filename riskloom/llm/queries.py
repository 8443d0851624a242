"""The queries of the text operators and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    backtrack_bpe,
    byte_bpe,
    chat_format,
    cross_align,
    decontaminate,
    html_extract,
    imatch,
    langid,
    periodic,
    records,
    secret_scan,
    simhash,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.query,
    "op2_records": records.query,
    "op9_imatch": imatch.query,
    "op3_decontaminate": decontaminate.query,
    "op4_byte_bpe": byte_bpe.query,
    "op5_langid": langid.query,
    "op6_chat_format": chat_format.query,
    "op7_simhash": simhash.query,
    "op8_html_extract": html_extract.query,
    "op10_secret_scan": secret_scan.query,
    "op11_align": cross_align.query,
    "op12_periodic": periodic.query,
    "op13_backtrack_bpe": backtrack_bpe.query,
}

ORACLE_SQL: dict[str, str] = {"op6_chat_format": chat_format.SQL}
