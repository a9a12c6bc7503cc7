"""Operators for training-data pipelines, each with one registered query.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cilens.llm import (
    chat, decontaminate, license_scan, minhash, pii, quality, secret_scan, sentencepieces, simhash, spelling, token_store, warc, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.query,
    "op2_license_scan": license_scan.query,
    "op3_chat_turns": chat.query,
    "op4_token_store": token_store.query,
    "op5_simhash": simhash.query,
    "op6_decontaminate": decontaminate.query,
    "op7_sentencepiece": sentencepieces.query,
    "op8_quality": quality.query,
    "op9_minhash": minhash.query,
    "op10_warc": warc.query,
    "op11_secret_scan": secret_scan.query,
    "op12_whitening": whitening.query,
    "op13_spelling": spelling.query,
}

#: DuckDB texts where SQL can express a query.
ORACLES: dict[str, str] = {"op10_warc": warc.ORACLE, "op11_secret_scan": secret_scan.ORACLE}
