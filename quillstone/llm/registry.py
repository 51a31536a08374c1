"""The queries of the operators in this package, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, audit, bpe, chat, decontaminate, html, imatch, langid, lm, negatives, passages, simhash, suffix


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": ann.query,
        "op2_passages": passages.query,
        "op3_simhash": simhash.query,
        "op4_chat": chat.query,
        "op5_html": html.query,
        "op6_lm": lm.query,
        "op7_bpe": bpe.query,
        "op8_langid": langid.query,
        "op9_decontaminate": decontaminate.query,
        "op10_suffix": suffix.query,
        "op11_negatives": negatives.query,
        "op12_audit": audit.query,
        "op13_imatch": imatch.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat": chat.ORACLE,
        "op9_decontaminate": decontaminate.ORACLE,
        "op11_negatives": negatives.ORACLE,
        "op12_audit": audit.ORACLE,
    }
