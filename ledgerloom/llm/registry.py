"""Queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, decontaminate, divergence, html_extract, itq_dedup, language_id, minhash_dedup, mixing, periodic_runs, pseudonyms, secret_scan, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_language_id": language_id.op2_language_id,
        "op3_chat_format": chat_format.op3_chat_format,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_pseudonyms": pseudonyms.op5_pseudonyms,
        "op6_html_extract": html_extract.op6_html_extract,
        "op7_itq_dedup": itq_dedup.op7_itq_dedup,
        "op8_minhash_dedup": minhash_dedup.op8_minhash_dedup,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_secret_scan": secret_scan.op10_secret_scan,
        "op11_bpe": bpe.op11_bpe,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_divergence": divergence.op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.OP1_SQL, "op3_chat_format": chat_format.OP3_SQL, "op9_url_filter": url_filter.OP9_SQL, "op12_periodic_runs": periodic_runs.OP12_SQL, "op13_divergence": divergence.OP13_SQL}
