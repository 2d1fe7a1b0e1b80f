"""The queries of this subpackage, by name, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontam, embeddings, importance, langid, licenses, packing, search, simhash, toxicity, urlrules, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.query,
    "op2_embedding_near_dedup": embeddings.query,
    "op3_simhash_near_dedup": simhash.query,
    "op4_language_id": langid.query,
    "op5_byte_bpe": bpe.query,
    "op6_warc": warc.query,
    "op7_benchmark_decontamination": decontam.query,
    "op8_toxicity": toxicity.query,
    "op9_chat_format": chat.query,
    "op10_url_filter": urlrules.query,
    "op11_importance_resampling": importance.query,
    "op12_packing": packing.query,
    "op13_ranked_search": search.query,
}
ORACLES: dict[str, str] = {"op6_warc": warc.ORACLE, "op9_chat_format": chat.ORACLE, "op11_importance_resampling": importance.ORACLE, "op13_ranked_search": search.ORACLE}
