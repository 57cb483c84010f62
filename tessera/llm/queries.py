"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontam import OP4_SQL, op4_decontamination
from tessera.llm.langid import op10_language_id
from tessera.llm.linededup import OP6_SQL, op6_line_dedup
from tessera.llm.mixing import op8_source_mixing
from tessera.llm.neardup import OP2_SQL, op2_minhash_near_dedup
from tessera.llm.pii import op9_pii
from tessera.llm.tiff import op7_media_tiff
from tessera.llm.tokencount import op5_token_counts
from tessera.llm.toxicity import op1_toxicity
from tessera.llm.urlfilter import OP3_SQL, op3_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_decontamination": op4_decontamination,
    "op5_token_counts": op5_token_counts,
    "op6_line_dedup": op6_line_dedup,
    "op7_media_tiff": op7_media_tiff,
    "op8_source_mixing": op8_source_mixing,
    "op9_pii": op9_pii,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": OP2_SQL,
    "op3_url_filter": OP3_SQL,
    "op4_decontamination": OP4_SQL,
    "op6_line_dedup": OP6_SQL,
}
