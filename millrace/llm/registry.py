"""Queries of this subpackage and their SQL, for the entry point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.decontamination import op2_decontamination
from millrace.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from millrace.llm.language_id import op8_language_id
from millrace.llm.minhash_dedup import OP7_SQL, op7_minhash
from millrace.llm.pii import op1_pii
from millrace.llm.secret_scan import op9_secret_scan
from millrace.llm.sentencepiece_codec import op3_sentencepiece
from millrace.llm.substring_dedup import OP5_SQL, op5_substring_dedup
from millrace.llm.suffix_dedup import OP4_SQL, op4_suffix_dedup
from millrace.llm.warc import OP6_SQL, op6_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_decontamination": op2_decontamination,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_warc": op6_warc,
    "op7_minhash": op7_minhash,
    "op8_language_id": op8_language_id,
    "op9_secret_scan": op9_secret_scan,
    "op10_exact_dedup": op10_exact_dedup,
}
SQL: dict[str, str] = {
    "op4_suffix_dedup": OP4_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op7_minhash": OP7_SQL,
    "op10_exact_dedup": OP10_SQL,
}
