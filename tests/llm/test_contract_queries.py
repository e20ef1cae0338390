"""The registered queries run as they are and give the contract's columns."""

import pytest

from millrace.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
FIRST = {
    "op1_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op3_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op5_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op6_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op7_minhash": ["doc_id", "n_shingles", "component_id", "kept"],
    "op10_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in FIRST:
        assert df.columns == FIRST[name]
        table = "pages" if name == "op6_warc" else "documents"
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert set(SQL) <= set(QUERIES)
