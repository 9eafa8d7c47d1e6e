"""The corpus queries that SQL can express, against it; the others against their contract's shape."""

import pytest

from freshet.llm import registry
from tests.oracle import compare, connection


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, data, con, name):
    compare(registry.QUERIES[name](spark, data), con, registry.ORACLE[name])


COLUMNS = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op4_near_duplicates": "doc_id n_shingles component_id kept",
    "op6_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op7_mix_sources": "doc_id size source_size target taken",
    "op8_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op9_shard": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_main_text": "page_id url text n_chars",
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_contract_columns_and_whole_tables(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    assert set(COLUMNS.get(name, "").split()) <= set(df.columns)
    n = df.count()
    if name.startswith("op"):
        whole = {"op3_chat_format": None, "op5_language": "pages", "op10_main_text": "pages"}.get(name, "documents")
        if whole:
            assert n == spark.read.parquet(f"{data}/{whole}.parquet").count()
