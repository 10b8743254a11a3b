"""The registered queries: value for value where there is SQL, whole tables and stated columns everywhere."""

from collections import Counter

import __spark_entry__ as entry
import pytest

from quirework.llm import catalog

COLUMNS = {
    "op1_line_dedup": ["doc_id", "n_lines", "n_removed", "removed", "kept_sha256"],
    "op2_minhash_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op3_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op4_toxicity": ["doc_id", "held_out", "score", "predicted", "evidence"],
    "op5_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op6_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op7_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_bpe_encoding": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op10_benchmark_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op11_byte_bpe_encoding": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op12_hard_negative_mining": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op13_embedding_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
}


def bag(table):
    cols = sorted(table.column_names)
    return cols, Counter(zip(*[table[c].to_pylist() for c in cols]))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(name, spark, duck, folder):
    got = catalog.QUERIES[name](spark, folder)
    assert got.columns == COLUMNS[name]
    table = got.toArrow()
    if name in catalog.ORACLES:
        assert bag(table) == bag(duck.sql(catalog.ORACLES[name]).to_arrow_table())
    elif "doc_id" in got.columns:
        assert sorted(table["doc_id"].to_pylist()) == sorted(r[0] for r in duck.sql("select doc_id from documents").fetchall())


def test_registered(spark):
    assert set(catalog.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql())


