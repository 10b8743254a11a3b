"""Every named query against its SQL, value for value."""

from collections import Counter

import pytest

import __spark_entry__ as entry
from quirework.plans.catalog import ORACLES, QUERIES

# Nothing qualifies in the smallest folder.
MAY_BE_EMPTY = {"q_h20_size_against", "q_c06_phrase_hits_body", "q_c06_phrase_hits_anchor_join", "q_d32_rule_hits", "q_e12_anchor_clashes",
                "q_c11_rebinds", "q_e10_flat_suffix", "q_d14_twice_defined"}


def bag(table):
    cols = sorted(table.column_names)
    return cols, Counter(zip(*[table[c].to_pylist() for c in cols]))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, duck, folder):
    table = QUERIES[name](spark, folder).toArrow()
    assert table.num_rows or name in MAY_BE_EMPTY, "a check that read nothing proves nothing"
    if name in ORACLES:
        assert bag(table) == bag(duck.sql(ORACLES[name]).to_arrow_table())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    from quirework.plans import catalog
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", ["q_i01_stream_ledger", "q_i06_stream_claims", "q_i07_stream_pending", "q_i07_stream_expiry"])
def test_keyed_streams_bring_their_state_store(name, spark, duck, folder):
    """The session is the caller's and may have any state store; it keeps the one it has."""
    from quirework.session import STATE_STORE
    own, other = spark.conf.get(STATE_STORE), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(STATE_STORE, other)
    try:
        assert bag(QUERIES[name](spark, folder).toArrow()) == bag(duck.sql(ORACLES[name]).to_arrow_table())
        assert spark.conf.get(STATE_STORE) == other
    finally:
        spark.conf.set(STATE_STORE, own)
