"""The driver's contract."""

import __spark_entry__ as entry
from pagemill import catalog  # noqa: E402


def test_queries_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"hybrid_retrieval", "bm25_topk", "grounding_ledger"} <= set(catalog.SQL)
    assert not any(n.startswith("p1_") for n in catalog.QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
