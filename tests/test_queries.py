"""Every core query against its SQL over whole tables."""

import pytest

from lociq.plans import fetch, fetch_queries, gene_queries, output_queries, record_queries
from tests.oracle import check

PLANS = [gene_queries, fetch_queries, output_queries, record_queries, fetch]
NAMES = [(p, n) for p in PLANS for n in p.ORACLE]


@pytest.mark.parametrize("plan,name", NAMES, ids=[n for _, n in NAMES])
def test_query(spark, tables, plan, name):
    check(spark, tables, plan.QUERIES[name], plan.ORACLE[name])


def test_entry(spark, tables):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0


def test_core_stands_without_the_subpackage():
    """Nothing in the core imports the subpackage."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "lociq"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "lociq.llm" not in f.read_text(), f
