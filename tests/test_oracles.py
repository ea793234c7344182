"""Every core query against its SQL oracle; those without one run and have a stable schema."""

import pytest

from fixlattice.plans import catalogue
from tests.compare import oracle, same


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, name):
    found = catalogue.QUERIES[name](spark, sf)
    if name in catalogue.ORACLES:
        same(found.toPandas(), oracle(catalogue.ORACLES[name], sf))
    else:
        assert found.columns and found.count() >= 0


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_the_training_data_operators():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        inside = p.relative_to(root).parts
        if "llm" in inside or inside[0] in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py") or inside == ("tests", "test_oracles.py"):
            continue
        assert "fixlattice.llm" not in p.read_text(), p
