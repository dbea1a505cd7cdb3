"""Every query of the library against its SQL, and the driver's contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from loomframe import queries as own


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_meets_its_sql(name, agrees):
    agrees(own.queries()[name], own.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(own.queries()) == set(own.oracle_sql())


def test_contract_holds_the_own_queries(spark):
    assert set(own.queries()) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
    first = contract.entry(spark)
    assert first.columns and first.count() >= 0


def test_nothing_but_the_entry_imports_the_corpus_subpackage():
    from pathlib import Path

    root = Path(own.__file__).resolve().parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "loomframe.llm" not in f.read_text(), f
