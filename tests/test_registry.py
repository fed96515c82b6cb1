"""Every registered query beside its SQL twin on the smallest data."""

from __future__ import annotations

import pytest
from compare import connect, difference
from conftest import SMALL

import __spark_entry__ as contract


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


def test_contract_names():
    names = set(contract.queries())
    assert set(contract.oracle_sql()) <= names
    assert len(names) > 95


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_matches_twin(spark, connection, name):
    problem, _ = difference(spark, connection, contract.queries()[name], contract.oracle_sql().get(name), SMALL)
    assert not problem


def test_entry_packs_every_query(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 40
    assert all(r.used_tokens <= r.effective_tokens for r in rows)
    assert any(r.results for r in rows)
