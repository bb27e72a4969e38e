"""Every query against its SQL on the same tables."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as contract
from driftline import catalog

NAMES = list(contract.oracle_sql())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(catalog.QUERIES) <= set(NAMES) <= set(contract.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, folder, con, name):
    df = contract.queries()[name](spark, folder)
    assert oracle.compare(df, con, contract.oracle_sql()[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
