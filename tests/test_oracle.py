from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    rows, problems = compare(spark, con, FOLDER, contract.queries()[name], contract.oracle_sql()[name])
    assert problems == []
    assert rows > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
