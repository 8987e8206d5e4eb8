"""Every registered query against its oracle statement, on the smallest tables."""

import pytest

from __spark_entry__ import _MODULES, entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES = {name: query for module in _MODULES for name, (query, _) in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry_has_rows(spark):
    assert entry(spark).count() == 1


def test_every_query_has_an_oracle():
    assert sorted(QUERIES) == sorted(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], ORACLE[name]) is None
