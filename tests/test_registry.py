"""Every registered query with a SQL text gives DuckDB's result."""

import re

import pytest

from oracle_check import compare, duck
from registry import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    problem = compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES[name], FOLDER)
    assert problem is None, problem


def test_every_sql_text_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    registered = __spark_entry__.queries().keys()
    assert catalog.QUERIES.keys() <= registered
    # The optional training-data queries are all that may be added.
    assert all(re.fullmatch(r"op\d+_\w+|pipeline", n) for n in registered - catalog.QUERIES.keys())
