"""Operators that SQL can express, against DuckDB."""

import pytest

from compare import check
from tidefold.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches(spark, sf_dir, name):
    assert check(spark, sf_dir, queries()[name], oracle_sql()[name]) == 200
