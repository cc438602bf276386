"""Every query of the core against DuckDB."""

import pytest

from compare import check
from tidefold.queries import oracles, registered


@pytest.mark.parametrize("name", sorted(oracles))
def test_matches(spark, sf_dir, name):
    check(spark, sf_dir, registered[name], oracles[name])


def test_all_have_sql_but_the_merge_loop():
    assert set(registered) - set(oracles) == {"shard_merge_loop"} and set(oracles) <= set(registered)
