"""Queries that SQL can express agree with DuckDB."""

import oracle
import pytest

from lanewise.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_oracle(spark, name, sf):
    assert oracle.difference(spark, oracle.connect(sf), queries.queries()[name], queries.ORACLES[name], sf) == ""
