"""Operators that SQL can express, against their DuckDB SQL."""

import pytest
from oracle import data, differences

pytest.importorskip("public_tokenizers")
from turnstream.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    assert not differences(spark, data("sf0.001"), queries.QUERIES[name], queries.SQL[name])
