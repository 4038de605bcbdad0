"""Every query against its DuckDB SQL, on whole tables."""

import pytest
from oracle import data, differences

from turnstream.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, name):
    assert not differences(spark, data("sf0.001"), catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs_whole(spark, name):
    assert catalogue.QUERIES[name](spark, data("sf0.001")).count() > 0


def test_flagship(spark):
    out = catalogue.flagship(spark, data("sf0.001"))
    assert out.columns == ["conv_id", "duration", "text", "segments"]
    assert out.count() == spark.read.parquet(data("sf0.001") + "/conversations.parquet").select("conv_id").distinct().count()


def test_entry_imports_without_llm(monkeypatch):
    import importlib.util

    import __spark_entry__ as e

    real = importlib.util.find_spec
    monkeypatch.setattr(e.importlib.util, "find_spec", lambda n, *a: None if n in ("turnstream.llm", "corpus_pipeline") else real(n, *a))
    assert set(e.queries()) == set(catalogue.QUERIES)
    assert set(e.oracle_sql()) == set(catalogue.SQL)
