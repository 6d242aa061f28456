import __spark_entry__ as entry
import pytest

from tidemark.plans import registry

from .oracle import SF, compare


@pytest.mark.parametrize("name", [n for n in registry.ALL if registry.ALL[n][1]])
def test_matches_oracle(spark, name):
    run, sql = registry.ALL[name]
    compare(spark, run, sql)


@pytest.mark.parametrize("name", [n for n in registry.ALL if not registry.ALL[n][1]])
def test_runs(spark, name):
    assert registry.ALL[name][0](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 10
    assert "percentile" in df.columns


def test_every_registered_query_has_a_name_of_its_own():
    assert set(registry.ALL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
