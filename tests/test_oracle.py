"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from compare import differences, duck

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf_dir, connection, name):
    count, problems = differences(QUERIES[name](spark, sf_dir), connection, ORACLE[name])
    assert not problems
    assert count > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_sample_has_its_size(spark, sf_dir):
    assert QUERIES["d22_sample"](spark, sf_dir).count() == 10


def test_entry_runs(spark, sf_dir):
    assert entry.entry(spark).count() == 30
