"""The queries of the llm package against their SQL, and what the entry registers."""

import pytest

import __spark_entry__ as entry
from broadsheet.llm import oracle, queries
from compare import differences, duck


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_equals_sql(spark, sf_dir, name):
    count, problems = differences(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), oracle.ORACLE[name])
    assert not problems
    assert count > 0


def test_all_operators_and_the_pipeline_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(oracle.ORACLE) <= set(entry.oracle_sql())
