"""The sliced join against a plain one, and how evenly its rows lie."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from broadsheet import operators


@pytest.fixture
def sides(table):
    """A fact with half of its rows on one key, null keys and repeated rows; a dimension with lone,
    null and repeated keys."""
    rng = random.Random(11)
    keys = [rng.choice(["hot", "hot", "a", "b", None, "none"]) for _ in range(600)]
    fact = [(k, rng.choice([1, 2]), i % 40) for i, k in enumerate(keys)]
    fact += [("hot", 1, 7)] * 5
    dimension = [("hot", 1, "x"), ("hot", 1, "x"), ("hot", 2, "y"), ("a", 1, "z"), ("b", 2, None), (None, 1, "n"), ("c", 1, "w")]
    return table("k string, y int, v int", *fact), table("k string, y int, name string", *dimension)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("rows_per_slice", [1, 7, 50, 10_000])
def test_rows_are_those_of_a_join(sides, rows, how, rows_per_slice):
    fact, dimension = sides
    found = operators.sliced_join(fact, dimension, ["k", "y"], how, rows_per_slice)
    wanted = fact.join(dimension, ["k", "y"], how)
    assert found.columns == wanted.columns
    assert sorted(rows(found), key=str) == sorted(rows(wanted), key=str)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_more_heavy_keys_than_may_be_cut(sides, rows, how, monkeypatch):
    monkeypatch.setattr("broadsheet.operators.skew._MOST_HEAVY", 2)
    fact, dimension = sides
    found = operators.sliced_join(fact, dimension, ["k", "y"], how, 3)
    assert sorted(rows(found), key=str) == sorted(rows(fact.join(dimension, ["k", "y"], how)), key=str)


def test_empty_sides(sides, rows):
    fact, dimension = sides
    assert rows(operators.sliced_join(fact.limit(0), dimension, ["k", "y"])) == []
    assert rows(operators.sliced_join(fact, dimension.limit(0), ["k", "y"])) == []
    left = operators.sliced_join(fact, dimension.limit(0), ["k", "y"], "left", 5)
    assert left.count() == fact.count() and left.where("name is not null").isEmpty()


def test_clashing_names_and_other_joins_are_refused(sides):
    fact, dimension = sides
    with pytest.raises(ValueError, match="both sides"):
        operators.sliced_join(fact, dimension.withColumn("v", F.lit(1)), ["k", "y"])
    with pytest.raises(ValueError, match="inner or left"):
        operators.sliced_join(fact, dimension, ["k", "y"], "full")


@pytest.fixture
def shuffled(spark):
    """Neither broadcasts nor adaptive changes, so that partitions are those of the join."""
    wanted = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("hot", ["0", "null"])
def test_no_task_holds_a_hot_key(shuffled, hot):
    key = F.expr(f"CASE WHEN id % 2 = 0 THEN {hot} ELSE id % 1000 END").cast("long")
    fact = shuffled.range(40_000).select("id", key.alias("k"))
    dimension = shuffled.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("double"))

    def largest(joined):
        held = joined.groupBy(F.spark_partition_id().alias("p")).count()
        counts = sorted(r["count"] for r in held.collect())
        return counts[-1] / counts[len(counts) // 2]

    assert largest(fact.join(dimension, "k", "left")) > 4
    assert largest(operators.sliced_join(fact, dimension, ["k"], "left", rows_per_slice=200)) < 1.5
