"""Operators against brute force, with hot keys, ties, nulls and changing partition counts."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet import operators
from broadsheet.functions import money_sum
from broadsheet.operators.ordering import exact_quantiles, quantile_search
from broadsheet.operators.profiling import row_digest


# ---- fan-out sums ---------------------------------------------------------------------------


@pytest.fixture
def facts(table):
    """Two facts on (k, y): a third of all rows on one key, null keys, null values, lone keys."""
    rng = random.Random(5)

    def key():
        return "hot" if rng.random() < 0.34 else rng.choice(["a", "b", "c", None])

    left = [(key(), rng.randint(1, 2), rng.choice("xyz"), rng.choice([None, 1, 2, 70])) for _ in range(400)]
    right = [(key(), rng.randint(1, 3), rng.choice([None, 0.25, 19.99, 1e6])) for _ in range(300)]
    left.append(("left only", 1, "x", 1))
    left += [("no values", 1, "n", None)]
    right += [("no values", 1, None)] * 2
    return (
        table("k string, y int, g string, net long", *left),
        table("k string, y int, amount double", *right),
    )


def test_fanout_sums_equal_the_plain_join(facts, rows):
    left, right = facts
    plain = (
        left.join(right, ["k", "y"])
        .groupBy("g", "y")
        .agg(F.sum("net").alias("net"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("amount"))
    )
    fast = operators.fanout_sums(
        left, right, ["k", "y"], ["g", "y"], {"net": F.sum("net")}, {"amount": money_sum("amount")}
    )
    assert sorted(rows(fast), key=str) == sorted(rows(plain), key=str)
    assert ("n", 1, None, None) in rows(fast)


def test_fanout_sums_with_every_row_once(facts, rows):
    left, right = facts
    once = operators.fanout_sums(
        left.where("k = 'hot'"), right.where("k = 'hot'"), ["k", "y"], ["y"],
        {"net": F.sum("net")}, {"amount": money_sum("amount")}, multiply=False,
    ).select("y", F.col("net").cast("long"))
    expected = left.where("k = 'hot'").groupBy("y").agg(F.sum("net"))
    assert sorted(rows(once)) == sorted(rows(expected))


# ---- forward fill -----------------------------------------------------------------------------


def filled_by_hand(rows):
    """rows: (key, order, value)."""
    last, result = defaultdict(lambda: None), []
    for key, order, value in sorted(rows, key=lambda r: r[1]):
        last[key] = value if value is not None else last[key]
        result.append((key, order, last[key]))
    return sorted(result, key=str)


SPREADS = {
    "dense": range(300),
    "wide": [i * (1 << 18) for i in range(300)],
    "sparse": [(-1) ** i * i * (1 << 45) + i for i in range(300)],
    "clustered": [*range(100), *range(1 << 40, (1 << 40) + 100), *range(-(1 << 62), -(1 << 62) + 100)],
}


@pytest.mark.parametrize("spread", SPREADS)
@pytest.mark.parametrize("keyed", [False, True])
def test_forward_fill(table, rows, spread, keyed):
    rng = random.Random(len(spread))
    data = [
        (
            rng.choice(["hot", "hot", "a", "b", None]) if keyed else "one",
            order,
            f"v{i}" if rng.random() < 0.1 and i > 5 else None,
        )
        for i, order in enumerate(SPREADS[spread])
    ]
    expected = filled_by_hand(data)
    rng.shuffle(data)
    for partitions in (1, 5):
        df = table("key string, row_id long, value string", *data).repartition(partitions)
        result = operators.forward_fill(df, "value", "row_id", ["key"] if keyed else None)
        assert result.columns == df.columns
        assert sorted(rows(result), key=str) == expected


def test_forward_fill_equals_the_one_task_window(table, rows):
    df = table("row_id long, v int, w int", *[(i, i if i % 7 == 3 else None, i) for i in range(200)])
    one_task = F.last("v", ignorenulls=True).over(Window.orderBy("row_id"))
    assert sorted(rows(operators.forward_fill(df, "v", "row_id")), key=str) == sorted(
        rows(df.withColumn("v", one_task)), key=str
    )


def test_forward_fill_refuses_to_guess_the_order(table):
    df = table("a int, v string, row_id long", (1, None, None), (2, "x", 3))
    with pytest.raises(ValueError):
        operators.forward_fill(df, "v", "position")
    with pytest.raises(TypeError):
        operators.forward_fill(df, "a", "v")
    with pytest.raises(Exception, match="row_id is null"):
        operators.forward_fill(df, "v", "row_id").collect()
    twice = table("v string, row_id long", ("a", 0), (None, 0), (None, 1), ("b", 1))
    with pytest.raises(Exception, match="row_id is not unique"):
        operators.forward_fill(twice, "v", "row_id").select("v").collect()


# ---- global order -------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 3, 4, 10, 11, 25])
def test_ntile_equals_the_builtin(table, rows, n):
    df = table("id int, v int", *[(i, i * 7 % 5) for i in range(n)]).repartition(3)
    order = [F.desc("v"), F.asc("id")]
    expected = df.withColumn("tile", F.ntile(4).over(Window.orderBy(*order)))
    result = rows(operators.global_ntile(df, 4, order, "tile"))
    assert sorted(result) == sorted(rows(expected))
    sizes = [sum(r[2] == t for r in result) for t in range(1, 5)]
    assert max(sizes) - min(sizes) <= 1


def test_row_number_with_a_hot_value_and_nulls(table, rows):
    df = table("id int, v double", *[(i, 5.0 if i % 3 else None if i % 2 else float(i)) for i in range(500)])
    order = [F.asc("v"), F.asc("id")]
    expected = df.withColumn("n", F.row_number().over(Window.orderBy(*order)).cast("long"))
    assert sorted(rows(operators.global_row_number(df.repartition(6), order, "n")), key=str) == sorted(
        rows(expected), key=str
    )


def test_running_total_per_group(table, rows):
    data = [("hot" if i % 3 else f"k{i % 4}", i, i * i % 11) for i in range(200)]
    df = table("k string, i int, w int", *data).repartition(5)
    window = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    expected = df.withColumn("s", F.sum("w").over(window)).withColumn(
        "all", F.sum("w").over(Window.partitionBy("k"))
    )
    result = operators.running_total(df, "w", ["i"], "s", by=["k"], total="all")
    assert sorted(rows(result)) == sorted(rows(expected))


@pytest.mark.parametrize("k", [1, 2, 5, 1000])
def test_rank_at_most_equals_rank_and_keeps_hot_ties(table, rows, k):
    values = [9] * 40 + [8, 8, 7] + list(range(6)) + [None]
    df = table("id int, v int", *enumerate(values)).repartition(4)
    expected = df.withColumn("r", F.rank().over(Window.orderBy(F.desc("v")))).where(F.col("r") <= k)
    assert sorted(rows(operators.rank_at_most(df, "v", k, "r")), key=str) == sorted(
        rows(expected), key=str
    )


def test_quantiles_interpolate(table, rows):
    df = table("a double, b int", *[(v, i) for i, v in enumerate([4.0, 1.0, 2.0, 3.0, None, math.nan])])
    points = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "max": 1.0}
    assert sorted(rows(exact_quantiles(df, ["a", "b"], points))) == [
        ("a", 1.75, 2.5, 3.25, 4.0),
        ("b", 1.25, 2.5, 3.75, 5.0),
    ]


def test_quantiles_with_a_hot_value(table, rows):
    values = [float(i) for i in range(100)] + [7.0] * 60
    df = table("a double", *[(v,) for v in values]).repartition(6)
    expected = df.select(F.percentile("a", F.array(*map(F.lit, [0.1, 0.5, 0.9])))).first()[0]
    found = rows(exact_quantiles(df, ["a"], {"x": 0.1, "y": 0.5, "z": 0.9}))[0][1:]
    assert found == pytest.approx(expected)


@pytest.mark.parametrize("parts", [1, 5])
def test_several_ntiles_from_one_order(table, rows, parts):
    data = [(i, None if i % 11 == 0 else float(i * 7 % 13), 2**60 + i % 5) for i in range(101)]
    df = table("id int, a double, b long", *data).repartition(parts)
    orders = {"x": ("a", False), "y": ("b", True), "z": ("a", True)}
    keys = {"x": F.desc("a"), "y": F.asc("b"), "z": F.asc("a")}
    expected = df.select("id", *[F.ntile(4).over(Window.orderBy(k, "id")).alias(n) for n, k in keys.items()])
    assert sorted(rows(operators.global_ntiles(df, 4, "id", orders))) == sorted(rows(expected))


def test_quantiles_do_not_depend_on_the_bracket(table, rows):
    df = table("a double", *[(float(i * 37 % 1009),) for i in range(1009)]).repartition(6)
    points = {"low": 0.0, "x": 0.123, "p50": 0.5, "z": 0.999, "high": 1.0}
    expected = [df.select(F.percentile("a", p)).first()[0] for p in points.values()]
    for accuracy in (20, 100, 20_000):
        assert rows(exact_quantiles(df, ["a"], points, accuracy))[0][1:] == pytest.approx(expected)


@pytest.mark.parametrize(("accuracy", "most", "grid"), [(20, 5, 40), (200, 1, 100), (20_000, 10_000, 1000)])
def test_quantiles_by_repeated_bracketing(table, spark, accuracy, most, grid):
    """Narrowing in many passes, over ties, signed zeros, infinities and columns without values."""
    rng = random.Random(accuracy)
    rows = [
        (
            rng.choice([0.0, -0.0, 1.5, 1.5, 2.0, math.inf, -math.inf, math.nan, None]),
            rng.gauss(0, 1) if i % 3 else 0.25,
            i // 100,
            None,
        )
        for i in range(700)
    ]
    df = table("ties double, mixed double, steps int, none double", *rows).repartition(5)
    points = {"low": 0.0, "a": 0.1, "p50": 0.5, "b": 0.777, "high": 1.0}
    found, row = quantile_search(df, df.columns, points, [F.count(F.lit(1)).alias("n")], accuracy, most, grid)
    assert row["n"] == 700 and set(found["none"].values()) == {None}
    for c in ("ties", "mixed", "steps"):
        held = sorted(float(r[c]) for r in df.collect() if r[c] is not None and not math.isnan(r[c]))
        for name, p in points.items():
            at = (len(held) - 1) * p
            low, high = held[math.floor(at)], held[math.ceil(at)]
            expected = low if low == high else low + (high - low) * (at - math.floor(at))
            assert found[c][name] == pytest.approx(expected, nan_ok=True)


def test_quantiles_gather_no_rows(spark, sf_dir):
    """Every pass is an aggregation to one row; the result is a relation of the plan."""
    from broadsheet import catalogue

    df = catalogue.QUERIES["d5_numeric_profile"](spark, sf_dir)
    text = df._jdf.queryExecution().toString()
    assert "Window" not in text and "Exchange" not in text


# ---- quality ------------------------------------------------------------------------------------


def test_forged_digests_are_compared_whole(messy, table, rows):
    same = lambda df: F.struct(F.lit(1).alias("x"), F.lit(2).alias("y"))
    assert rows(operators.duplicate_rows(messy, "t", same)) == [("t", 2)]
    apart = table("a int, b double, c string", (None, 1.0, "x"), (1, None, "x"), (None, None, None), (None, 0.0, "x"), (None, -0.0, "x"))
    assert rows(operators.duplicate_rows(apart, "t", same)) == rows(operators.duplicate_rows(apart, "t")) == [("t", 1)]


def test_digests_are_all_that_is_shuffled_first(messy):
    counts = messy.withColumn("_digest", row_digest(messy)).groupBy("_digest").count()
    text = counts._jdf.queryExecution().toString()
    assert dict(counts.dtypes)["_digest"] == "struct<x:bigint,y:bigint>" and "hashpartitioning(_digest" in text


def test_top_values_by_hash(table, rows):
    df = table("a string, b string, c string", ("x", "q", None), ("x", "p", None), ("y", "r", None), ("y", "", None), ("", "s", None))
    assert sorted(rows(operators.categorical_profile(df, "t"))) == [("t", "a", 5, 3, "x", 2), ("t", "b", 5, 5, "", 1)]
    assert rows(operators.categorical_profile(table("a int", (1,)), "t")) == []


@pytest.fixture
def messy(table):
    return table(
        "id int, score double, name string",
        (1, 1.0, "b"),
        (2, math.nan, "a"),
        (2, math.nan, "a"),
        (3, None, None),
        (3, None, None),
        (4, 3.0, "b"),
    )


def test_null_counts_include_nan(messy, rows):
    assert rows(operators.null_counts(messy, "t")) == [
        ("t", "id", 0), ("t", "score", 4), ("t", "name", 2),
    ]


def test_duplicates_take_nulls_as_equal(messy, table, rows):
    assert rows(operators.duplicate_rows(messy, "t")) == [("t", 2)]
    assert rows(operators.duplicate_rows(table("a int"), "t")) == [("t", 0)]


def test_shape_and_types(messy, rows):
    assert rows(operators.shape(messy, "t")) == [("t", 6, 3)]
    assert rows(operators.column_types(messy, "t"))[1] == ("t", "score", "double", 6)


def test_numeric_profile(messy):
    score = operators.numeric_profile(messy, "t").where("column = 'score'").first()
    assert (score["count"], score["mean"], score["min"], score["p50"], score["max"]) == (2, 2, 1, 2, 3)
    assert score["std"] == pytest.approx(2**0.5)
    approx = operators.numeric_profile(messy, "t", "approx").where("column = 'id'").first()
    assert (approx["count"], approx["max"]) == (6, 4)


def test_categorical_profile_takes_the_smallest_of_tied_values(messy, rows):
    assert rows(operators.categorical_profile(messy, "t")) == [("t", "name", 4, 2, "a", 2)]


def test_whole_profile_has_each_metric_once(messy):
    cells = operators.profile(messy, "t").collect()
    keys = [(c["column"], c["metric"]) for c in cells]
    assert len(keys) == len(set(keys)) == 3 + 2 * 3 + 2 * 8 + 4
    value = {k: c["value"] for k, c in zip(keys, cells)}
    assert value[(None, "rows")] == 6 and value[("score", "nulls")] == 4
    assert value[(None, "duplicates")] == 2


def test_profile_of_awkward_column_names(table):
    df = table("`Copies Sold` long, `a.b` string", (1, "x"), (3, "x"))
    cells = {(c["column"], c["metric"]): c for c in operators.profile(df, "t").collect()}
    assert cells[("Copies Sold", "p50")]["value"] == 2.0
    assert cells[("a.b", "top")]["text"] == "x"


# ---- looking at tables ---------------------------------------------------------------------------


def test_sample_is_seeded_and_sized(table, rows):
    df = table("a int", *[(i,) for i in range(50)])
    split = df.repartition(7)
    assert sorted(rows(operators.sample_rows(split, 10, seed=1))) == sorted(rows(operators.sample_rows(df.coalesce(1), 10, seed=1)))
    first = rows(operators.sample_rows(df, 10, seed=1))
    assert len(set(first)) == 10 and first == rows(operators.sample_rows(df, 10, seed=1))


def test_head_and_distinct(table, rows):
    df = table("row_id int, s string", (2, "x"), (0, None), (1, "x"))
    assert [r[0] for r in rows(operators.head(df, "row_id", 2))] == [0, 1]
    assert sorted(rows(operators.distinct_values(df, "s")), key=str) == [("x",), (None,)]


def test_case_insensitive_keys(table, rows):
    df = operators.case_insensitive(table("s string, n int", ("Delhi", 1), ("DELHI", 2), ("Pune", 4)), "s")
    other = operators.case_insensitive(table("s string", ("delhi",)), "s")
    assert sorted(r[0] for r in rows(df.groupBy("s").agg(F.sum("n")).select("sum(n)"))) == [3, 4]
    assert df.join(other, "s").count() == 2


def test_scratch_is_inside_the_shared_folder(spark):
    folder = operators.scratch_dir(spark, "x")
    assert folder.startswith(spark.sparkContext.getCheckpointDir())
    assert folder != operators.scratch_dir(spark, "x")
