"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest

from broadsheet import catalogue

QUESTIONS = [n for n in catalogue.QUERIES if re.match(r"[qk]\d+_", n)]


def plan(spark, sf_dir, name: str, final: bool = False) -> str:
    df = catalogue.QUERIES[name](spark, sf_dir)
    if final:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", QUESTIONS)
def test_no_python_and_no_cartesian_product(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    for operator in ("Python", "Arrow", "CartesianProduct", "LeftOuter"):
        assert operator not in text


@pytest.mark.parametrize(
    "name",
    ["q1_state_trend", "q2_city_contribution", "q9_print_efficiency", "q11_frequent_declines", "k2_circulation_change"],
)
def test_year_ranges_reach_the_scan(spark, sf_dir, name):
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_shipdate", plan(spark, sf_dir, name))


@pytest.mark.parametrize("name", ["q2_city_contribution", "q10_internet_growth"])
def test_year_ranges_reach_the_scan_of_readiness(spark, sf_dir, name):
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan(spark, sf_dir, name))


def test_years_follow_the_parameters():
    assert catalogue.years_of("q2_city_contribution", year=2023) == (2023, 2023)
    assert catalogue.years_of("q1_state_trend", first_year=2020) == (2020, 2024)
    assert catalogue.years_of("q8_sharpest_falls") is None
    assert catalogue.years_of("q7_relaunch_priority") is None


@pytest.mark.parametrize("name", ["w5_ntile", "w6_row_number"])
def test_global_order_moves_rows_once(spark, sf_dir, name):
    """After the checkpoint only the counts of partitions move."""
    text = plan(spark, sf_dir, name)
    assert "Window [row_number" not in text and "SortMergeJoin" not in text
    assert "rangepartitioning" not in text


def test_quantiles_need_no_checkpoint(spark, sf_dir):
    assert "Scan ExistingRDD" not in plan(spark, sf_dir, "d5_numeric_profile")


def test_columns_are_pruned_at_the_scan(spark, sf_dir):
    text = plan(spark, sf_dir, "q10_internet_growth")
    assert re.search(r"ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate", text)


@pytest.mark.parametrize("name", ["q8_sharpest_falls", "q11_frequent_declines", "w7_rank_at_most"])
def test_top_k_is_not_a_full_sort(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "TakeOrderedAndProject" in text
    assert "Exchange rangepartitioning" not in text


@pytest.mark.parametrize("name", ["q9_print_efficiency", "q5_ready_but_unengaged"])
def test_a_fact_used_twice_is_scanned_once(spark, sf_dir, name):
    text = plan(spark, sf_dir, name, final=True)
    assert "ReusedExchange" in text
    fact = "lineitem" if name.startswith("q9") else "orders"
    assert len(re.findall(rf"/{fact}\.parquet", text)) == 1


def test_facts_meet_only_after_their_own_aggregation(spark, sf_dir):
    """Between the scan of a fact and its first join there is an aggregation."""
    text = plan(spark, sf_dir, "q6_revenue_per_copy")
    lines = text.splitlines()
    for fact in ("l_suppkey", "o_custkey"):
        scan = max(i for i, line in enumerate(lines) if "FileScan" in line and f"{fact}:" in line)
        depth = lines[scan].index("FileScan")
        above = [l for l in lines[:scan] if re.search(r"\S", l) and len(l) - len(l.lstrip(" :+-|")) < depth]
        nearest = [l for l in reversed(above) if "Join" in l or "HashAggregate" in l]
        first = nearest[0]
        assert "HashAggregate" in first or "BroadcastNestedLoopJoin" in first  # the one-row count


def test_forward_fill_shuffles_rows_by_block(spark, sf_dir):
    text = plan(spark, sf_dir, "d7_forward_fill")
    assert text.count("SinglePartition") == 1  # at most 2**16 rows: one per 2**48 numbers
    assert "hashpartitioning(_block" in text and "Join" not in text


def test_plain_join_is_not_needed(spark, sf_dir):
    text = plan(spark, sf_dir, "j3_fanout_sums")
    assert "Window" not in text and "Generate" not in text
