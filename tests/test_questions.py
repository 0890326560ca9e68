"""The meaning of each question, on tables small enough to work out by hand."""

from __future__ import annotations

import pytest

from broadsheet.plans import circulation, digital, revenue

SALES = (
    "edition_id string, City_ID string, State string, Copies_Sold long, copies_returned long, "
    "Net_Circulation long, year int, month_num int"
)
CITIES = "city_id string, city string, state string, tier string"
ADS = "edition_id string, ad_category string, ad_revenue double, ad_revenue_inr double, year int"
READINESS = (
    "city_id string, year int, quarter_num int, literacy_rate double, "
    "smartphone_penetration double, internet_penetration double"
)
PILOT = "city_id string, users_reached long, downloads_or_accesses long"


@pytest.fixture
def sales(table):
    def build(*rows):
        """(edition, city, sold, returned, net, year, month)."""
        return table(SALES, *[(e, c, "S", s, r, n, y, m) for e, c, s, r, n, y, m in rows])

    return build


@pytest.fixture
def cities(table):
    return table(CITIES, *[(f"C{i}", f"City {i}", "S", "Tier 1") for i in range(1, 9)])


def net_by_year(city: str, *nets: tuple[int, int]):
    return [(f"E-{city}", city, 100, 0, net, year, 1) for year, net in nets]


def test_trend_compares_with_the_row_before_even_across_a_gap(sales, rows):
    result = rows(
        circulation.state_trend(
            {"print_sales": sales(("E", "C1", 200, 0, 10, 2019, 1), ("E", "C1", 230, 8, 30, 2021, 1))}
        )
    )
    assert result == [
        (2019, "S", 200, 0, 10, None, None, None),
        (2021, "S", 230, 8, 30, 15.0, None, 200.0),
    ]


def test_trend_rounds_ties_away_from_zero_and_keeps_to_its_years(sales, rows):
    result = rows(
        circulation.state_trend(
            {
                "print_sales": sales(
                    ("E", "C1", 1, 0, 1, 2018, 1),
                    ("E", "C1", 20000, 1, 1, 2019, 1),
                    ("E", "C1", 20001, 1, 1, 2020, 1),
                    ("E", "C1", 9, 0, 1, 2025, 1),
                )
            }
        )
    )
    assert [(r[0], r[5]) for r in result] == [(2019, None), (2020, 0.01)]


def test_contribution_bands_read_the_rounded_percentage(sales, cities, table, rows):
    figures = table(READINESS, *[(f"C{i}", 2024, 1, 50.0, 60.0, 70.0) for i in range(1, 5)])
    result = circulation.city_contribution(
        {
            "print_sales": sales(
                ("E", "C1", 20000, 1999, 5, 2024, 1),  # 9.995 -> 10.0
                ("E", "C2", 100, 9, 5, 2024, 1),
                ("E", "C3", 0, 5, 5, 2024, 1),  # no percentage
                ("E", "C5", 100, 0, 5, 2024, 1),  # no readiness
                ("E", "C4", 100, 30, 5, 2023, 1),  # another year
            ),
            "city_data": cities,
            "city_readiness": figures,
        }
    )
    bands = {r["city"]: (r["Return_Percent"], r["Profitable_Category"]) for r in result.collect()}
    assert bands == {
        "City 1": (10.0, "Moderately Profitable"),
        "City 2": (9.0, "Highly Profitable"),
        "City 3": (None, "Needs Review"),
    }


def test_contribution_averages_the_quarters_of_the_year(sales, cities, table):
    figures = table(
        READINESS,
        ("C1", 2024, 1, 50.0, 1.0, 74.30),
        ("C1", 2024, 2, 51.0, 1.0, 76.16),
        ("C1", 2024, 3, None, 1.0, 75.04),
        ("C1", 2024, 4, 53.0, 1.0, 75.28),
        ("C1", 2023, 4, 99.0, 9.0, 99.0),
    )
    row = circulation.city_contribution(
        {
            "print_sales": sales(("E", "C1", 10, 1, 9, 2024, 1)),
            "city_data": cities,
            "city_readiness": figures,
        }
    ).first()
    # 75.195 is below the tie as a double, and doubles are rounded as such.
    assert (row.literacy_rate, row.internet_penetration) == (51.33, 75.19)


def ads_by_year(table, **amounts):
    rows = []
    for category, values in amounts.items():
        for year, value in zip(range(2019, 2025), values):
            if value is not None:
                rows.append(("E", category, float(value), float(value), year))
    return {
        "ad_revenue": table(ADS, *rows),
        "ad_category": table(
            "ad_category_id string, standard_ad_category string", *[(c, c) for c in amounts]
        ),
    }


def strength(table, **amounts):
    result = revenue.category_strength(ads_by_year(table, **amounts)).collect()
    return {r["standard_ad_category"]: r for r in result}


def test_strength_scores(table):
    scored = strength(
        table,
        rising=[100, 110, 120, 130, 140, 150],
        dipping=[100, 100, 90, 80, 120, 110],
        falling=[100, 90, 80, 70, 60, 50],
    )
    rising, dipping, falling = scored["rising"], scored["dipping"], scored["falling"]
    assert (rising.net_growth_percent, rising.consistency_score) == (50.0, 5)
    assert (rising.peak_timing_score, rising.recovery_score) == (1.0, 0.6)
    assert rising.total_strength_score == 30 + 30 + 20 + 12
    assert rising.final_verdict == "STRONG: Sustained Growth"
    assert (dipping.peak_timing_score, dipping.recovery_score) == (0.8, 1.0)
    assert dipping.total_strength_score == 20 + 6 + 16 + 20
    assert falling.total_strength_score == 0 + 0 + 8 + 12
    assert falling.final_verdict == "DECLINING: Needs Intervention"


def test_strength_without_a_year_has_no_peak_and_no_growth(table):
    scored = strength(table, gap=[100, None, 120, 130, 140, 150], late=[None, 90, 95, 96, 97, 98])
    assert scored["gap"].peak_timing_score == 0.4
    assert scored["gap"].consistency_score == 3
    assert scored["late"].net_growth_percent is None
    assert scored["late"].total_strength_score == 0 + 24 + 8 + 12


def test_strength_needs_years_for_the_recovery(table):
    with pytest.raises(ValueError):
        revenue.category_strength(ads_by_year(table, a=[1, 2, 3, 4, 5, 6]), 2022, 2024)


def test_strength_of_three_years_more(table):
    tables = ads_by_year(table, a=[1, 2, 3, 4, 5, 6])
    columns = revenue.category_strength(tables, 2020, 2023).columns
    assert columns[:5] == ["standard_ad_category"] + [f"revenue_{y}" for y in range(2020, 2024)]


def test_revenue_by_city_merges_names_and_repeats_shared_editions(sales, table, rows):
    result = revenue.revenue_by_city(
        {
            "city_data": table(
                CITIES, ("C1", "Twin", "S", "t"), ("C2", "Twin", "S", "t"), ("C3", "Lone", "S", "t")
            ),
            "print_sales": sales(
                ("E1", "C1", 1, 0, 10, 2019, 1),
                ("E1", "C2", 1, 0, 20, 2020, 1),
                ("E1", "C3", 1, 0, 0, 2020, 1),
                ("E2", "C3", 1, 0, 99, 2020, 1),  # sells no ads
            ),
            "ad_revenue": table(
                ADS, ("E1", "A", 1.0, 100.25, 2019), ("E1", "A", 1.0, 100.25, 2023)
            ),
        }
    )
    assert rows(result) == [("Twin", "S", 401.0, 30, 13.37), ("Lone", "S", 200.5, 0, None)]


def readiness_of(table, **scores):
    return table(READINESS, *[(c, 2021, 1, s, s, s) for c, s in scores.items()])


def test_unengaged_cities_are_strictly_beyond_the_means_of_all(cities, table, rows):
    tables = {
        "city_data": cities,
        # C9 is in no other table, but counts for the mean of 50.
        "city_readiness": readiness_of(table, C1=60.0, C2=55.0, C3=50.0, C9=35.0),
        # C8 has no readiness, but counts for the mean of 100.
        "digital_plot": table(PILOT, ("C1", 40, 10), ("C2", 50, 50), ("C3", 5, 5), ("C8", 200, 40)),
    }
    assert rows(digital.ready_but_unengaged(tables)) == [("City 1", "S", 60.0, 50)]


def test_rows_with_a_missing_rate_or_count_do_not_score(table, rows):
    figures = table(
        READINESS,
        ("C1", 2021, 1, 30.0, 30.0, 30.0),
        ("C1", 2021, 2, 90.0, None, 90.0),
        ("C2", 2021, 1, None, 1.0, 1.0),
    )
    assert sorted(rows(digital.readiness_scores(figures))) == [("C1", 30.0), ("C2", None)]
    pilot = table(PILOT, ("C1", 1, 2), ("C1", 10, None))
    assert rows(digital.engagement_scores(pilot)) == [("C1", 3)]


def ratio_tables(sales, cities, table):
    return {
        "city_data": cities,
        "print_sales": sales(
            ("E1", "C1", 1, 0, 10, 2019, 1),
            ("E1", "C1", 1, 0, 30, 2019, 2),
            ("E2", "C1", 1, 0, 60, 2019, 1),
            ("E1", "C1", 1, 0, -5, 2020, 1),  # no circulation: the year is left out
            ("E1", "C1", 1, 0, 10, 2021, 1),
            ("E1", "C1", 1, 0, 10, 2022, 1),
            ("E1", "C1", 1, 0, 10, 2023, 1),
        ),
        "ad_revenue": table(
            ADS,
            ("E1", "A", 0.0, 100.0, 2019),
            ("E2", "A", 0.0, 70.0, 2019),
            ("E2", "A", 0.0, 50.0, 2019),
            ("E2", "A", 0.0, 80.0, 2019),
            ("E1", "A", 0.0, 70.0, 2020),
            ("E1", "A", 0.0, 20.0, 2021),
            ("E1", "A", 0.0, 20.0, 2022),
            ("E1", "A", 0.0, 10.0, 2023),
        ),
    }


def test_revenue_per_copy_weighs_by_the_joined_rows(sales, cities, table, rows):
    # 2019: revenue 100 x 2 print rows + 200 x 1; circulation 40 x 1 ad row + 60 x 3.
    result = rows(revenue.revenue_per_copy(ratio_tables(sales, cities, table)))
    assert result == [
        ("City 1", 2023, 1.0, 2.0, -50.0, "Worsening (Tighter Margin)"),
        ("City 1", 2022, 2.0, 2.0, 0.0, "Stable"),
        ("City 1", 2021, 2.0, 1.8182, 10.0, "Improving (Wider Margin)"),
        ("City 1", 2019, 1.8182, None, None, "No Prior Year Data"),
    ]


def test_revenue_per_copy_with_every_row_once(sales, cities, table, rows):
    result = rows(revenue.revenue_per_copy(ratio_tables(sales, cities, table), fanout=False))
    assert result[-1] == ("City 1", 2019, 3.0, None, None, "No Prior Year Data")


def priority_tables(sales, table, n=10):
    ids = [f"C{i:02}" for i in range(n)]
    return {
        "city_data": table(CITIES, *[(c, f"City {c}", "S", "Tier 1") for c in ids]),
        "city_readiness": table(READINESS, *[(c, 2021, 1, float(50 + i % 4), 50.0, 50.0) for i, c in enumerate(ids)]),
        "digital_plot": table(PILOT, *[(c, 10 + i // 3, 0) for i, c in enumerate(ids)]),
        "print_sales": sales(
            *[row for i, c in enumerate(ids) for row in net_by_year(c, (2019, 100), (2020, 100 - i % 5))]
        ),
    }


def test_priority_quartiles_do_not_depend_on_partitions(sales, table, rows):
    tables = priority_tables(sales, table)
    answer = rows(digital.relaunch_priority(tables))
    assert len(answer) == 10
    split = {name: df.repartition(5) for name, df in tables.items()}
    assert rows(digital.relaunch_priority(split)) == answer


def test_priority_lists_high_scores_first_unless_asked(sales, table):
    tables = priority_tables(sales, table)
    scores = [r.Prioritization_Score for r in digital.relaunch_priority(tables).collect()]
    assert scores == sorted(scores, reverse=True)
    best = digital.relaunch_priority(tables, order="best_first", limit=3).collect()
    assert [r.Prioritization_Score for r in best] == sorted(scores)[:3]
    with pytest.raises(ValueError):
        digital.relaunch_priority(tables, order="worst_first")


def test_decline_rate_averages_growth_too(sales, rows):
    result = digital.decline_rates(sales(*net_by_year("C1", (2019, 100), (2020, 150), (2022, 75), (2023, 0), (2024, 5))))
    assert rows(result) == [("C1", -33.33333333)]


def test_falls_are_against_the_previous_row_and_cut_at_k(sales, cities, rows):
    result = circulation.sharpest_falls(
        {
            "city_data": cities,
            "print_sales": sales(
                ("E", "C1", 1, 0, 100, 2019, 11),
                ("E", "C1", 1, 0, 50, 2020, 2),  # -50 against November
                ("E", "C1", 1, 0, 50, 2020, 3),  # no fall
                ("E", "C2", 1, 0, 10, 2019, 1),
                ("E", "C2", 1, 0, 5, 2019, 2),  # -50, the same
                ("E", "C2", 1, 0, 0, 2019, 3),  # -100
                ("E", "C2", 1, 0, -1, 2019, 4),  # below zero from zero: no percentage, sorts first
                ("E", "C3", 1, 0, 4, 2019, 1),
                ("E", "C3", 1, 0, 2, 2019, 2),  # -50, the third one
            ),
        }
    )
    assert rows(result) == [
        ("City 2", 2019, "2019-04", -1, None),
        ("City 2", 2019, "2019-03", 0, -100.0),
        ("City 1", 2020, "2020-02", 50, -50.0),
    ]


def test_efficiency_ranks_before_the_city_join_and_keeps_ties(sales, cities, rows):
    result = circulation.print_efficiency(
        {
            "city_data": cities,
            "print_sales": sales(
                ("E", "C0", 100, 0, 100, 2024, 1),  # unknown city, rank 1
                ("E", "C1", 90, 10, 80, 2024, 1),
                ("E", "C2", 45, 5, 40, 2024, 1),
                ("E", "C3", 9, 1, 8, 2024, 1),
                ("E", "C4", 18, 2, 16, 2024, 1),
                ("E", "C5", 180, 20, 160, 2024, 1),
                ("E", "C6", 50, 50, 1, 2024, 1),  # rank 7
                ("E", "C7", 0, 0, 0, 2024, 1),  # nothing printed
            ),
        }
    )
    assert [(r[0], r[3], r[4]) for r in rows(result)] == [
        (f"City {i}", 0.8, 2) for i in range(1, 6)
    ]


def test_growth_needs_both_rows_but_not_both_values(cities, table, rows):
    figures = table(
        READINESS,
        ("C1", 2021, 1, 1.0, 1.0, 50.41),
        ("C1", 2021, 4, 1.0, 1.0, 48.68),
        ("C2", 2021, 1, 1.0, 1.0, None),
        ("C2", 2021, 4, 1.0, 1.0, 10.0),
        ("C3", 2021, 1, 1.0, 1.0, 10.0),
        ("C4", 2020, 1, 1.0, 1.0, 10.0),
        ("C4", 2021, 4, 1.0, 1.0, 10.0),
    )
    result = digital.internet_growth({"city_readiness": figures, "city_data": cities})
    assert rows(result) == [("City 1", 50.41, 48.68, -1.73), ("City 2", None, 10.0, None)]


def test_declines_start_after_the_first_flagged_year(sales, cities, table, rows):
    tables = {
        "city_data": cities,
        "print_sales": sales(
            *net_by_year("C1", (2019, 500), (2020, 400), (2021, 300), (2022, 200), (2023, 100), (2024, 50), (2025, 1)),
            *net_by_year("C2", (2020, 10), (2021, 20)),
            *net_by_year("C3", (2020, 10), (2021, 9)),
        ),
        "ad_revenue": table(
            ADS, *[(f"E-C{c}", "A", 1.0, 10.0 + y, y) for c in (1, 2, 3) for y in range(2019, 2026)]
        ),
    }
    assert rows(revenue.frequent_declines(tables)) == [
        ("City 1", 4, 0, 4),
        ("City 3", 1, 0, 1),
        ("City 2", 0, 0, 0),
    ]
    assert len(rows(revenue.frequent_declines(tables, k=2))) == 2


def test_a_changing_row_count_is_a_decline_only_with_the_fanout(sales, cities, table, rows):
    tables = {
        "city_data": cities,
        "print_sales": sales(*net_by_year("C1", (2020, 10), (2021, 10))),
        "ad_revenue": table(
            ADS, ("E-C1", "A", 1.0, 5.0, 2020), ("E-C1", "A", 1.0, 5.0, 2020), ("E-C1", "A", 1.0, 10.0, 2021)
        ),
    }
    assert rows(revenue.frequent_declines(tables)) == [("City 1", 1, 0, 1)]
    assert rows(revenue.frequent_declines(tables, fanout=False)) == [("City 1", 0, 0, 0)]


def test_duplicate_dimension_rows_multiply_as_in_the_join(sales, table, rows):
    tables = {
        "city_data": table(CITIES, ("C1", "City 1", "S", "t"), ("C1", "City 1", "S", "t")),
        "print_sales": sales(("E", "C1", 1, 0, 10, 2019, 1), ("E", "C1", 1, 0, 4, 2019, 2)),
    }
    assert rows(circulation.sharpest_falls(tables)) == [("City 1", 2019, "2019-02", 8, -60.0)]


def test_results_do_not_depend_on_order_or_partitions(sales, cities, table, rows):
    tables = ratio_tables(sales, cities, table)
    expected = rows(revenue.revenue_per_copy(tables))
    for n in (1, 7):
        mixed = {k: v.repartition(n).orderBy("year") if "year" in v.columns else v.repartition(n) for k, v in tables.items()}
        assert rows(revenue.revenue_per_copy(mixed)) == expected
