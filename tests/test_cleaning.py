"""Reading quarters, currencies, dates and spellings, with the traps of each."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from broadsheet import functions as fn
from broadsheet import operators
from broadsheet.plans import cleaning
from broadsheet.schemas import CLEAN, RAW


@pytest.fixture
def column(table):
    """Apply a column expression to values: column(expr, 'string', values...)."""

    def build(expression, dtype: str, *values):
        df = table(f"i int, c {dtype}", *enumerate(values))
        return [r[0] for r in df.orderBy("i").select(expression).collect()]

    return build


QUARTERS = {
    "2023-Q2": (2023, 2),
    "Q1-2019": (2019, 1),
    "4th Qtr 2020": (2020, 4),
    "q3-2021": (2021, 3),
    "4TH  qtr 2020": (2020, 4),
    "1st Qtr 2020": (2020, None),
    "Qtr 2 2020": (2020, None),
    "Qtr2020": (2020, 2),
    "Q9": (None, 9),
    "none": (None, None),
    "": (None, None),
    None: (None, None),
}


def test_quarters(column):
    assert column(fn.quarter_year("c"), "string", *QUARTERS) == [y for y, _ in QUARTERS.values()]
    assert column(fn.quarter_number("c"), "string", *QUARTERS) == [q for _, q in QUARTERS.values()]


def test_tidy_strips_tabs_too(column):
    assert column(fn.tidy("c"), "string", " inr", "Usd\t", "\n in rupees ", "", None) == [
        "INR", "USD", "IN RUPEES", "", None,
    ]


def test_half_even(column):
    values = [3352118.445, 4172701.845, 0.125, 0.375, 2.5, -0.125, None]
    assert column(fn.half_even("c"), "double", *values) == [
        3352118.44, 4172701.84, 0.12, 0.38, 2.5, -0.12, None,
    ]


def test_rounded_takes_ties_as_decimals(column):
    assert column(fn.rounded("c", 2), "double", 485.03 / 14, -0.005, 1.004999, None) == [
        34.65, -0.01, 1.0, None,
    ]


def test_money_sum_is_exact_beyond_a_long(table, rows):
    huge = [(1, 90_000_000_000_000.25)] * 2000 + [(1, None), (2, -0.01), (2, 10.03), (3, None)]
    result = rows(table("k int, v double", *huge).groupBy("k").agg(fn.money_sum("v")).orderBy("k"))
    assert result == [(1, Decimal("180000000000000500.00")), (2, Decimal("10.02")), (3, None)]


def test_dates(column):
    texts = ["2021-01", "2021-01-31", "2021/03/02", "May-19", "Jun-2020", "2021-02-03 04:05:06",
             "2021-13", "January", "", None]
    assert column(fn.parse_date("c"), "string", *texts) == [
        dt.date(2021, 1, 1), dt.date(2021, 1, 31), dt.date(2021, 3, 2), dt.date(2019, 5, 1),
        dt.date(2020, 6, 1), dt.date(2021, 2, 3), None, None, None, None,
    ]


def test_month_key_ratio_and_change(table, rows):
    df = table("a int, b int", (5, 0), (5, 4), (None, 4), (5, None))
    result = rows(df.select(fn.month_key("a", "b"), fn.safe_ratio("a", "b"), fn.pct_change("a", "b")))
    assert result == [("5-00", None, None), ("5-04", 1.25, 25.0), (None, None, None), (None, None, None)]


def test_strict_greatest(table, rows):
    df = table("a int, b int, c int", (1, 3, 2), (None, 3, 2))
    assert rows(df.select(fn.strict_greatest("a", "b", "c"))) == [(3,), (None,)]


def test_band_takes_the_first_match_and_null_the_rest(column):
    steps = [("<", 10, "low"), ("<", 20, "mid")]
    assert column(fn.band("c", steps, "else"), "double", 9.9, 10.0, 20.0, None) == [
        "low", "mid", "else", "else",
    ]


AD_ROWS = [
    ("ED1005", "A001", "2023-Q2", 22613.69, "EUR", None, 2023, 2, 2338029.41),
    ("ED1005", "A002", "Q1-2019", 39366.88, " usd\t", "x", 2019, 1, 3469796.80),
    ("ED1001", "A003", "Q3-2023", 3709860.0, "in rupees", None, 2023, 3, 3709860.0),
    ("ED1007", "A003", "4th Qtr 2020", 40969.55, "USD", "", 2020, 4, 3611056.14),
    ("ED1007", "A003", "soon", 1.0, "GBP", None, None, None, None),
    ("ED1007", "A003", None, None, "USD", None, None, None, None),
]


def test_clean_ad_revenue(spark, rows):
    raw = spark.createDataFrame([r[:6] for r in AD_ROWS], RAW["ad_revenue"])
    clean = cleaning.clean_ad_revenue(raw)
    assert clean.dtypes == [(f.name, f.dataType.simpleString()) for f in CLEAN["ad_revenue"]]
    for before, after in zip(AD_ROWS, rows(clean)):
        assert after[6:] == before[6:]
        assert after[4] == before[4].strip().upper()
        assert after[5] == ("No Commensts" if before[5] is None else before[5])


def test_currency_by_mapping_and_by_table_agree(spark, table, rows):
    df = table("amount double, code string", (10.0, "A"), (0.125, "B"), (1.0, "C"), (1.0, None))
    rates = {"A": 2.0, "B": 1.0}
    by_mapping = operators.in_rupees(df, "amount", "code", "inr", rates)
    by_table = operators.in_rupees(
        df, "amount", "code", "inr", table("currency string, rate double", *rates.items())
    )
    expected = [(0.125, "B", 0.12), (1.0, "C", None), (1.0, None, None), (10.0, "A", 20.0)]
    assert sorted(rows(by_mapping), key=str) == sorted(rows(by_table), key=str) == expected


def test_clean_digital_plot(spark):
    base = ["web", "A001", 1, 2, 3, 4, 5.5]
    raw = spark.createDataFrame(
        [
            (i, base[0], month, *base[1:], said, "C001")
            for i, (month, said) in enumerate([("2021-01", None), ("2021-11", "good"), ("soon", None)])
        ],
        RAW["digital_plot"],
    )
    clean = cleaning.clean_digital_plot(raw)
    assert clean.dtypes == [(f.name, f.dataType.simpleString()) for f in CLEAN["digital_plot"]]
    got = clean.orderBy("row_id").select(
        "launch_month", "cumulative_feedback_from_customers", "launch_year", "launch_month_num",
        "launch_month_name", "launch_quarter",
    )
    assert [tuple(r) for r in got.collect()] == [
        ("2021-01", None, 2021, 1, "January", 1),
        ("2021-11", "good", 2021, 11, "November", 4),
        ("soon", "good", None, None, None, None),
    ]


def test_clean_print_sales(spark, rows):
    raw = spark.createDataFrame(
        [
            ("E1", "C1", "Uttar-Pradesh", "2019-05", 10, 1, 9),
            ("E1", "C1", "Uttar pradesh", "bad", 10, 1, 9),
            ("E1", "C1", "UTTAR PRADESH", None, 10, 1, 9),
        ],
        RAW["print_sales"],
    )
    clean = cleaning.clean_print_sales(raw)
    assert clean.dtypes == [(f.name, f.dataType.simpleString()) for f in CLEAN["print_sales"]]
    assert rows(clean) == [
        ("E1", "C1", "Uttar Pradesh", dt.date(2019, 5, 1), 10, 1, 9, 2019, 5, "May", 2),
        ("E1", "C1", "Uttar Pradesh", None, 10, 1, 9, None, None, None, None),
        ("E1", "C1", "UTTAR PRADESH", None, 10, 1, 9, None, None, None, None),
    ]


def test_clean_all_keeps_the_columns_of_dimensions(spark):
    tables = {name: spark.createDataFrame([], schema) for name, schema in RAW.items()}
    cleaned = cleaning.clean_all(tables)
    assert cleaned["city_data"].schema == tables["city_data"].schema
    for name, df in cleaned.items():
        assert df.columns == CLEAN[name].names


def test_cleaning_of_rows_is_narrow(spark):
    for name in ("ad_revenue", "city_readiness", "print_sales"):
        raw = spark.createDataFrame([], RAW[name])
        plan = cleaning.CLEANERS[name](raw)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan


def test_sums_round_no_row(table, rows):
    df = table("a double", *[(0.004,)] * 1000)
    total, mean = df.agg(fn.money_sum("a").alias("s"), fn.exact_mean("a").alias("m")).first()
    assert float(total) == 4.0 and mean == 0.004
    tiny = table("a double", (1e-7,), (3e-7,), (None,)).agg(fn.exact_mean("a").alias("m")).first()
    assert tiny.m == pytest.approx(2e-7)
    large = table("a double", *[(9e13 + 0.25,)] * 3).agg(fn.money_sum("a").alias("s")).first()
    assert float(large.s) == 27e13 + 0.75


def test_codes_are_the_same_in_any_case(table, rows):
    df = table("edition_id string, City_ID string, note string", (" ed1", "c001 ", "x"), (None, "C001", "y"))
    assert rows(cleaning.same_case(df)) == [("ED1", "C001", "x"), (None, "C001", "y")]
