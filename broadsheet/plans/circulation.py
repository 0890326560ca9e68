"""Questions on print circulation.

Facts are summed on their own keys before they meet the city dimension, so what is joined has one
row per city and period, and the join adds no shuffle of facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import band, exact_mean, half_even, month_key, pct_change, rounded, safe_ratio, strict_sum
from ..operators import rank_at_most

Tables = dict[str, DataFrame]

# Share of copies returned, in percent, below which a city earns its label.
PROFITABILITY = [
    ("<", 10, "Highly Profitable"),
    ("<", 20, "Moderately Profitable"),
    ("<", 30, "Marginally Profitable"),
]
UNPROFITABLE = "Needs Review"


def with_city(sums: DataFrame, city_data: DataFrame, *columns: str) -> DataFrame:
    """Inner join of per-City_ID sums with the named columns of the city dimension."""
    cities = city_data.select("city_id", *columns).alias("c")
    keyed = sums.withColumnRenamed("City_ID", "_city").alias("s")
    return keyed.join(cities, F.col("s._city") == F.col("c.city_id")).drop("_city")


def sum_by(df: DataFrame, keys: list[str], **sums: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in sums.items()])


def state_trend(tables: Tables, first_year: int = 2019, last_year: int = 2024) -> DataFrame:
    """Q1: copies sold, returned and net per state and year, with year-over-year changes.

    Spellings of a state that differ in case are one state, under the spelling that sorts first.
    """
    measures = {"Sold": "Copies_Sold", "Returned": "Copies_Returned", "Net": "Net_Circulation"}
    yearly = (
        tables["print_sales"]
        .where(F.col("year").between(first_year, last_year))
        .groupBy("year", F.lower("State").alias("_state"))
        .agg(
            F.min("State").alias("State"),
            *[F.sum(c).alias(f"Total_{c}") for c in measures.values()],
        )
    )
    by_year = Window.partitionBy("_state").orderBy("year")
    changes = {
        f"YoY_{m}_Change_Percent": rounded(
            pct_change(f"Total_{c}", F.lag(f"Total_{c}").over(by_year)), 2
        )
        for m, c in measures.items()
    }
    # One spelling for all years.
    named = yearly.withColumn("State", F.min("State").over(Window.partitionBy("_state")))
    return named.withColumns(changes).drop("_state").orderBy("year", "State")


def city_contribution(tables: Tables, year: int = 2024) -> DataFrame:
    """Q2: copies per city in one year, with that year's readiness and a profitability band.

    Cities without readiness figures for the year are left out.
    """
    sales = sum_by(
        tables["print_sales"].where(F.col("year") == year),
        ["City_ID"],
        sold="Copies_Sold",
        returned="copies_returned",
        net="Net_Circulation",
    )
    cities = (
        with_city(sales, tables["city_data"], "city")
        .groupBy("city_id", "city")
        .agg(
            F.sum("sold").alias("Total_Copies_Sold"),
            F.sum("net").alias("Total_Net_Circulation"),
            rounded(safe_ratio(F.sum("returned") * 100, F.sum("sold")), 2).alias("Return_Percent"),
        )
    )
    rates = ["literacy_rate", "smartphone_penetration", "internet_penetration"]
    readiness = (
        tables["city_readiness"]
        .where(F.col("year") == year)
        .groupBy("city_id")
        .agg(*[half_even(exact_mean(r)).alias(r) for r in rates])
    )
    return (
        cities.join(readiness, "city_id")
        .select(
            "city",
            "Total_Copies_Sold",
            "Total_Net_Circulation",
            *rates,
            "Return_Percent",
            band("Return_Percent", PROFITABILITY, UNPROFITABLE).alias("Profitable_Category"),
        )
        .orderBy(F.desc("Total_Copies_Sold"), F.desc("Total_Net_Circulation"), "city")
    )


def sharpest_falls(
    tables: Tables, k: int = 3, first_year: int | None = None, last_year: int | None = None
) -> DataFrame:
    """Q8: the k city-months with the steepest fall of net circulation against the month before.

    The previous month is the city's previous row. All years count unless a range is given.
    """
    sales = tables["print_sales"]
    if first_year is not None:
        sales = sales.where(F.col("year") >= first_year)
    if last_year is not None:
        sales = sales.where(F.col("year") <= last_year)
    monthly = with_city(
        sum_by(sales, ["City_ID", "year", "month_num"], net="Net_Circulation"),
        tables["city_data"],
        "city",
    )
    monthly = sum_by(monthly, ["city_id", "city", "year", "month_num"], net_circulation="net")
    by_month = Window.partitionBy("city_id").orderBy("year", "month_num")
    falls = (
        monthly.withColumn("_previous", F.lag("net_circulation").over(by_month))
        .where(F.col("net_circulation") < F.col("_previous"))
        .withColumn("_change", pct_change("net_circulation", "_previous"))
    )
    return (
        falls.orderBy("_change", "city_id", "year", "month_num")
        .limit(k)
        .select(
            F.col("city").alias("city_name"),
            "year",
            month_key("year", "month_num").alias("month"),
            "net_circulation",
            rounded("_change", 2).alias("MoM_Decline_Percentage"),
        )
        .orderBy("MoM_Decline_Percentage", "city_name", "month")
    )


def print_efficiency(tables: Tables, year: int = 2024, k: int = 5) -> DataFrame:
    """Q9: net circulation per printed copy in one year, cities ranked up to k.

    The rank is taken before the join, so a city missing from the dimension uses up its rank.
    """
    net, printed = f"net_circulation_{year}", f"copies_printed_{year}"
    rank = f"efficiency_rank_{year}"
    metrics = (
        tables["print_sales"]
        .where(F.col("year") == year)
        .groupBy("City_ID")
        .agg(
            F.sum("Net_Circulation").alias(net),
            F.sum(strict_sum("Copies_Sold", "copies_returned")).alias(printed),
        )
        .where(F.col(printed) > 0)
        .withColumn("_ratio", rounded(safe_ratio(net, printed), 8))
    )
    ranked = rank_at_most(metrics, "_ratio", k, rank)
    return (
        with_city(ranked, tables["city_data"], "city")
        .select(
            F.col("city").alias("city_name"),
            printed,
            net,
            rounded("_ratio", 4).alias("efficiency_ratio"),
            rank,
        )
        .orderBy(rank, "city_name")
    )


def circulation_change(tables: Tables, first_year: int = 2019, last_year: int = 2024) -> DataFrame:
    """K2: total net circulation of two years and the change between them, one row."""
    sales = tables["print_sales"].where(F.col("year").isin(first_year, last_year))
    totals = sales.agg(
        *[
            F.sum(F.when(F.col("year") == y, F.col("Net_Circulation"))).alias(name)
            for name, y in (("first_net", first_year), ("last_net", last_year))
        ]
    )
    change = rounded(pct_change("last_net", "first_net"), 2)
    return totals.select("first_net", "last_net", change.alias("change_percent"))
