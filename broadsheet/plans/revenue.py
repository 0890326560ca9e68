"""Questions on ad revenue, alone and against circulation.

Where revenue meets circulation the keys are not unique on either side; `fanout_sums` gives the
sums over that join from two pre-aggregated sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import band, half_even, money_sum, rounded, safe_ratio, strict_greatest, strict_sum
from ..operators import fanout_sums
from .circulation import Tables, sum_by, with_city

# The scoring of a category's growth, and the verdicts on the whole score.
GROWTH_POINTS = [
    (">", 0.20, 30),
    (">", 0.10, 25),
    (">", 0.05, 20),
    (">", -0.05, 15),
    (">", -0.10, 10),
    (">", -0.25, 5),
]
VERDICTS = [
    (">=", 80, "STRONG: Sustained Growth"),
    (">=", 60, "STABLE: Consistent Performer"),
    (">=", 40, "WATCH: Plateauing"),
    (">=", 20, "DECLINING: Needs Intervention"),
]
LOWEST_VERDICT = "CRITICAL: Severe Decline"

# Peak and recovery scores, and the weight of each score in the whole.
PEAK_SCORES = {"last year": 1.0, "year before": 0.8, "earlier": 0.4}
RECOVERY_SCORES = {True: 1.0, False: 0.6}
WEIGHTS = {"consistency_score": 6, "peak_timing_score": 20, "recovery_score": 20}

# Labels of the change of a ratio.
TREND_LABELS = {
    "first": "No Prior Year Data",
    "up": "Improving (Wider Margin)",
    "down": "Worsening (Tighter Margin)",
    "same": "Stable",
}


def category_strength(
    tables: Tables,
    first_year: int = 2019,
    last_year: int = 2024,
    amount: str = "ad_revenue",
) -> DataFrame:
    """Q3: yearly revenue per ad category, scored on growth, consistency, peak and recovery.

    The default amount adds up the booked figures whatever their currency;
    `amount="ad_revenue_inr"` is the sound variant.
    """
    years = list(range(first_year, last_year + 1))
    if len(years) < 4:
        raise ValueError("the recovery score needs at least four years")
    revenue = {y: f"revenue_{y}" for y in years}
    booked = tables["ad_revenue"].where(F.col("year").between(first_year, last_year))
    per_code = booked.groupBy("ad_category", "year").agg(money_sum(amount).alias("total"))
    categories = tables["ad_category"]
    yearly = (
        per_code.join(categories, per_code.ad_category == categories.ad_category_id)
        .groupBy("standard_ad_category")
        .agg(
            *[
                F.sum(F.when(F.col("year") == y, F.col("total"))).alias(column)
                for y, column in revenue.items()
            ]
        )
    )

    def rev(back: int):
        return F.col(revenue[last_year - back])

    best = strict_greatest(*revenue.values())
    rises = [
        F.when(F.col(revenue[y]) > F.col(revenue[y - 1]), 1).otherwise(0) for y in years[1:]
    ]
    growth = safe_ratio(F.col(revenue[last_year]) - F.col(revenue[first_year]), revenue[first_year])
    recovered = (rev(0) > rev(2)) & (rev(2) < rev(3))
    scored = yearly.withColumns(
        {
            "_growth": growth,
            "consistency_score": strict_sum(*rises),
            "peak_timing_score": F.when(rev(0) == best, PEAK_SCORES["last year"])
            .when(rev(1) == best, PEAK_SCORES["year before"])
            .otherwise(PEAK_SCORES["earlier"]),
            "recovery_score": F.when(recovered, RECOVERY_SCORES[True]).otherwise(
                RECOVERY_SCORES[False]
            ),
        }
    ).withColumn(
        "total_strength_score",
        strict_sum(
            band("_growth", GROWTH_POINTS, 0),
            *[F.col(score) * weight for score, weight in WEIGHTS.items()],
        ),
    )
    return scored.select(
        "standard_ad_category",
        *[F.col(c).cast("double").alias(c) for c in revenue.values()],
        half_even(F.col("_growth") * 100).alias("net_growth_percent"),
        "consistency_score",
        "peak_timing_score",
        "recovery_score",
        "total_strength_score",
        band("total_strength_score", VERDICTS, LOWEST_VERDICT).alias("final_verdict"),
    ).orderBy(
        F.desc("total_strength_score"), F.desc(revenue[last_year]), "standard_ad_category"
    )


def revenue_by_city(tables: Tables) -> DataFrame:
    """Q4: ad revenue and net circulation per city name and state, and their ratio.

    An edition sold in several cities counts its whole revenue in each.
    """
    revenue = (
        tables["ad_revenue"].groupBy("edition_id").agg(money_sum("ad_revenue_inr").alias("revenue"))
    )
    editions = sum_by(tables["print_sales"], ["edition_id", "City_ID"], net="Net_Circulation")
    per_city = sum_by(editions.join(revenue, "edition_id"), ["City_ID"], revenue="revenue", net="net")
    return (
        with_city(per_city, tables["city_data"], "city", "state")
        .groupBy("city", "state")
        .agg(
            F.sum("revenue").cast("double").alias("Total_City_Ad_Revenue"),
            F.sum("net").alias("Total_City_Net_Circulation"),
            half_even(safe_ratio(F.sum("revenue"), F.sum("net"))).alias(
                "Revenue_Per_Net_Copy_Ratio"
            ),
        )
        .orderBy(F.desc("Total_City_Ad_Revenue"), "city", "state")
    )


def city_years(
    tables: Tables, fanout: bool, first_year: int | None = None, last_year: int | None = None
) -> DataFrame:
    """(city_id, city, year, net, revenue) over print sales joined to ad revenue by edition-year."""
    sales, revenue = tables["print_sales"], tables["ad_revenue"]
    if first_year is not None:
        within = F.col("year").between(first_year, last_year)
        sales, revenue = sales.where(within), revenue.where(within)
    sums = fanout_sums(
        sales,
        revenue,
        on=["edition_id", "year"],
        group_by=["City_ID", "year"],
        left_sums={"net": F.sum("Net_Circulation")},
        right_sums={"revenue": money_sum("ad_revenue_inr")},
        multiply=fanout,
    )
    return sum_by(
        with_city(sums, tables["city_data"], "city"),
        ["city_id", "city", "year"],
        net="net",
        revenue="revenue",
    )


def revenue_per_copy(tables: Tables, fanout: bool = True) -> DataFrame:
    """Q6: ad revenue per net copy by city and year, with its change and trend.

    By default both sums run over the many-to-many join of the two facts, so an edition-year
    weighs in by the other fact's row count; `fanout=False` counts every row once. City-years
    without positive circulation are left out, and the previous value is the one before them.
    """
    ratios = (
        city_years(tables, fanout)
        .where(F.col("net") > 0)
        .select(
            "city_id",
            "city",
            "year",
            rounded(safe_ratio("revenue", "net"), 4).cast("decimal(18,4)").alias("ratio"),
        )
    )
    by_year = Window.partitionBy("city_id").orderBy("year")
    lagged = ratios.withColumn("previous", F.lag("ratio").over(by_year))
    change = (F.col("ratio") - F.col("previous")) * 100 / F.nullif("previous", F.lit(0))
    trend = (
        F.when(F.col("previous").isNull(), TREND_LABELS["first"])
        .when(F.col("ratio") > F.col("previous"), TREND_LABELS["up"])
        .when(F.col("ratio") < F.col("previous"), TREND_LABELS["down"])
        .otherwise(TREND_LABELS["same"])
    )
    return lagged.select(
        "city",
        "year",
        F.col("ratio").cast("double").alias("Revenue_Per_Copy_Ratio"),
        F.col("previous").cast("double").alias("Previous_Year_Ratio"),
        F.round(change, 2).cast("double").alias("YoY_Ratio_Change_Percentage"),
        trend.alias("Ratio_Trend"),
    ).orderBy(F.desc("year"), F.desc("Revenue_Per_Copy_Ratio"), "city")


def frequent_declines(
    tables: Tables,
    first_year: int = 2019,
    last_year: int = 2024,
    flags_from: int = 2020,
    k: int = 5,
    fanout: bool = True,
) -> DataFrame:
    """Q11: cities by their number of yearly declines in circulation and ad revenue.

    Rows before `flags_from` go before the comparison, so that year itself has no predecessor.
    """
    by_year = Window.partitionBy("city_id").orderBy("year")

    def declined(measure: str):
        return F.when(F.col(measure) < F.lag(measure).over(by_year), 1).otherwise(0)

    return (
        city_years(tables, fanout, first_year, last_year)
        .where(F.col("year") >= flags_from)
        .withColumns({"_print": declined("net"), "_ad": declined("revenue")})
        .groupBy("city_id", "city")
        .agg(F.sum("_print").alias("num_print_declines"), F.sum("_ad").alias("num_ad_declines"))
        .withColumn("total_decline_events", F.col("num_print_declines") + F.col("num_ad_declines"))
        .orderBy(F.desc("total_decline_events"), F.desc("num_print_declines"), "city", "city_id")
        .limit(k)
        .select(
            F.col("city").alias("city_name"),
            "num_print_declines",
            "num_ad_declines",
            "total_decline_events",
        )
    )


def category_share(tables: Tables, amount: str = "ad_revenue_inr") -> DataFrame:
    """K3: each ad category's revenue and its share of all revenue."""
    categories = tables["ad_category"]
    per_code = tables["ad_revenue"].groupBy("ad_category").agg(money_sum(amount).alias("revenue"))
    sums = sum_by(
        per_code.join(categories, per_code.ad_category == categories.ad_category_id),
        ["standard_ad_category"],
        revenue="revenue",
    )
    total = sums.agg(F.sum("revenue").alias("_total"))
    return (
        sums.crossJoin(F.broadcast(total))  # one row
        .select(
            "standard_ad_category",
            F.col("revenue").cast("double").alias("revenue"),
            rounded(safe_ratio(F.col("revenue") * 100, "_total"), 2).alias("share_percent"),
        )
        .orderBy(F.desc("revenue"), "standard_ad_category")
    )


def revenue_circulation_correlation(tables: Tables) -> DataFrame:
    """K4: correlation of ad revenue with net circulation over edition-years, per state."""
    sales = tables["print_sales"].withColumn("_state", F.lower("State"))
    circulation = sales.groupBy("edition_id", "year", "_state").agg(
        F.sum("Net_Circulation").alias("net"), F.min("State").alias("State")
    )
    revenue = (
        tables["ad_revenue"]
        .groupBy("edition_id", "year")
        .agg(money_sum("ad_revenue_inr").cast("double").alias("revenue"))
    )
    return (
        circulation.join(revenue, ["edition_id", "year"])
        .groupBy("_state")
        .agg(
            F.min("State").alias("State"),
            F.count(F.lit(1)).alias("edition_years"),
            rounded(F.corr("revenue", F.col("net").cast("double")), 6).alias("correlation"),
        )
        .drop("_state")
        .orderBy("State")
    )
