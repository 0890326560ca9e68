"""Raw tables to clean tables.

Every cleaner is a projection of column expressions, without a shuffle, except for the forward
fill of the pilot feedback.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import date_parts, parse_date, quarter_number, quarter_year, respell, tidy
from ..operators import forward_fill, in_rupees

# Fixed value: the filler of empty comments, spelled as downstream users know it.
NO_COMMENT = "No Commensts"

# Spellings of a state and their canonical form.
STATE_SPELLINGS = {"Uttar-Pradesh|Uttar pradesh": "Uttar Pradesh"}


# Codes that tables are joined by; they are the same whatever their case.
KEYS = ("edition_id", "city_id", "City_ID", "ad_category", "ad_category_id")


def same_case(df: DataFrame) -> DataFrame:
    """Codes in upper case without surrounding blanks, so that joins do not depend on their case."""
    keys = [c for c in df.columns if c in KEYS]
    return df.withColumns({c: tidy(c) for c in keys})


def fill_missing_comments(ad_revenue: DataFrame, filler: str = NO_COMMENT) -> DataFrame:
    return ad_revenue.fillna({"comments": filler})


def fill_missing_feedback(digital_plot: DataFrame, order_by: str = "row_id") -> DataFrame:
    return forward_fill(digital_plot, "cumulative_feedback_from_customers", order_by)


def with_quarter_parts(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"year": quarter_year("quarter"), "quarter_num": quarter_number("quarter")}
    )


def clean_ad_revenue(ad_revenue: DataFrame, rates=None, filler: str = NO_COMMENT) -> DataFrame:
    """Comments filled, quarter parsed, currency code tidied, amount in rupees added."""
    filled = fill_missing_comments(ad_revenue, filler)
    tidied = with_quarter_parts(filled).withColumn("currency", tidy("currency"))
    return in_rupees(same_case(tidied), "ad_revenue", "currency", "ad_revenue_inr", rates)


def clean_city_readiness(city_readiness: DataFrame) -> DataFrame:
    return with_quarter_parts(same_case(city_readiness))


def clean_digital_plot(
    digital_plot: DataFrame, order_by: str = "row_id", date_formats: dict[str, str] | None = None
) -> DataFrame:
    """Feedback filled forward; launch date parts added beside the saved month text."""
    filled = fill_missing_feedback(digital_plot, order_by)
    launched = parse_date("launch_month", date_formats)
    return same_case(filled).withColumns(date_parts(launched, "launch_"))


def clean_print_sales(
    print_sales: DataFrame,
    spellings: dict[str, str] | None = None,
    date_formats: dict[str, str] | None = None,
) -> DataFrame:
    """State respelled, `Copies Sold` renamed, month parsed to its first day, date parts added.

    `date_formats` replaces the notations understood: shape of the text (a pattern) to its format.
    """
    renamed = same_case(print_sales).withColumnRenamed("Copies Sold", "Copies_Sold")
    dated = renamed.withColumns(
        {
            "State": respell("State", spellings or STATE_SPELLINGS),
            "Month": parse_date("Month", date_formats),
        }
    )
    return dated.withColumns(date_parts("Month"))


CLEANERS = {
    "ad_category": same_case,
    "city_data": same_case,
    "ad_revenue": clean_ad_revenue,
    "city_readiness": clean_city_readiness,
    "digital_plot": clean_digital_plot,
    "print_sales": clean_print_sales,
}


def clean_all(
    tables: dict[str, DataFrame], date_formats: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    """Every table through its cleaner, those with dates under the notations given."""
    dated = {"digital_plot", "print_sales"}
    return {
        name: df.transform(CLEANERS[name], **({"date_formats": date_formats} if name in dated else {}))
        if name in CLEANERS
        else df
        for name, df in tables.items()
    }
