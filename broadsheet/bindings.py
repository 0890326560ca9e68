"""The star schema derived from the TPC-H-like test tables, as DataFrames.

Cities are nations, editions are suppliers, print sales are line items by month, ad revenue is
orders, the pilot is the event stream. Years are moved by 24 so that 1995-2001 becomes 2019-2025.
Facts are summed on their own keys before any join, so a hot key is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rounded

YEAR_SHIFT = 24
CITY_GROUPS = 25


# The columns used, under fixed types: no job has to read a footer to plan a query.
SOURCES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_nationkey int",
    "part": "p_partkey long, p_brand string",
    "supplier": "s_suppkey long, s_nationkey int",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
    "props string",
}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _code(prefix: str, number, width: int):
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def _city_id(number):
    return _code("C", number, 3)


def _in_years(df: DataFrame, column: str, years: tuple[int, int] | None) -> DataFrame:
    """Keep a range of shifted years, as a plain comparison that reaches the Parquet scan."""
    if years is None:
        return df
    first, last = (y - YEAR_SHIFT for y in years)
    start, end = (F.lit(f"{y}-01-01").cast(df.schema[column].dataType) for y in (first, last + 1))
    return df.where((F.col(column) >= start) & (F.col(column) < end))


def _cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = source(spark, sf_dir, "nation"), source(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))


def city_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cities(spark, sf_dir).select(
        _city_id(F.col("n_nationkey")).alias("city_id"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        F.concat(F.lit("Tier "), (F.col("n_nationkey") % 3 + 1).cast("string")).alias("tier"),
    )


def _edition_months(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None) -> DataFrame:
    """Supplier x month with copies sold and returned, joined to the supplier's nation and region.

    Returned lines count up to a line number that depends on the nation, known only after the
    join; a sum per possible limit keeps it to one aggregation of the line items.
    """
    lines = _in_years(source(spark, sf_dir, "lineitem"), "l_shipdate", years)
    copies = "CAST(l_quantity AS BIGINT)"
    limits = range(1, 8)
    monthly = lines.groupBy(
        "l_suppkey", F.trunc(F.col("l_shipdate").cast("date"), "month").alias("_month")
    ).agg(
        F.expr(f"sum({copies}) AS sold"),
        F.max("l_shipdate").alias("_last_day"),
        *[
            F.expr(f"sum(if(l_returnflag = 'R' AND l_linenumber <= {n}, {copies}, NULL)) AS _returned_{n}")
            for n in limits
        ],
    )
    supplier = source(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = monthly.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        _cities(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey")
    )
    by_limit = F.array(*[F.col(f"_returned_{n}") for n in limits])
    return joined.withColumns(
        {
            "returned": F.coalesce(F.element_at(by_limit, F.col("s_nationkey") % 7 + 1), F.lit(0)),
            "month": F.add_months("_month", 12 * YEAR_SHIFT),
        }
    )


def print_sales(
    spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None
) -> DataFrame:
    month = F.col("month")
    return _edition_months(spark, sf_dir, years).select(
        _code("ED", F.col("l_suppkey"), 6).alias("edition_id"),
        _city_id(F.col("s_nationkey")).alias("City_ID"),
        F.col("r_name").alias("State"),
        month.alias("Month"),
        F.col("sold").alias("Copies_Sold"),
        F.col("returned").alias("copies_returned"),
        (F.col("sold") - F.col("returned")).alias("Net_Circulation"),
        F.year(month).alias("year"),
        F.month(month).alias("month_num"),
        F.date_format(month, "MMMM").alias("month_name"),
        F.quarter(month).alias("quarter"),
    )


def raw_print_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month as text in four notations and some unreadable, one state in three spellings."""
    notation = F.col("l_suppkey") % 5
    # Off an aggregate, so that filters on the parsed text stay above the aggregation.
    month = F.add_months(F.trunc(F.col("_last_day").cast("date"), "month"), 12 * YEAR_SHIFT)
    text = (
        F.when(notation == 0, F.date_format(month, "yyyy-MM"))
        .when(notation == 1, F.date_format(month, "yyyy-MM-dd"))
        .when(notation == 2, F.date_format(month, "yyyy/MM/dd"))
        .when(notation == 3, F.date_format(month, "MMM-yyyy"))
        .otherwise("unknown")
    )
    spelling = (
        F.when(F.col("n_nationkey") % 3 == 0, "Uttar-Pradesh")
        .when(F.col("n_nationkey") % 3 == 1, "Uttar pradesh")
        .otherwise("Uttar Pradesh")
    )
    return _edition_months(spark, sf_dir, None).select(
        _code("ED", F.col("l_suppkey"), 6).alias("edition_id"),
        _city_id(F.col("s_nationkey")).alias("City_ID"),
        F.when(F.col("r_name") == "ASIA", spelling).otherwise(F.col("r_name")).alias("State"),
        text.alias("Month"),
        F.col("sold").alias("Copies Sold"),
        F.col("returned").alias("copies_returned"),
        (F.col("sold") - F.col("returned")).alias("Net_Circulation"),
    )


def ad_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    priorities = source(spark, sf_dir, "orders").select("o_orderpriority").distinct()
    return priorities.select(
        F.concat(F.lit("A00"), F.substring("o_orderpriority", 1, 1)).alias("ad_category_id"),
        F.expr("substring(o_orderpriority, 3)").alias("standard_ad_category"),
    )


def _bookings(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None) -> DataFrame:
    orders = _in_years(source(spark, sf_dir, "orders"), "o_orderdate", years)
    suppliers = source(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("_suppliers"))
    year = F.year("o_orderdate") + YEAR_SHIFT
    quarter = F.quarter("o_orderdate")
    text = (
        F.when(quarter == 2, F.concat(year.cast("string"), F.lit("-Q2")))
        .when(quarter == 4, F.concat(F.lit("4th Qtr "), year.cast("string")))
        .otherwise(F.concat(F.lit("Q"), quarter.cast("string"), F.lit("-"), year.cast("string")))
    )
    return orders.crossJoin(F.broadcast(suppliers)).withColumns(  # one row
        {
            "edition_id": _code("ED", F.col("o_custkey") % F.col("_suppliers"), 6),
            "ad_category": F.concat(F.lit("A00"), F.substring("o_orderpriority", 1, 1)),
            "ad_revenue": F.col("o_totalprice"),
            "quarter": text,
            "year": year,
            "quarter_num": quarter,
        }
    )


def ad_revenue(
    spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None
) -> DataFrame:
    digit = F.col("o_orderkey") % 10
    currency = F.when(digit.between(4, 6), "USD").when(digit.between(7, 8), "EUR").otherwise("INR")
    rate = F.when(digit.between(4, 6), 88.14).when(digit.between(7, 8), 103.39).otherwise(1.0)
    return _bookings(spark, sf_dir, years).select(
        "edition_id",
        "ad_category",
        "quarter",
        "ad_revenue",
        currency.alias("currency"),
        "year",
        "quarter_num",
        (F.rint(F.col("ad_revenue") * rate * 100) / 100).alias("ad_revenue_inr"),
    )


def raw_ad_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Currency codes padded and in mixed case, one of them unknown; most comments missing."""
    codes = ["INR", " inr ", "In Rupees", "\tIN RUPEES ", "USD", "usd", " Usd", "EUR", "eur\t", "GBP"]
    code = F.element_at(F.array(*map(F.lit, codes)), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return _bookings(spark, sf_dir, None).select(
        "o_orderkey",
        "edition_id",
        "ad_category",
        "quarter",
        "ad_revenue",
        code.alias("currency"),
        F.when(F.col("o_orderstatus") == "P", F.lit("Seasonal booking")).alias("comments"),
    )


def raw_city_readiness(
    spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None
) -> DataFrame:
    year, quarter = F.year("o_orderdate") + YEAR_SHIFT, F.quarter("o_orderdate")
    flags = {
        "_f": F.col("o_orderstatus") == "F",
        "_urgent": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
        "_large": F.col("o_totalprice") > 100000,
    }
    per_customer = (
        _in_years(source(spark, sf_dir, "orders"), "o_orderdate", years)
        .groupBy("o_custkey", year.alias("_year"), quarter.alias("_quarter"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.count_if(test).alias(name) for name, test in flags.items()],
        )
    )
    customer = source(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    per_city = (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "_year", "_quarter")
        .agg(*[F.sum(c).alias(c) for c in ("_n", *flags)])
    )

    def share(c: str):
        return rounded(F.col(c) * 100 / F.col("_n"), 2)

    return per_city.select(
        (F.col("c_nationkey").cast("long") * 100_000 + F.col("_year") * 10 + F.col("_quarter")).alias(
            "row_id"
        ),
        _city_id(F.col("c_nationkey")).alias("city_id"),
        F.concat(F.col("_year").cast("string"), F.lit("-Q"), F.col("_quarter").cast("string")).alias(
            "quarter"
        ),
        share("_f").alias("literacy_rate"),
        share("_urgent").alias("smartphone_penetration"),
        share("_large").alias("internet_penetration"),
        F.col("_year").alias("_year"),
        F.col("_quarter").alias("_quarter"),
    )


def city_readiness(
    spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None
) -> DataFrame:
    return raw_city_readiness(spark, sf_dir, years).withColumnsRenamed(
        {"_year": "year", "_quarter": "quarter_num"}
    )


def digital_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event type x city; users are counted through one row per user, not in one group's set."""
    per_user = (
        source(spark, sf_dir, "events")
        .groupBy("event_type", "user_id")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(F.rint(F.col("value") * 100).cast("long")).alias("_hundredths"),
            F.min("event_id").alias("_first"),
            F.min("ts").alias("_ts"),
            F.sum(F.col("event_id") % 1000).alias("_dev"),
            F.sum(F.col("event_id") % 100).alias("_marketing"),
        )
    )
    city = F.col("user_id") % CITY_GROUPS
    pilot = per_user.groupBy("event_type", city.alias("_city")).agg(
        F.min("_first").alias("row_id"),
        F.min("_ts").alias("_ts"),
        F.sum("_dev").alias("dev_cost"),
        F.sum("_marketing").alias("marketing_cost"),
        F.count(F.lit(1)).alias("users_reached"),
        F.sum("_n").alias("downloads_or_accesses"),
        rounded(F.sum("_hundredths") / (F.sum("_n") * 100), 2).alias("avg_bounce_rate"),
    )
    said = F.concat(F.col("event_type"), F.lit(" from "), _city_id(F.col("_city")))
    return pilot.select(
        "row_id",
        F.col("event_type").alias("platform"),
        F.date_format("_ts", "yyyy-MM").alias("launch_month"),
        F.concat(F.lit("A00"), (F.col("_city") % 5 + 1).cast("string")).alias("ad_category_id"),
        "dev_cost",
        "marketing_cost",
        "users_reached",
        "downloads_or_accesses",
        "avg_bounce_rate",
        F.when(F.col("downloads_or_accesses") % 2 == 0, said).alias(
            "cumulative_feedback_from_customers"
        ),
        _city_id(F.col("_city")).alias("city_id"),
    )


class Star(dict):
    """The six clean tables by name, each planned when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, years: tuple[int, int] | None):
        super().__init__()
        self._builders = {
            "city_data": lambda: city_data(spark, sf_dir),
            "ad_category": lambda: ad_category(spark, sf_dir),
            "print_sales": lambda: print_sales(spark, sf_dir, years),
            "ad_revenue": lambda: ad_revenue(spark, sf_dir, years),
            "city_readiness": lambda: city_readiness(spark, sf_dir, years),
            "digital_plot": lambda: digital_plot(spark, sf_dir),
        }

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self._builders[name]()
        return self[name]


def star(
    spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None
) -> dict[str, DataFrame]:
    """The six clean tables. `years` limits the tables that have years at the scan."""
    return Star(spark, sf_dir, years)
