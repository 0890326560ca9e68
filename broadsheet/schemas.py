"""Fixed schemas of the six tables; nothing is inferred on read.

``row_id`` is the unnamed leading index column of the files that carry one. It is the row order
forward fill needs.
"""

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


_AD_REVENUE = dict(
    edition_id=T.StringType(),
    ad_category=T.StringType(),
    quarter=T.StringType(),
    ad_revenue=T.DoubleType(),
    currency=T.StringType(),
    comments=T.StringType(),
)
_CITY_READINESS = dict(
    row_id=T.LongType(),
    city_id=T.StringType(),
    quarter=T.StringType(),
    literacy_rate=T.DoubleType(),
    smartphone_penetration=T.DoubleType(),
    internet_penetration=T.DoubleType(),
)
_DIGITAL_PLOT = dict(
    row_id=T.LongType(),
    platform=T.StringType(),
    launch_month=T.StringType(),
    ad_category_id=T.StringType(),
    dev_cost=T.LongType(),
    marketing_cost=T.LongType(),
    users_reached=T.LongType(),
    downloads_or_accesses=T.LongType(),
    avg_bounce_rate=T.DoubleType(),
    cumulative_feedback_from_customers=T.StringType(),
    city_id=T.StringType(),
)
_CITY_DATA = dict(
    city_id=T.StringType(), city=T.StringType(), state=T.StringType(), tier=T.StringType()
)
_AD_CATEGORY = dict(ad_category_id=T.StringType(), standard_ad_category=T.StringType())

RAW = {
    "ad_category": _schema(**_AD_CATEGORY),
    "city_data": _schema(**_CITY_DATA),
    "ad_revenue": _schema(**_AD_REVENUE),
    "city_readiness": _schema(**_CITY_READINESS),
    "digital_plot": _schema(**_DIGITAL_PLOT),
    "print_sales": _schema(
        **{
            "edition_id": T.StringType(),
            "City_ID": T.StringType(),
            "State": T.StringType(),
            "Month": T.StringType(),
            "Copies Sold": T.LongType(),
            "copies_returned": T.LongType(),
            "Net_Circulation": T.LongType(),
        }
    ),
}

CLEAN = {
    "ad_category": RAW["ad_category"],
    "city_data": RAW["city_data"],
    "ad_revenue": _schema(
        **_AD_REVENUE,
        year=T.IntegerType(),
        quarter_num=T.IntegerType(),
        ad_revenue_inr=T.DoubleType(),
    ),
    "city_readiness": _schema(
        **_CITY_READINESS, year=T.IntegerType(), quarter_num=T.IntegerType()
    ),
    "digital_plot": _schema(
        **_DIGITAL_PLOT,
        launch_year=T.IntegerType(),
        launch_month_num=T.IntegerType(),
        launch_month_name=T.StringType(),
        launch_quarter=T.IntegerType(),
    ),
    "print_sales": _schema(
        edition_id=T.StringType(),
        City_ID=T.StringType(),
        State=T.StringType(),
        Month=T.DateType(),
        Copies_Sold=T.LongType(),
        copies_returned=T.LongType(),
        Net_Circulation=T.LongType(),
        year=T.IntegerType(),
        month_num=T.IntegerType(),
        month_name=T.StringType(),
        quarter=T.IntegerType(),
    ),
}

# Tables whose text columns may hold newlines: their CSV form is read with multiLine.
MULTILINE = {"digital_plot"}

# Layout of the published tables: year predicates then prune whole directories.
PARTITIONED_BY = {"ad_revenue": ["year"], "print_sales": ["year"]}
