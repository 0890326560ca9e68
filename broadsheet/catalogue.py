"""Every registered query over the test tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from inspect import signature

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bindings, operators, oracle
from .functions import (
    DATE_FORMATS,
    exact_mean,
    half_even,
    money_sum,
    month_key,
    rounded,
    strict_greatest,
    wide_sum,
)
from .plans import cleaning, job
from .plans.questions import QUESTIONS
from .schemas import CLEAN, RAW
from .sources import (
    RESCUED,
    STATUS_SCHEMA,
    PublishError,
    load_all,
    load_table,
    publish,
    publish_together,
    split_rows,
    write_clean,
)

Query = Callable[[SparkSession, str], DataFrame]


def years_of(name: str, **parameters) -> tuple[int, int] | None:
    """The years a question asks for under its parameters: `year`, or `first_year` to `last_year`.

    None means all years. It is what the question itself compares years with, so that the range
    may be applied at the scan already.
    """
    bound = signature(QUESTIONS[name]).bind({}, **parameters)
    bound.apply_defaults()
    asked = bound.arguments
    first, last = (asked.get(c, asked.get("year")) for c in ("first_year", "last_year"))
    return None if first is None or last is None else (first, last)


def _question(name: str, **parameters) -> Query:
    years = years_of(name, **parameters)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return QUESTIONS[name](bindings.star(spark, sf_dir, years), **parameters)

    return run


QUERIES: dict[str, Query] = {name: _question(name) for name in QUESTIONS} | {
    "q3_category_strength_inr": _question("q3_category_strength", amount="ad_revenue_inr"),
    "q6_revenue_per_copy_single": _question("q6_revenue_per_copy", fanout=False),
    "q7_relaunch_best_three": _question("q7_relaunch_priority", order="best_first", limit=3),
    "q7_relaunch_distributed": _question("q7_relaunch_priority"),
    "q2_city_contribution_2023": _question("q2_city_contribution", year=2023),
    "q1_state_trend_late": _question("q1_state_trend", first_year=2022, last_year=2025),
    "q11_frequent_declines_single": _question("q11_frequent_declines", fanout=False),
}



def _raw(name: str) -> Query:
    """A raw table, columns beyond its schema left out."""
    builder = {
        "ad_revenue": bindings.raw_ad_revenue,
        "city_readiness": bindings.raw_city_readiness,
        "digital_plot": bindings.digital_plot,
        "print_sales": bindings.raw_print_sales,
    }[name]
    return lambda spark, sf_dir: builder(spark, sf_dir).select(*RAW[name].names)


def _source(name: str, *columns: str) -> Query:
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = bindings.source(spark, sf_dir, name)
        return df.select(*columns) if columns else df

    return read


def _star_table(name: str, *columns: str) -> Query:
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = bindings.star(spark, sf_dir)[name]
        return df.select(*columns) if columns else df

    return read


def _then(read: Query, step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: step(read(spark, sf_dir))


def _per_table(step: Callable[[DataFrame, str], DataFrame], **tables: Query) -> Query:
    """A quality check over several tables, as one result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = [step(read(spark, sf_dir), name) for name, read in tables.items()]
        return reduce(DataFrame.unionByName, parts)

    return run


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- sources, sinks, catalog ----------------------------------------------------------------


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pilot table written as CSV, feedback with quoted line breaks, and read back."""
    feedback = F.regexp_replace("cumulative_feedback_from_customers", " from ", ',\n"from" ')
    pilot = _raw("digital_plot")(spark, sf_dir).withColumn(
        "cumulative_feedback_from_customers", feedback
    )
    path = operators.scratch_dir(spark, "digital_plot") + ".csv"
    write_clean(pilot, "digital_plot", path, "csv")
    return load_table(spark, "digital_plot", path)


def every_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readiness table written in each format and read back under its schema."""
    readiness = _raw("city_readiness")(spark, sf_dir)
    parts = []
    for fmt in ("csv", "json", "orc", "parquet"):
        path = operators.scratch_dir(spark, "city_readiness") + f".{fmt}"
        write_clean(readiness, "city_readiness", path, fmt)
        parts.append(load_table(spark, "city_readiness", path).withColumn("format", F.lit(fmt)))
    return reduce(DataFrame.unionByName, parts)


def raw_files(spark: SparkSession, sf_dir: str) -> str:
    """All six raw tables as CSV files in a scratch folder."""
    folder = operators.scratch_dir(spark, "raw")
    tables = {name: read(spark, sf_dir) for name, read in _QUALITY.items()}
    tables |= {n: bindings.star(spark, sf_dir)[n] for n in ("ad_category", "city_data")}
    for name, df in tables.items():
        write_clean(df, name, f"{folder}/{name}.csv", "csv")
    return folder


def loaded_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = load_all(spark, raw_files(spark, sf_dir))
    return reduce(
        DataFrame.unionByName, [operators.shape(df, name) for name, df in tables.items()]
    )


def answer_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw CSV files, cleaned into Parquet files, asked for the revenue per copy."""
    clean = operators.scratch_dir(spark, "clean")
    manifest = job.clean_to_files(spark, raw_files(spark, sf_dir), clean)
    tables = {
        name: load_table(spark, name, path, schema=CLEAN[name]) for path, name in manifest.items()
    }
    return QUESTIONS["q6_revenue_per_copy"](tables)


def published_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City contribution asked of published tables: clean files, partitioned by year, as tables.

    The database of this run lives in the scratch folder and is dropped once the answer is stored.
    """
    folder = operators.scratch_dir(spark, "clean")
    star = bindings.star(spark, sf_dir)
    manifest = {}
    for name in ("city_data", "print_sales", "city_readiness"):
        path = f"{folder}/{name}.parquet"
        write_clean(star[name], name, path)
        manifest[path] = name
    database = "circulation_" + folder.rsplit("-", 1)[-1][:12]
    try:
        publish(spark, manifest, database, f"{folder}/warehouse")
        tables = {name: spark.table(f"{database}.{name}") for name in manifest.values()}
        return operators.pin(QUESTIONS["q2_city_contribution"](tables))  # a row per city
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS `{database}` CASCADE")


def reordered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readiness table from CSV files with their columns in another order and one too many, a
    rate that is not a number, and what the quality report counts of short and long rows."""
    path = operators.scratch_dir(spark, "reordered") + ".csv"
    readiness = _raw("city_readiness")(spark, sf_dir)
    unread = F.when(F.col("row_id") % 5 == 0, F.lit("NaN")).otherwise(F.col("literacy_rate").cast("string"))
    changed = readiness.withColumns({"literacy_rate": unread, "remark": F.lit("x")})
    order = ["quarter", "remark", "literacy_rate", "row_id", "internet_penetration", "city_id", "smartphone_penetration"]
    write_clean(changed.select(*order), "city_readiness", path, "csv")
    return load_table(spark, "city_readiness", path)


def malformed_sales(spark: SparkSession, sf_dir: str) -> str:
    """Raw print sales as CSV files, three of seven editions with rows that do not fit: too few
    cells, too many, or no number of copies."""
    path = operators.scratch_dir(spark, "print_sales") + ".csv"
    names = RAW["print_sales"].names
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names]
    fault = F.substring("edition_id", 3, 9).cast("int") % 7
    unread = [F.lit("many") if c == "Copies Sold" else cell for c, cell in zip(names, cells, strict=True)]
    line = (
        F.when(fault == 1, F.concat_ws(",", *cells[:-2]))
        .when(fault == 2, F.concat_ws(",", *cells, F.lit("more")))
        .when(fault == 3, F.concat_ws(",", *unread))
        .otherwise(F.concat_ws(",", *cells))
    )
    # One column whose name is the header, so that every task's file gets one.
    lines = _raw("print_sales")(spark, sf_dir).repartition(8, "edition_id").select(line.alias(",".join(names)))
    lines.write.options(header=True, sep="\u0001", quote="").csv(path)
    return path


def split_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and copies of the sales that fit their schema and of those that don't, by cells."""
    split = split_rows(
        spark, "print_sales", malformed_sales(spark, sf_dir), operators.scratch_dir(spark, "split")
    )

    def figures(rows: DataFrame, cells) -> DataFrame:
        return rows.groupBy(cells.cast("int").alias("cells")).agg(
            F.count(F.lit(1)).alias("rows"), F.sum("Copies Sold").alias("copies")
        )

    good = figures(split.good, F.lit(len(RAW["print_sales"].names))).withColumn("fits", F.lit(True))
    bad = figures(split.bad, F.size(F.split(RESCUED, ","))).withColumn("fits", F.lit(False))
    return good.unionByName(bad)


def cleaning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was counted while the raw files, sales that don't fit among them, were cleaned."""
    sales = malformed_sales(spark, sf_dir)
    folder = raw_files(spark, sf_dir)
    files = {"print_sales": f"../{sales.rsplit('/', 1)[-1]}"}
    _, counts = job.clean_and_count(spark, folder, operators.scratch_dir(spark, "clean"), files=files)
    wanted = (F.col("metric") != "nulls") | (F.col("table") == "print_sales")
    return counts.where(wanted).select("table", F.coalesce("column", F.lit("")).alias("column"), "metric", "value")


def published_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table as published, after all were published at once, after a second attempt in
    which one of them failed, and after a third in which it was missing.

    The second and third hold fewer print sales; only the third replaces the tables.
    """
    folder = operators.scratch_dir(spark, "versions")
    star = bindings.star(spark, sf_dir)
    first = {f"{folder}/first/{name}.parquet": name for name in CLEAN}
    for path, name in first.items():
        write_clean(star[name], name, path)
    fewer, broken = f"{folder}/late/print_sales.parquet", f"{folder}/late/ad_revenue.parquet"
    write_clean(star["print_sales"].where("year >= 2022"), "print_sales", fewer)
    spark.range(1).selectExpr("'no Parquet' as value").write.text(broken)
    late = {p: n for p, n in first.items() if n not in ("print_sales", "ad_revenue")} | {fewer: "print_sales"}
    database = "together_" + folder.rsplit("-", 1)[-1][:12]
    parts = []
    try:
        attempts = {"first": first, "failed": late | {broken: "ad_revenue"}, "missing": late | {f"{folder}/none.parquet": "ad_revenue"}}
        for step, manifest in attempts.items():
            try:
                statuses = publish_together(spark, manifest, f"{folder}/published", database)
            except PublishError as error:
                statuses = spark.createDataFrame(error.statuses, STATUS_SCHEMA)
            for r in statuses.collect():
                # A view stands for the files of the version that it named when it was asked.
                rows = spark.table(f"{database}.{r.table}").agg(F.count(F.lit(1)).alias("rows"))
                parts.append(rows.select(F.lit(step).alias("step"), F.lit(r.table).alias("table"), F.lit(r.status).alias("status"), "rows"))
        return reduce(DataFrame.unionByName, parts)
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS `{database}` CASCADE")


def unread_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters and months that are there but cannot be read, per raw table."""
    counts = job.unread_labels({name: read(spark, sf_dir) for name, read in _QUALITY.items()})
    return counts.select("table", "column", F.col("value").alias("unread"))


# ---- cleaning -------------------------------------------------------------------------------


def _last_purchase(df: DataFrame) -> DataFrame:
    """Events with a column that only purchases set."""
    return df.select(
        "event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("props")).alias("last")
    )


def rate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion by a joined rate table, for codes kept as they came."""
    rates = spark.sql(
        "SELECT * FROM VALUES ('USD', 88.14D), ('EUR', 103.39D), ('INR', 1D) AS r(currency, rate)"
    )
    raw = bindings.raw_ad_revenue(spark, sf_dir)
    converted = operators.in_rupees(raw, "ad_revenue", "currency", "ad_revenue_inr", rates)
    return converted.select("o_orderkey", "currency", "ad_revenue_inr")


def keyed_ad_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_ad_revenue(bindings.raw_ad_revenue(spark, sf_dir))


def _from_raw(question: str, table: str, **parameters) -> Query:
    """A question over one table cleaned from its raw form, the dimensions as they are."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cleaned = cleaning.CLEANERS[table](_raw(table)(spark, sf_dir))
        tables = {"ad_category": bindings.ad_category(spark, sf_dir), table: cleaned}
        return QUESTIONS[question](tables, **parameters)

    return run


# A notation beyond those understood by default, with its format.
DAY_FIRST = {r"^\d{2}/\d{2}/\d{4}$": "dd/MM/yyyy"}


def state_trend_mixed_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State trend of raw sales whose states and codes come in mixed case and whose unread months
    are in a notation that the caller names."""
    raw = _raw("print_sales")(spark, sf_dir)
    lower = F.col("Copies Sold") % 2 == 0
    mixed = raw.withColumns(
        {
            "State": F.when(lower, F.lower("State")).otherwise(F.upper("State")),
            "edition_id": F.when(lower, F.lower("edition_id")).otherwise(F.col("edition_id")),
            "Month": F.when(F.col("Month").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.date_format(F.try_to_date("Month"), "dd/MM/yyyy"))
            .otherwise(F.col("Month")),
        }
    )
    formats = DATE_FORMATS | DAY_FIRST
    cleaned = cleaning.clean_print_sales(mixed, {"(?i)uttar[- ]pradesh": "Uttar Pradesh"}, formats)
    answer = QUESTIONS["q1_state_trend"]({"print_sales": cleaned})
    return answer.withColumn("State", F.upper("State"))


# ---- joins, windows, scalar functions ---------------------------------------------------------


def fanout_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = bindings.star(spark, sf_dir)
    sums = operators.fanout_sums(
        star["print_sales"],
        star["ad_revenue"],
        on=["edition_id", "year"],
        group_by=["State", "year"],
        left_sums={"net": F.sum("Net_Circulation")},
        right_sums={"revenue": money_sum("ad_revenue_inr")},
    )
    return sums.select(
        "State", "year", F.col("net").cast("long").alias("net"), F.col("revenue").cast("double")
    )


def net_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and means of prices after discount, which have more decimals than an amount."""
    lines = bindings.source(spark, sf_dir, "lineitem").withColumn(
        "net", F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000
    )
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        rounded(money_sum("net"), 4).alias("net"), rounded(exact_mean("net"), 8).alias("mean")
    )


def hot_part_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity and items by brand and return flag, with every even line item moved to part 1, so that
    one key holds more than two fifths of the fact."""
    moved = F.when(F.col("l_linenumber") % 2 == 0, F.lit(1).cast("long")).otherwise(F.col("l_partkey"))
    lines = bindings.source(spark, sf_dir, "lineitem").select(
        moved.alias("p_partkey"), "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"
    )
    parts = bindings.source(spark, sf_dir, "part")
    joined = operators.sliced_join(
        lines, parts, ["p_partkey"], rows_per_slice=4096, told_by=["l_orderkey", "l_linenumber"]
    )
    return joined.groupBy("p_brand", "l_returnflag").agg(
        F.count(F.lit(1)).alias("items"), money_sum("l_quantity").cast("double").alias("quantity")
    )


def huge_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of prices of which those of first lines are moved up by 60 bits, beyond any long of
    hundredths; as text, as a double holds no such sum."""
    first = F.col("l_linenumber") == 1
    huge = F.floor("l_extendedprice").cast("double") * F.lit(float(1 << 60))
    signed = F.when(F.col("l_tax") > 0.04, -huge).otherwise(huge)
    lines = bindings.source(spark, sf_dir, "lineitem")
    price = F.when(first, signed).otherwise(F.col("l_extendedprice"))
    sums = lines.groupBy("l_returnflag", "l_linestatus").agg(wide_sum(price).alias("total"))
    return sums.withColumn("total", F.col("total").cast("decimal(38,2)").cast("string"))


def order_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = bindings.source(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    return operators.global_row_number(orders, order, "position")


def order_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = bindings.source(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    return operators.global_ntile(orders, 4, order, "quartile")


def largest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines ranked up to 5 by quantity: many share the highest rank, and all of them stay."""
    lines = bindings.source(spark, sf_dir, "lineitem")
    columns = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"]
    return operators.rank_at_most(lines.select(*columns), "l_quantity", 5, "quantity_rank")


def best_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's best year of orders, null unless every year has some."""
    years = range(1995, 2002)
    orders = bindings.source(spark, sf_dir, "orders")
    yearly = orders.groupBy("o_custkey").agg(
        *[
            F.max(F.when(F.year("o_orderdate") == y, F.col("o_totalprice"))).alias(f"y{y}")
            for y in years
        ]
    )
    return yearly.select("o_custkey", strict_greatest(*[f"y{y}" for y in years]).alias("best"))


def month_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = bindings.print_sales(spark, sf_dir)
    return sales.groupBy(month_key("year", "month_num").alias("month")).agg(
        F.sum("Copies_Sold").alias("sold")
    )


def half_even_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line prices after discount in eighths, where ties are common."""
    lines = bindings.source(spark, sf_dir, "lineitem")
    eighth = F.floor("l_extendedprice") + F.col("l_quantity") / 8
    return lines.groupBy("l_orderkey").agg(
        F.sum(half_even(eighth).cast("decimal(18,2)")).cast("double").alias("amount")
    )


def states_ignoring_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = operators.case_insensitive(_raw("print_sales")(spark, sf_dir), "State")
    sums = sales.groupBy("State").agg(F.sum("Net_Circulation").alias("net"))
    return sums.select(F.lower(F.collate("State", "UTF8_BINARY")).alias("state"), "net")


_QUALITY = {
    name: _raw(name) for name in ("ad_revenue", "city_readiness", "digital_plot", "print_sales")
}
_MOMENTS = ("mean", "std", "p25", "p50", "p75")

QUERIES |= {
    "s1_csv_round_trip": csv_round_trip,
    "s2_every_format": every_format,
    "s1_columns_by_name": reordered_files,
    "s1_malformed_rows": split_sales,
    "s1_cleaning_counts": cleaning_counts,
    "s3_load_all": loaded_shapes,
    "s7_published_answer": published_answer,
    "s8_published_together": published_together,
    "q6_from_files": answer_from_files,
    "s10_print_sales": _star_table("print_sales"),
    "s11_ad_revenue": _star_table(
        "ad_revenue", "edition_id", "ad_category", "year", "quarter_num", "ad_revenue", "ad_revenue_inr"
    ),
    "s12_city_data": _star_table("city_data"),
    "s13_ad_category": _star_table("ad_category"),
    "s13_city_readiness": _star_table("city_readiness"),
    "s13_digital_plot": _star_table("digital_plot"),
    "d1_null_counts": _per_table(operators.null_counts, **_QUALITY),
    "d2_duplicate_rows": _per_table(
        operators.duplicate_rows,
        **_QUALITY,
        lineitem=_source("lineitem", "l_orderkey", "l_linenumber"),
    ),
    "d3_shape": _per_table(operators.shape, **_QUALITY),
    "d4_column_types": _per_table(
        operators.column_types, ad_revenue=_raw("ad_revenue"), digital_plot=_raw("digital_plot")
    ),
    "d5_numeric_profile": _then(
        _per_table(
            operators.numeric_profile,
            lineitem=_source("lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax"),
            ad_revenue=_raw("ad_revenue"),
        ),
        lambda df: _rounded(df, *_MOMENTS),
    ),
    "d6_categorical_profile": _per_table(
        operators.categorical_profile, ad_revenue=_raw("ad_revenue"), events=_source("events")
    ),
    "d_whole_profile": _then(
        _per_table(operators.profile, digital_plot=_raw("digital_plot")),
        lambda df: _rounded(df, "value"),
    ),
    "d7_forward_fill": _then(
        _source("events"), lambda df: operators.forward_fill(_last_purchase(df), "last", "event_id")
    ),
    "d7_forward_fill_sparse": _then(
        _source("events"),
        lambda df: operators.forward_fill(
            _last_purchase(df).withColumn("place", F.col("event_id") * 2**20), "last", "place"
        ).drop("place"),
    ),
    "d7_forward_fill_by_user": _then(
        _source("events"),
        lambda df: operators.forward_fill(_last_purchase(df), "last", "event_id", ["user_id"]),
    ),
    "a1_sums_of_long_decimals": net_prices,
    "a1_sums_of_huge_amounts": huge_prices,
    "d8_constant_fill": _then(
        bindings.raw_ad_revenue,
        lambda df: cleaning.fill_missing_comments(df).select("o_orderkey", "comments"),
    ),
    "d10_unread_labels": unread_counts,
    "d9_quarter_parts": _then(
        bindings.raw_ad_revenue,
        lambda df: cleaning.with_quarter_parts(df).select(
            "o_orderkey", "quarter", "year", "quarter_num"
        ),
    ),
    "d15_rate_table": rate_table,
    "d16_half_even": half_even_amounts,
    "d22_sample": _then(
        bindings.raw_ad_revenue,
        lambda df: operators.sample_rows(df, 10, seed=7, by=["o_orderkey"]),
    ),
    "d23_head": _then(_raw("city_readiness"), lambda df: operators.head(df, "row_id")),
    "d24_distinct_states": _then(
        _raw("print_sales"), lambda df: operators.distinct_values(df, "State")
    ),
    "d25_clean_ad_revenue": keyed_ad_revenue,
    "d25_clean_city_readiness": _then(_raw("city_readiness"), cleaning.clean_city_readiness),
    "d25_clean_digital_plot": _then(_raw("digital_plot"), cleaning.clean_digital_plot),
    "d25_clean_print_sales": _then(
        _raw("print_sales"),
        lambda df: cleaning.clean_print_sales(df).select(*CLEAN["print_sales"].names),
    ),
    "q1_from_raw": _from_raw("q1_state_trend", "print_sales"),
    "q1_from_mixed_case": state_trend_mixed_case,
    "q3_from_raw": _from_raw("q3_category_strength", "ad_revenue", amount="ad_revenue_inr"),
    "j1_hot_part_sums": hot_part_sums,
    "j3_fanout_sums": fanout_by_state,
    "w5_ntile": order_quartiles,
    "w6_row_number": order_positions,
    "w7_rank_at_most": largest_lines,
    "x5_strict_greatest": best_year,
    "x9_month_key": month_keys,
    "m2_case_insensitive": states_ignoring_case,
}

ORACLE: dict[str, str] = oracle.QUESTIONS | oracle.OPERATORS
