"""The whole batch: raw files, quality profile, cleaning, published tables, answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse_date, quarter_number, quarter_year
from ..operators import counted, local_rows, profile
from ..schemas import CLEAN, RAW
from ..sources import (
    RESCUED,
    does_not_fit,
    load_all,
    observing,
    publish,
    publish_together,
    read_set,
    write_clean,
)
from .cleaning import clean_all
from .questions import QUESTIONS


def profile_all(
    tables: dict[str, DataFrame], quantiles: str = "exact", more: dict[str, list[Column]] | None = None
) -> DataFrame:
    """One quality table for a whole dataset, with further cells of some tables."""
    parts = [profile(df, name, quantiles, (more or {}).get(name)) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def unread_tests(date_formats: dict[str, str] | None = None) -> dict[str, dict[str, Column]]:
    """Per raw table and column, whether a quarter or month is there but cannot be read."""
    quarter = quarter_year("quarter").isNull() | quarter_number("quarter").isNull()

    def unread(column: str, test: Column) -> dict[str, Column]:
        return {column: F.col(column).isNotNull() & test}

    return {
        "ad_revenue": unread("quarter", quarter),
        "city_readiness": unread("quarter", quarter),
        "digital_plot": unread("launch_month", parse_date("launch_month", date_formats).isNull()),
        "print_sales": unread("Month", parse_date("Month", date_formats).isNull()),
    }


def unread_labels(
    tables: dict[str, DataFrame], date_formats: dict[str, str] | None = None
) -> DataFrame:
    """How many quarters and months of raw tables are there but cannot be read, in the shape of
    the profile: (table, column, metric, value, text)."""
    parts = [
        _figure(tables[t].agg(F.count_if(test).alias("n")), t, c, "unread")
        for t, tests in unread_tests(date_formats).items()
        for c, test in tests.items()
        if t in tables
    ]
    return reduce(DataFrame.unionByName, parts)


def _figure(counted: DataFrame, table: str, column: str | None, metric: str) -> DataFrame:
    return counted.select(
        F.lit(table).alias("table"),
        F.lit(column).cast("string").alias("column"),
        F.lit(metric).alias("metric"),
        F.col("n").cast("double").alias("value"),
        F.lit(None).cast("string").alias("text"),
    )


def clean_and_count(
    spark: SparkSession,
    raw_folder: str,
    clean_folder: str,
    date_formats: dict[str, str] | None = None,
    **load,
) -> tuple[dict[str, str], DataFrame]:
    """Load, clean and store every table as Parquet: the publish manifest, and what was counted on
    the way, in the shape of the profile: per raw table its rows, those that do not fit the schema,
    labels that cannot be read, and nulls per column.

    The counts are observed on the rows that are being cleaned, so a file is read once for all of it.
    """
    tests, manifest, cells = unread_tests(date_formats), {}, []
    for name, raw in load_all(spark, raw_folder, rescue=True, **load).items():
        wanted = {
            (None, "rows"): F.count(F.lit(1)),
            (None, "malformed"): F.count_if(does_not_fit(RAW[name])),
            **{(c, "unread"): F.count_if(test) for c, test in tests.get(name, {}).items()},
            **{(c, "nulls"): F.count_if(F.col(f"`{c}`").isNull()) for c in RAW[name].names},
        }
        observed, counts = observing(raw, {f"n{i}": count for i, count in enumerate(wanted.values())})
        cleaned = clean_all({name: observed.drop(RESCUED)}, date_formats)[name]
        path = f"{clean_folder.rstrip('/')}/{name}.parquet"
        write_clean(cleaned, name, path)
        manifest[path] = name
        cells += [(name, *w, float(n), None) for w, n in zip(wanted, counts().values(), strict=True)]
    return manifest, local_rows(spark, "table string, column string, metric string, value double, text string", cells)


def clean_to_files(
    spark: SparkSession,
    raw_folder: str,
    clean_folder: str,
    date_formats: dict[str, str] | None = None,
    **load,
) -> dict[str, str]:
    """Load, clean and store every table as Parquet; returns the publish manifest."""
    return clean_and_count(spark, raw_folder, clean_folder, date_formats, **load)[0]


def quality(
    spark: SparkSession, raw_folder: str, date_formats: dict[str, str] | None = None, **load
) -> DataFrame:
    """The profile of all tables before and after cleaning, with what could not be read before.

    (stage, table, column, metric, value, text); stage is `raw` or `clean`. Labels that cannot be
    read and rows that don't fit are counted in the first pass of the raw tables' profile.
    """
    rescued = load_all(spark, raw_folder, rescue=True, **load)
    raw = {name: df.drop(RESCUED) for name, df in rescued.items()}
    more = {t: [counted("unread", c, test) for c, test in tests.items()] for t, tests in unread_tests(date_formats).items()}
    if load.get("fmt", "csv") == "csv":
        for name in rescued:
            more.setdefault(name, []).append(counted("malformed", None, does_not_fit(RAW[name])))
    before = reduce(
        DataFrame.unionByName,
        [profile(df, name, columns=RAW[name].names, more=more.get(name)) for name, df in rescued.items()],
    ).withColumn("stage", F.lit("raw"))
    after = profile_all(clean_all(raw, date_formats)).withColumn("stage", F.lit("clean"))
    columns = ("stage", "table", "column", "metric", "value", "text")
    return before.unionByName(after).select(*columns)


def publish_quality(spark: SparkSession, raw_folder: str, database: str | None = None, **load) -> None:
    """Store the quality of the files as table `data_quality` of the database, by default the
    current one."""
    found = quality(spark, raw_folder, **load)
    found.write.mode("overwrite").saveAsTable(_qualified("data_quality", database))


def _qualified(table: str, database: str | None) -> str:
    return f"`{database}`.`{table}`" if database else table


def published(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """The published tables of a database, by default the current one."""
    return {name: spark.table(_qualified(name, database)) for name in CLEAN}


def answer_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every question over the given tables, not yet run."""
    return {name: ask(tables) for name, ask in QUESTIONS.items()}


def publish_answers(answers: dict[str, DataFrame], database: str | None = None) -> None:
    """Store answers as tables of a database, by default the current one, for dashboards to read."""
    for name, df in answers.items():
        df.write.mode("overwrite").saveAsTable(_qualified(name, database))


def run(
    spark: SparkSession, raw_folder: str, clean_folder: str, database: str, versions: str | None = None, **load
) -> dict[str, DataFrame]:
    """Raw files to answers, through the published tables of `database`.

    Tables are replaced one after the other. With `versions`, a folder, all of them are replaced in
    one step or none is, the database has views of them, and the answers are those of one version.
    """
    manifest = clean_to_files(spark, raw_folder, clean_folder, **load)
    if versions:
        publish_together(spark, manifest, versions, database)
        return answer_all(read_set(spark, versions))
    publish(spark, manifest, database)
    return answer_all(published(spark, database))
