"""Writing cleaned tables and publishing them for queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CLEAN, PARTITIONED_BY
from .readers import format_of, load_table

STATUS_SCHEMA = "table string, source string, status string, message string"
_SET = "table string, path string"


class PublishError(RuntimeError):
    """Raised after all tables were tried; `statuses` has one row per table."""

    def __init__(self, statuses: list[tuple[str, str, str, str | None]]):
        failed = [f"{table}: {message}" for table, _, status, message in statuses if status == "failed"]
        super().__init__("; ".join(failed))
        self.statuses = statuses


def _laid_out(df: DataFrame, name: str) -> DataFrame:
    """Gather rows by partition column before a partitioned write; AQE splits the large ones.

    Without it every task would write a small file into every year; with a plain repartition one
    task would write a whole year.
    """
    columns = [c for c in PARTITIONED_BY.get(name, []) if c in df.columns]
    return df.hint("rebalance", *columns) if columns else df


def write_clean(df: DataFrame, name: str, path: str, fmt: str = "parquet") -> None:
    """Replace the stored form of a cleaned table: Parquet by default, CSV for exchange."""
    if fmt == "csv":
        df.write.mode("overwrite").options(header=True, escape='"').csv(path)
        return
    columns = [c for c in PARTITIONED_BY.get(name, []) if c in df.columns]
    writer = _laid_out(df, name).write.mode("overwrite").format(fmt)
    (writer.partitionBy(*columns) if columns else writer).save(path)


def create_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{where}")


def use_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    """Make `database` current, creating it first if need be."""
    create_database(spark, database, location)
    spark.catalog.setCurrentDatabase(database)


def publish(
    spark: SparkSession,
    manifest: dict[str, str],
    database: str,
    location: str | None = None,
) -> DataFrame:
    """Replace one table of `database` per manifest entry `path -> table`; a status row per entry.

    A missing path or an unsupported suffix is skipped, as a status. Other failures do not stop
    the remaining tables; they are raised together at the end. The database is created if need be;
    the session's current one stays.
    """
    create_database(spark, database, location)
    statuses = [
        (table, path, *_publish_one(spark, path, table, database))
        for path, table in manifest.items()
    ]
    if any(status == "failed" for _, _, status, _ in statuses):
        raise PublishError(statuses)
    return spark.createDataFrame(statuses, STATUS_SCHEMA)


def _publish_one(spark: SparkSession, path: str, table: str, database: str) -> tuple[str, str | None]:
    def replace(df: DataFrame, name: str) -> None:
        columns = PARTITIONED_BY.get(name, [])
        writer = _laid_out(df, name).write.mode("overwrite")
        (writer.partitionBy(*columns) if columns else writer).saveAsTable(f"`{database}`.`{name}`")

    return _written(spark, path, table, replace)


def _written(
    spark: SparkSession, path: str, table: str, write: Callable[[DataFrame, str], None]
) -> tuple[str, str | None]:
    """Status and message of loading a table and writing it."""
    if format_of(path) is None:
        return "unsupported", f"unsupported file format: {path}"
    try:
        write(load_table(spark, table, path, schema=CLEAN.get(table)), table)
    except Exception as error:  # kept as a status; the publishers raise it once all tables were tried
        analysis = isinstance(error, AnalysisException)
        missing = analysis and error.getCondition() == "PATH_NOT_FOUND"
        return ("missing" if missing else "failed"), str(error).partition("\n")[0]
    return "published", None


def current_set(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, dict[str, str]]:
    """(version, table -> path) of the set published last below `folder`, or of the version named;
    (0, none) before the first."""
    try:
        sets = spark.read.schema(f"{_SET}, version int").parquet(f"{folder.rstrip('/')}/sets")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    if version is None:
        version = sets.agg(F.max("version")).first()[0] or 0
    return version, {r.table: r.path for r in sets.where(F.col("version") == version).collect()}


def read_set(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of one version, by default the last: all of them published together."""
    _, paths = current_set(spark, folder, version)
    return {
        table: load_table(spark, table, path, "parquet", schema=CLEAN[table]).select(*CLEAN[table].names)
        if table in CLEAN
        else spark.read.parquet(path)
        for table, path in paths.items()
    }


def publish_together(
    spark: SparkSession, manifest: dict[str, str], folder: str, database: str | None = None
) -> DataFrame:
    """Replace all tables of a manifest `path -> table` in one step, or none; a status row per entry.

    Tables are first written below `folder`, where nobody reads them. Only when all are there, one
    small file names the new version's paths: readers of `read_set` see the set before it or the set
    after it, never a mixture and never a missing table. If a table fails, PublishError tells the
    statuses of all and the set before it stays. A table whose path is missing or unsupported is
    skipped, as a status, and keeps its last version, as tables do that the manifest does not name.
    `database` gets a view of each table; views follow one by one. Old versions stay until the caller
    deletes them, for queries that still read them and for `point_to`.
    """
    last, paths = current_set(spark, folder)
    fresh = f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"
    statuses, staged = [], {}
    for path, table in manifest.items():
        status, message = _written(spark, path, table, lambda df, t: write_clean(df, t, f"{fresh}/{t}"))
        if status == "published":
            staged[table] = f"{fresh}/{table}"
        statuses.append((table, path, status, message))
    if any(status == "failed" for _, _, status, _ in statuses):
        raise PublishError([(t, p, "staged" if s == "published" else s, m) for t, p, s, m in statuses])
    _point(spark, folder, last + 1, paths | staged, database)
    return spark.createDataFrame(statuses, STATUS_SCHEMA)


def point_to(spark: SparkSession, folder: str, version: int, database: str | None = None) -> None:
    """Publish an earlier version again, as the newest one."""
    last, _ = current_set(spark, folder)
    found, paths = current_set(spark, folder, version)
    if not paths:
        raise ValueError(f"{folder} has no version {version}")
    _point(spark, folder, last + 1, paths, database)


def _point(spark: SparkSession, folder: str, version: int, paths: dict[str, str], database: str | None) -> None:
    # One file, which its writer moves into place whole; a second writer of this version fails.
    named = spark.createDataFrame(list(paths.items()), _SET).coalesce(1)
    named.write.mode("error").parquet(f"{folder.rstrip('/')}/sets/version={version}")
    if database:
        create_database(spark, database)
        for table, path in paths.items():
            columns = ", ".join(f"`{c}`" for c in CLEAN[table].names) if table in CLEAN else "*"
            spark.sql(f"CREATE OR REPLACE VIEW `{database}`.`{table}` AS SELECT {columns} FROM parquet.`{path}`")


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> None:
    """Replace a table of an external database, each partition over its own connection."""
    df.write.jdbc(url, table, mode="overwrite", properties=properties or {})
