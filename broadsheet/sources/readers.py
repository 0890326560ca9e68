"""Reading tables under their fixed schemas."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import MULTILINE, RAW

FORMATS = ("csv", "parquet", "json", "orc")
#: The line of a CSV row that does not fit the schema, beside what could be read of it.
RESCUED = "_corrupt_record"

# Texts of a CSV cell that mean it is missing, beside the empty cell.
MISSING_MARKS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def format_of(path: str) -> str | None:
    """Format by suffix, Parquet for a path without one, None for an unsupported suffix."""
    file = path.rstrip("/").rsplit("/", 1)[-1]
    if "." not in file:
        return "parquet"
    suffix = file.rsplit(".", 1)[-1].lower()
    return suffix if suffix in FORMATS else None


def csv_options(name: str, multiline: bool | None = None) -> dict[str, str]:
    """Cells may hold quoted newlines only in tables known for it, or as the caller says; only
    those give up file splitting."""
    broken = name in MULTILINE if multiline is None else multiline
    return {
        "header": "true",
        "escape": '"',
        "multiLine": str(broken).lower(),
        "mode": "PERMISSIVE",
        # Every file's header is held against the order found in the first.
        "enforceSchema": "false",
    }


def csv_layout(
    spark: SparkSession, name: str, path: str, schema: T.StructType, multiline: bool | None = None
) -> tuple[T.StructType, dict[str, str]]:
    """The schema in the order of the file's header, and the header cell of each column wanted.

    Columns go by name; a blank first cell is the row number. Cells beyond the schema are read as
    text and left out; a missing or repeated name is an error.
    """
    options = csv_options(name, multiline) | {"header": "false"}
    first = spark.read.options(**options).csv(path).first()
    cells = [c or "" for c in first] if first else list(schema.names)
    wanted = {c: c for c in schema.names}
    if "row_id" in wanted and "row_id" not in cells and cells[0] == "":
        wanted["row_id"] = ""
    missing = [c for c, cell in wanted.items() if cells.count(cell) != 1]
    if missing or len(set(cells)) < len(cells):
        raise ValueError(f"{path}: columns {missing or 'that repeat'} in the header {cells}")
    types = {cell: schema[c].dataType for c, cell in wanted.items()}
    fields = [T.StructField(c, types.get(c, T.StringType())) for c in cells]
    return T.StructType(fields), wanted


def load_table(
    spark: SparkSession,
    name: str,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | None = None,
    missing_marks: tuple[str, ...] = MISSING_MARKS,
    multiline: bool | None = None,
    rescue: bool = False,
) -> DataFrame:
    """One table under its schema (raw by default), format by argument or by suffix.

    Columns of a CSV file go by the names in its header. Its texts that mark a missing value are
    read as null, and so is what is not a number in any format. `multiline` says whether cells may
    hold line breaks. A missing path, an unsupported format or a header without a column fails here.

    A row with cells too few or too many, or without a number where one is due, is kept with what
    could be read. `rescue` adds its line as the column RESCUED, null for rows that fit and in other
    formats. Only columns that a query asks for are parsed, so it should ask for all of them.
    """
    fmt = fmt or format_of(path)
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format for {path}; one of {', '.join(FORMATS)}")
    schema = schema or RAW[name]
    reader = spark.read.schema(schema).format(fmt)
    if fmt != "csv":
        rows = _numbers_or_null(reader.load(path))
        return rows.withColumn(RESCUED, F.lit(None).cast("string")) if rescue else rows
    layout, wanted = csv_layout(spark, name, path, schema, multiline)
    fields = [*layout.fields, *([T.StructField(RESCUED, T.StringType())] if rescue else [])]
    options = csv_options(name, multiline) | {"columnNameOfCorruptRecord": RESCUED}
    df = _in_order(spark.read.schema(T.StructType(fields)).options(**options).csv(path), layout, wanted)
    texts = [f.name for f in schema if isinstance(f.dataType, T.StringType)]
    marked = {c: F.when(~F.col(f"`{c}`").isin(*missing_marks), F.col(f"`{c}`")) for c in texts}
    return _numbers_or_null(df.withColumns(marked) if missing_marks and texts else df)


def _in_order(df: DataFrame, layout: T.StructType, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns under their names; a blank name cannot be referred to, so by place."""
    named = df.toDF(*[f"_{i}" for i in range(len(layout))], *df.columns[len(layout) :])
    places = {cell: f"_{i}" for i, cell in enumerate(layout.names)}
    rest = [F.col(c) for c in df.columns[len(layout) :]]
    return named.select(*[F.col(places[cell]).alias(c) for c, cell in wanted.items()], *rest)


def _numbers_or_null(df: DataFrame) -> DataFrame:
    """What is not a number, in a column of doubles, is missing."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    present = {c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c in doubles}
    return df.withColumns(present) if doubles else df


def load_all(
    spark: SparkSession,
    folder: str,
    fmt: str = "csv",
    files: dict[str, str] | None = None,
    schemas: dict[str, T.StructType] | None = None,
    multiline: tuple[str, ...] | None = None,
    rescue: bool = False,
) -> dict[str, DataFrame]:
    """All tables of a dataset; if one cannot be found the whole load fails.

    Each table is read from `<folder>/<table>.<fmt>` unless `files` names another file for it.
    `multiline` names the tables with line breaks in cells, instead of those known for it; `rescue`
    keeps the lines of rows that don't fit beside them.
    """
    return {
        name: load_table(
            spark,
            name,
            path_of(folder, name, fmt, files),
            schema=schema,
            multiline=None if multiline is None else name in multiline,
            rescue=rescue,
        )
        for name, schema in (schemas or RAW).items()
    }


def path_of(folder: str, name: str, fmt: str = "csv", files: dict[str, str] | None = None) -> str:
    return f"{folder.rstrip('/')}/{(files or {}).get(name, f'{name}.{fmt}')}"


def does_not_fit(schema: T.StructType) -> Column:
    """Whether a rescued row does not fit; asks for all columns, so that all are parsed."""
    return F.col(RESCUED).isNotNull() & (F.hash(*[F.col(f"`{c}`") for c in schema.names]) >= F.lit(-(2**31)))


def malformed_rows(
    spark: SparkSession, name: str, path: str, multiline: bool | None = None
) -> DataFrame:
    """Rows of a CSV file that do not fit the schema, with the offending text."""
    rows = load_table(spark, name, path, "csv", missing_marks=(), multiline=multiline, rescue=True)
    return rows.where(does_not_fit(RAW[name]))


def observing(df: DataFrame, wanted: dict[str, Column]) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """`df`, and the counts in `wanted` of its rows, to be asked for once it has been written.

    An empty table is told by its first row: adaptive execution may leave out what would observe it.
    """
    if df.isEmpty():
        return df, lambda: dict.fromkeys(wanted, 0)
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in wanted.items()]), lambda: {k: int(v) for k, v in seen.get.items()}


@dataclass(frozen=True)
class Split:
    """The rows of a file that fit its schema, those that don't, with their lines, and how many
    there are of each."""

    good: DataFrame
    bad: DataFrame
    counts: dict[str, int]


def split_rows(
    spark: SparkSession, name: str, path: str, folder: str, multiline: bool | None = None
) -> Split:
    """Read a CSV table once, writing rows that fit the schema and rows that don't apart.

    Both go to `folder` as Parquet, parted by whether they fit; the counts are observed on the way.
    """
    rows = load_table(spark, name, path, "csv", multiline=multiline, rescue=True)
    bad = does_not_fit(RAW[name])
    wanted = {"rows": F.count(F.lit(1)), "malformed": F.count_if(bad)}
    observed, counts = observing(rows, wanted)
    observed.withColumn("malformed", bad).write.partitionBy("malformed").parquet(folder)
    schema = T.StructType([*rows.schema.fields, T.StructField("malformed", T.BooleanType())])
    parts = spark.read.schema(schema).parquet(folder)
    good = parts.where(~F.col("malformed")).drop("malformed", RESCUED)
    return Split(good, parts.where("malformed").drop("malformed"), counts())
