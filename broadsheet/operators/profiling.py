"""Data-quality profile of a table, as rows rather than prints."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import long_values, quantile_search
from .pinning import FEW_BYTES, checked, local_rows, pin

_CATEGORICAL = "table string, column string, count long, unique long, top string, freq long"
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def _missing(df: DataFrame, column: str) -> Column:
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def null_counts(df: DataFrame, name: str) -> DataFrame:
    """(table, column, nulls) for every column, NaN counted as missing; one pass."""
    counts = df.agg(*[F.count_if(_missing(df, c)).alias(c) for c in df.columns])
    return counts.unpivot([], [f"`{c}`" for c in df.columns], "column", "nulls").select(
        F.lit(name).alias("table"), "column", "nulls"
    )


def duplicate_rows(df: DataFrame, name: str, digest: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """(table, duplicates): rows beyond the first of each set of equal rows, nulls equal.

    A first pass counts digests of 128 bits, so only those are shuffled. Rows whose digest was met
    twice are compared whole in a second pass; a table without any needs none. The first pass runs
    when this is called.
    """
    marked = df.withColumn("_digest", (digest or row_digest)(df))
    counts = marked.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"))
    met = pin(counts.where("_n > 1").select("_digest"))
    if not (n := met.count()):
        return local_rows(df.sparkSession, "table string, duplicates long", [(name, 0)])
    few = F.broadcast(met) if 16 * n <= FEW_BYTES else met
    groups = marked.join(few, "_digest", "left_semi").groupBy(*[f"`{c}`" for c in df.columns])
    return (
        groups.agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))
        .select(F.lit(name).alias("table"), "duplicates")
    )


def row_digest(df: DataFrame) -> Column:
    """128 bits of a row as two longs, the same for rows that group as equal."""
    cells = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        # One zero of two; the hash leaves nulls out, so they are told beside.
        double = isinstance(field.dataType, (T.DoubleType, T.FloatType))
        cells += [c + F.lit(0.0) if double else c, c.isNull()]
    return F.struct(*_hashes(*cells))


def shape(df: DataFrame, name: str) -> DataFrame:
    """(table, rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns")
    )


def column_types(df: DataFrame, name: str) -> DataFrame:
    """(table, column, type, rows) from the schema, beside the number of rows it describes."""
    types = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type")) for c, t in df.dtypes]
    return (
        df.agg(F.count(F.lit(1)).alias("rows"))
        .select(F.explode(F.array(*types)).alias("_t"), "rows")
        .select(F.lit(name).alias("table"), "_t.column", "_t.type", "rows")
    )


def numeric_profile(df: DataFrame, name: str, quantiles: str = "exact") -> DataFrame:
    """(table, column, count, mean, std, min, p25, p50, p75, max) per numeric column.

    The exact quartiles are searched for when this is called, in two passes over a table of up to
    some millions of rows, in a few more over any other; the first gives the other figures too.
    `quantiles="approx"` replaces them by approx_percentile, which stays within one pass.
    """
    columns = numeric_columns(df)
    values = {c: F.when(~_missing(df, c), F.col(f"`{c}`").cast("double")) for c in columns}

    def figures(c: str) -> Column:
        v = values[c]
        parts = [
            F.lit(c).alias("column"),
            F.count(v).alias("count"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
        ]
        if quantiles == "approx":
            parts += [F.percentile_approx(v, p).alias(q) for q, p in QUARTILES.items()]
        return F.struct(*parts)

    rows = F.array(*[figures(c) for c in columns]).alias("_f")
    if quantiles == "exact":
        found, first = quantile_search(df, columns, QUARTILES, [rows])
        cells = [(name, *f[:5], *found[f.column].values(), f.max) for f in first["_f"]]
        schema = ", ".join(f"{c} double" for c in ("mean", "std", "min", *QUARTILES, "max"))
        return local_rows(df.sparkSession, f"table string, column string, count long, {schema}", cells)
    rows = df.agg(rows).select(F.explode("_f").alias("_f")).select("_f.*")
    return rows.select(
        F.lit(name).alias("table"), "column", "count", "mean", "std", "min", *QUARTILES, "max"
    )


def categorical_profile(df: DataFrame, name: str) -> DataFrame:
    """(table, column, count, unique, top, freq) per text column; ties for top: smallest value.

    Values are counted by 128 bits of hash, so no text is shuffled. The hashes that are met most
    often survive, and a second pass takes the smallest text among theirs, which each task reduces
    to one a column; only where so many tie that they can't be broadcast are texts shuffled. A column
    without a repeated value needs its smallest only. The passes run when this is called; the driver
    gets a row a column.
    """
    spark, columns = df.sparkSession, text_columns(df)
    if not columns:
        return local_rows(spark, _CATEGORICAL, [])
    hashed = long_values(df, columns, "string").select("column", "value", *_hashes("value"))
    counts = pin(hashed.groupBy("column", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    figures = counts.groupBy("column").agg(F.sum("n"), F.count(F.lit(1)), F.max("n")).collect()
    repeated = {c: freq for c, _, _, freq in figures if freq > 1}
    plain = [c for c, *_ in figures if c not in repeated]
    tops = df.agg(*[F.min(F.col(f"`{c}`").cast("string")) for c in plain]).first() if plain else []
    top = dict(zip(plain, tops, strict=True))
    if repeated:
        often = reduce(lambda a, b: a | b, [(F.col("column") == c) & (F.col("n") == n) for c, n in repeated.items()])
        survivors = checked(counts.where(often).select("column", "x", "y"), 40)
        met = hashed.join(survivors, ["column", "x", "y"]).groupBy("column").agg(F.min("value"))
        top |= dict(map(tuple, met.collect()))
    return local_rows(spark, _CATEGORICAL, [(name, c, n, unique, top[c], freq) for c, n, unique, freq in figures])


def _hashes(*columns: Column | str) -> list[Column]:
    """Two independent hashes of the columns, as x and y."""
    return [F.xxhash64(F.lit(seed), *columns).alias(n) for seed, n in ((0, "x"), (1, "y"))]


def profile(
    df: DataFrame,
    name: str,
    quantiles: str = "exact",
    more: list[Column] | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """The whole profile in long form: (table, column, metric, value, text).

    Table-wide metrics have a null column. Numbers are in `value`, types and top values in `text`.
    Shape, null counts, types, moments, the first brackets of the exact quartiles and any `more`
    cells come out of one pass over the table, made when this is called. `columns` are those to
    describe, all by default; `more` may look at others.
    """
    whole, df = df, df.select(*[f"`{c}`" for c in columns or df.columns])
    numeric, text = numeric_columns(df), text_columns(df)
    numeric_metrics = ["count", "mean", "std", "min", "max"]

    def facts(c: str) -> Column:
        v = F.when(~_missing(df, c), F.col(f"`{c}`").cast("double")) if c in numeric else None
        figures = [f(v) for f in (F.count, F.avg, F.stddev_samp, F.min, F.max)] if c in numeric else []
        cells = [
            _cell(c, "nulls", F.count_if(_missing(df, c))),
            _cell(c, "type", text=F.lit(dict(df.dtypes)[c])),
            *[_cell(c, m, f) for m, f in zip(numeric_metrics, figures)],
        ]
        return F.array(*cells)

    table_cells = F.array(
        _cell(None, "rows", F.count(F.lit(1))), _cell(None, "columns", F.lit(len(df.columns))), *(more or [])
    )
    cells = F.concat(table_cells, *[facts(c) for c in df.columns]).alias("_cells")
    exact = quantiles == "exact"
    found, first = quantile_search(whole, numeric if exact else [], QUARTILES, [cells])
    known = [tuple(cell) for cell in first["_cells"]]
    known += [(c, q, v, None) for c, of in found.items() for q, v in of.items() if v is not None]
    parts = [
        local_rows(df.sparkSession, "column string, metric string, value double, text string", known),
        duplicate_rows(df, name).select(
            F.inline(F.array(_cell(None, "duplicates", F.col("duplicates"))))
        ),
    ]
    if numeric and not exact:
        parts.append(_cells_of(numeric_profile(df, name, quantiles).select("column", *QUARTILES), list(QUARTILES)))
    if text:
        parts.append(
            _cells_of(categorical_profile(df, name), ["count", "unique", "freq"], text=["top"])
        )
    cells = reduce(DataFrame.unionByName, parts)
    return cells.select(F.lit(name).alias("table"), "column", "metric", "value", "text")


def counted(metric: str, column: str | None, test: Column) -> Column:
    """A further cell of a profile: the rows of which a test holds."""
    return _cell(column, metric, F.count_if(test))


def _cell(
    column: str | Column | None, metric: str, value: Column | None = None, text: Column | None = None
) -> Column:
    return F.struct(
        (column if isinstance(column, Column) else F.lit(column)).cast("string").alias("column"),
        F.lit(metric).alias("metric"),
        (F.lit(None) if value is None else value).cast("double").alias("value"),
        (F.lit(None) if text is None else text).cast("string").alias("text"),
    )


def _cells_of(df: DataFrame, metrics: list[str], text: list[str] | None = None) -> DataFrame:
    """One row per column and metric of a wide per-column table."""
    cells = [_cell(F.col("column"), m, F.col(m)) for m in metrics]
    cells += [_cell(F.col("column"), m, text=F.col(m)) for m in text or []]
    return df.select(F.inline(F.array(*cells)))
