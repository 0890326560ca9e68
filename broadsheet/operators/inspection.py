"""Looking at a table: sample, head, distinct values; and text keys that ignore case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_rows(
    df: DataFrame, n: int = 10, seed: int = 0, by: list[str] | None = None
) -> DataFrame:
    """n random rows, planned as a distributed top-k on a hash of the seed and the row.

    The same rows come out however the table is split. `by` names columns that tell rows apart;
    without it all of them do, nulls as such, and only equal rows are interchangeable.
    """
    null = F.lit("\x1e")
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), null) for c in by or df.columns]
    return df.orderBy(F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *parts))).limit(n)


def head(df: DataFrame, order_by: str, n: int = 5) -> DataFrame:
    """First n rows of the file order."""
    return df.orderBy(order_by).limit(n)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, null included."""
    return df.select(column).distinct()


def case_insensitive(df: DataFrame, *columns: str) -> DataFrame:
    """Give text columns a collation under which joins and grouping ignore case."""
    return df.withColumns({c: F.collate(c, "UTF8_LCASE") for c in columns})
