"""Forward fill along a row number, spread over many tasks.

A window over the whole order would be one task. Instead the order column is cut into blocks of
2**16 numbers; row numbers are unique, so no block can hold more rows than that however the values
lie. Each block starts from a head, the last value of all blocks before it, which joins its rows as
one more row in front; then a window inside the block does the rest. The heads come from a table
of one row per block, by the same step on blocks of blocks: four levels cover every 64-bit number.

It is plain column arithmetic on the data, so a recomputed task gets the same blocks. The rows are
shuffled once and joined with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_BITS = 16
_TOP = 48


def forward_fill(
    df: DataFrame, column: str, order_by: str, partition_by: list[str] | None = None
) -> DataFrame:
    """Replace nulls of `column` by the last non-null value before them in `order_by`.

    A null or repeated row number is an error when the query runs: the order would be a guess.

    `order_by` is a whole-number column without nulls, unique within `partition_by` (the file's
    row number). Leading nulls stay. `partition_by` fills each group on its own.
    """
    if order_by not in df.columns:
        raise ValueError(f"forward fill needs the row order; no column {order_by!r}")
    if not isinstance(df.schema[order_by].dataType, T.IntegralType):
        raise TypeError(f"{order_by} must be a whole-number column")
    keys = list(partition_by or [])
    missing = F.raise_error(F.lit(f"{order_by} is null")).cast("long")
    position = F.coalesce(F.col(order_by).cast("long"), missing)
    values = df.select(*keys, position.alias("_position"), F.col(column).alias("_value"))
    heads = _heads(values, keys, _BITS).withColumnRenamed("_value", column)
    rows = df.withColumns({"_block": F.shiftright(position, _BITS), "_row": F.lit(True)})
    block = Window.partitionBy(*keys, "_block").orderBy(F.asc_nulls_first(order_by))
    upto = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    repeated = F.raise_error(F.lit(f"{order_by} is not unique")).cast("boolean")
    filled = (
        rows.unionByName(heads, allowMissingColumns=True)
        .withColumns(
            {
                column: F.last(column, ignorenulls=True).over(upto),
                "_last": F.lag(order_by).over(block),
            }
        )
        .where("_row")
    )
    # The row number itself carries the check, so that no column pruning can drop it.
    unique = F.when(F.col("_last") == F.col(order_by), repeated).otherwise(F.lit(True))
    return filled.where(unique).select(*df.columns)


def _heads(values: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """(keys, _block, _value): per block of positions, the last value of the blocks before it."""
    last = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_position")))
    tails = values.groupBy(*keys, F.shiftright("_position", _BITS).alias("_next")).agg(
        last.alias("_value")
    )
    tails = tails.withColumnRenamed("_next", "_position")
    group = [*keys]
    if bits < _TOP:
        above = _heads(tails, keys, bits + _BITS)
        parent = F.shiftright("_position", _BITS)
        tails = tails.withColumn("_block", parent).unionByName(above, allowMissingColumns=True)
        group = [*keys, "_block"]
    before = (
        Window.partitionBy(*group)
        .orderBy(F.asc_nulls_first("_position"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = tails.withColumn("_value", F.last("_value", ignorenulls=True).over(before))
    own = carried.where(F.col("_position").isNotNull())  # without the heads from above
    return own.select(*keys, F.col("_position").alias("_block"), "_value")
