"""Sums over a many-to-many join without making the joined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COUNT = T.DecimalType(18, 0)
_WHOLE = T.DecimalType(20, 0)


def fanout_sums(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    group_by: list[str],
    left_sums: dict[str, Column],
    right_sums: dict[str, Column],
    multiply: bool = True,
) -> DataFrame:
    """`SELECT group_by, SUM(...) FROM left JOIN right USING (on) GROUP BY group_by`.

    `left_sums` and `right_sums` map an output name to a sum over one side, such as
    `F.sum("copies")`, of a whole or decimal type; `group_by` names columns of `left` (the join
    keys included). Each side is summed and counted per key before the join: a row of one side
    occurs in the join as often as the other side has rows for its key, so each sum is weighted by
    the other side's row count. The shuffles therefore carry one row per key, and a key that holds
    a large part of a table is combined map-side.

    With `multiply=False` the weights are left out: every source row counts once, which is the
    ratio-safe reading of the same question.
    """
    extra = [c for c in group_by if c not in on]
    per_left = _summed(left, [*on, *extra], left_sums, "_left_rows")
    per_right = _summed(right, on, right_sums, "_right_rows")

    def weighted(name: str, rows: str) -> Column:
        total = F.col(name) * F.col(rows) if multiply else F.col(name)
        return F.sum(total).alias(name)

    return (
        per_left.join(per_right, on)
        .groupBy(*group_by)
        .agg(
            *[weighted(name, "_right_rows") for name in left_sums],
            *[weighted(name, "_left_rows") for name in right_sums],
        )
    )


def _summed(df: DataFrame, keys: list[str], sums: dict[str, Column], rows: str) -> DataFrame:
    """Sums and row count per key, whole numbers widened for the products to come."""
    summed = df.groupBy(*keys).agg(
        F.count(F.lit(1)).cast(_COUNT).alias(rows),
        *[total.alias(name) for name, total in sums.items()],
    )
    whole = [n for n in sums if isinstance(summed.schema[n].dataType, T.IntegralType)]
    return summed.withColumns({n: F.col(n).cast(_WHOLE) for n in whole})
