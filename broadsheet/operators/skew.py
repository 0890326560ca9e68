"""Joins of facts with dimensions on keys of which some hold a large part of the fact.

Spark shuffles both sides by the key, so all rows of one key meet in one task; a broadcast avoids
that only while the dimension is small. Here a heavy key is cut into slices: each of its fact rows
goes to one slice, each slice gets a copy of the key's dimension rows, and the join is on key and
slice.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pinning import pin

#: Keys that may be cut; they travel to every task.
_MOST_HEAVY = 100_000
#: Slices over which rows without a key are spread.
_NULL_SLICES = 1 << 12


def sliced_join(
    fact: DataFrame,
    dimension: DataFrame,
    on: list[str],
    how: str = "inner",
    rows_per_slice: int = 1 << 20,
    told_by: list[str] | None = None,
) -> DataFrame:
    """`fact JOIN dimension USING (on)`, `how` inner or left, without a task per heavy key.

    A key with more than `rows_per_slice` fact rows is cut into slices of about that many. Rows go to
    slices by a hash of the columns in `told_by`, by default all: a recomputed task puts them in the
    same place, and only rows equal in all of them stay together. At most 100,000 keys are cut; where
    more are heavy, only those above their mean share of that number are, and the others stay whole.
    Rows are counted by key when this is called.

    Null keys meet nothing; with `how="left"` their rows are kept, spread over many tasks. Repeated
    rows of either side count as often as they occur. Apart from `on`, the two sides must not share a
    column name.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    clash = (set(fact.columns) & set(dimension.columns)) - set(on)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    keyless = reduce(or_, [F.col(c).isNull() for c in on])
    counts = fact.where(~keyless).groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    heavy = pin(counts.where(F.col("_rows") > rows_per_slice))
    keys, rows = heavy.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    if keys > _MOST_HEAVY:
        heavy = heavy.where(F.col("_rows") > rows / _MOST_HEAVY)
    slices = F.ceil(F.col("_rows") / rows_per_slice).cast("int")
    heavy = F.broadcast(
        heavy.select(*[F.col(c).alias(f"_heavy_{i}") for i, c in enumerate(on)], slices.alias("_slices"))
    )

    def with_slices(df: DataFrame) -> DataFrame:
        same = reduce(and_, [df[c] == F.col(f"_heavy_{i}") for i, c in enumerate(on)])
        return df.join(heavy, same, "left").select(*[df[c] for c in df.columns], "_slices")

    place = F.xxhash64(*(told_by or fact.columns))
    parts = F.when(keyless, F.lit(_NULL_SLICES)).otherwise(F.coalesce("_slices", F.lit(1)))
    left = with_slices(fact if how == "left" else fact.where(~keyless))
    left = left.withColumn("_slice", F.pmod(place, parts).cast("int")).drop("_slices")
    copies = F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)
    right = with_slices(dimension.where(~keyless)).withColumn("_slice", F.explode(copies)).drop("_slices")
    return left.join(right, [*on, "_slice"], how).drop("_slice")
