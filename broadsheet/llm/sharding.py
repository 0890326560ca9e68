"""Proportional stratified interleaving: every shard has the mixture of the whole.

Rows are ranked in a seeded shuffle of their stratum, `(rank - 1/2) / rows of the stratum` is their
fractional rank, and the rows in order of it are cut into shards of equal counts. Each stretch of
that order holds the strata in proportion, to within a row of each.

No rank is taken over a whole stratum or over all rows: the shuffle hash and the fractional rank
are spread evenly, so their leading bits cut each order into `buckets` stretches of like size. Rows
are numbered inside a stretch, and a table of one row per stretch says how many lie before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shuffle_hash(seed: str, *columns: Column) -> Column:
    """60 evenly spread bits of the columns' text, nulls as empty text."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _numbered(
    rows: DataFrame, group: list[str], bucket: str, order: list[Column], position: str, total: str
) -> DataFrame:
    """Add `position` (from 0) along bucket and order within the group, and the group's `total`."""
    counts = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("__rows"))
    of_group = Window.partitionBy(*group)
    before = of_group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *[F.col(c).alias(f"__c_{c}") for c in (*group, bucket)],
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"),
        F.sum("__rows").over(of_group).alias(total),
    )
    inside = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order)) - 1
    same = F.lit(True)
    for c in (*group, bucket):
        same = same & F.col(c).eqNullSafe(F.col(f"__c_{c}"))
    return (
        rows.withColumn("__inside", inside)
        .join(counts, same)
        .withColumn(position, F.col("__inside") + F.col("__before"))
        .drop("__inside", "__before", *[f"__c_{c}" for c in (*group, bucket)])
    )


def interleaved_shards(
    rows: DataFrame,
    stratum: str,
    identity: list[str],
    shards: int,
    seed: str = "shards",
    buckets: int = 4096,
) -> DataFrame:
    """`rows` with `shard` (0 to shards - 1) and `slot` (from 0, gapless within its shard).

    Shards differ by one row at most. A null stratum is a stratum of its own. `identity` names the
    columns that tell rows apart; rows equal in them and in the stratum are interchangeable, each
    gets a slot. Columns named shard or slot are replaced; an empty table gives an empty result.
    `buckets`, a power of two, bounds a sort to about rows / buckets.
    """
    shift = 60 - (buckets.bit_length() - 1)
    rows = rows.drop("shard", "slot")
    spread = rows.withColumn("__hash", shuffle_hash(seed, *[F.col(c) for c in identity])).withColumn(
        "__bucket", F.shiftright("__hash", shift)
    )
    tie = [F.col("__hash"), *[F.col(c) for c in identity]]
    ranked = _numbered(spread, [stratum], "__bucket", tie, "__rank", "__of")
    fraction = (F.col("__rank") + F.lit(0.5)) / F.col("__of")
    cut = ranked.withColumn("__fraction", fraction).withColumn(
        "__stretch", F.floor(F.col("__fraction") * buckets)
    )
    # One row per stretch, so at most `buckets` rows are added up in one task.
    placed = _numbered(cut, [], "__stretch", [F.col("__fraction"), F.col(stratum), *tie], "__at", "__all")
    shard = F.expr(f"__at * {shards} div __all")
    first = F.expr(f"(shard * __all + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("__at") - first).cast("long"))
        .select(*rows.columns, "shard", "slot")
    )
