"""Positions in one global order, without sorting it in a single task.

The rows are range-partitioned on the order, pinned, counted or summed per partition, and every
partition adds what lies before it. The table of partition sums has one row per partition and group,
so it stays small whatever the data does; a value that holds a large part of the rows is split as
long as a further order column tells its rows apart. The functions that pin run a job when called.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pinning import local_rows, pin


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ranged(
    df: DataFrame, weight: Column | str, order: list[Column], keys: list[str]
) -> tuple[DataFrame, DataFrame]:
    """The pinned range partitions, and per partition what lies before it, in it and in all."""
    parts = pin(
        df.withColumn("_weight", _column(weight))
        .repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn("_part", F.spark_partition_id())
    )
    group = Window.partitionBy(*keys)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy(*keys, "_part")
        .agg(F.sum("_weight").alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_sum").over(group))
    )
    return parts, offsets


def _within(
    parts: DataFrame, offsets: DataFrame, order: list[Column], keys: list[str], name: str
) -> DataFrame:
    """Add `name`, the running sum, to the rows of the partitions listed in `offsets`."""
    same = F.col("l._part") == F.col("r._part")
    for key in keys:
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    columns = [F.col(f"l.{c}") for c in parts.columns]
    located = parts.alias("l").join(offsets.alias("r"), same).select(*columns, "_offset", "_total")
    inside = (
        Window.partitionBy(*keys, "_part")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return located.withColumn(name, F.sum("_weight").over(inside) + F.col("_offset"))


def running_total(
    df: DataFrame,
    weight: Column | str,
    order_by: list[Column | str],
    name: str,
    by: list[str] | None = None,
    total: str | None = None,
) -> DataFrame:
    """Add `name`: the sum of `weight` up to and including the row, per `by`, along `order_by`.

    `order_by` must tell all rows of a group apart. `total` also adds the sum over the group.
    """
    keys, order = list(by or []), [_column(c) for c in order_by]
    parts, offsets = _ranged(df, weight, order, keys)
    summed = _within(parts, offsets, order, keys, name)
    return summed.select(*df.columns, name, *([F.col("_total").alias(total)] if total else []))


def _sorted_ranges(df: DataFrame, order: list[Column], group: list[str]) -> tuple[DataFrame, DataFrame]:
    """The pinned, sorted range partitions with each row's place in its own, and per partition and
    group the place of its first row and the rows before it in and in all of the group.

    The group leads the order. Rows are shuffled once; the second table has about one row per
    partition and group.
    """
    rows = pin(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    ).withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    of_group = Window.partitionBy(*group)
    before = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*group, "_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(of_group))
        .drop("_n")
    )
    return rows, starts


def global_row_number(
    df: DataFrame, order_by: list[Column | str], name: str, total: str | None = None
) -> DataFrame:
    """ROW_NUMBER() OVER (ORDER BY order_by) for any number of rows; the order must be total.

    `total` also adds the number of rows. Runs the shuffle and a checkpoint when called.
    """
    rows, starts = _sorted_ranges(df, [_column(c) for c in order_by], [])
    placed = rows.join(F.broadcast(starts), "_part")  # one row per partition
    position = F.col("_before") + F.col("_at") - F.col("_first") + 1
    totals = [F.col("_total").alias(total)] if total else []
    return placed.select(*df.columns, position.alias(name), *totals)


def _tile(position: str, total: str, n: int) -> Column:
    """NTILE from a position from 1: the first `total mod n` tiles get one row more."""
    at, rows = F.col(position) - 1, F.col(total)
    size, larger = F.floor(rows / n), rows % n
    inside_larger = at < larger * (size + 1)
    later = larger + F.floor((at - larger * (size + 1)) / F.greatest(size, F.lit(1)))
    return (F.when(inside_larger, F.floor(at / (size + 1))).otherwise(later) + 1).cast("int")


def global_ntile(df: DataFrame, n: int, order_by: list[Column | str], name: str) -> DataFrame:
    """NTILE(n) OVER (ORDER BY order_by) for any number of rows; the order must be total."""
    numbered = global_row_number(df, order_by, "_position", total="_rows")
    return numbered.select(*df.columns, _tile("_position", "_rows", n).alias(name))


def global_ntiles(df: DataFrame, n: int, key: str, orders: dict[str, tuple[str, bool]]) -> DataFrame:
    """NTILE(n) along several measures at once, from one shuffle and one checkpoint.

    `orders` maps an output name to a numeric column and whether it rises; ties go by `key`, which
    must be unique, and nulls come first in a rising order and last in a falling one, as Spark and
    most databases have it. (key, names...) is returned.
    """
    stacked = df.select(
        F.col(key).alias("_key"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("_measure"),
                        (F.col(c).isNull() != F.lit(rises)).alias("_late"),
                        # Whole numbers beyond 2**53 keep their order by the decimal.
                        (F.col(c) if rises else -F.col(c)).cast("double").alias("_double"),
                        (F.col(c) if rises else -F.col(c)).cast("decimal(38,10)").alias("_decimal"),
                    )
                    for name, (c, rises) in orders.items()
                ]
            )
        ).alias("_o"),
    ).select("_key", "_o.*")
    order = [F.col(c) for c in ("_measure", "_late", "_double", "_decimal", "_key")]
    rows, starts = _sorted_ranges(stacked, order, ["_measure"])
    placed = rows.join(F.broadcast(starts), ["_measure", "_part"])  # a few rows per partition
    position = F.col("_before") + F.col("_at") - F.col("_first") + 1
    tiled = placed.withColumn("_position", position).withColumn("_tile", _tile("_position", "_total", n))
    return tiled.groupBy(F.col("_key").alias(key)).agg(
        *[F.max(F.when(F.col("_measure") == name, F.col("_tile"))).alias(name) for name in orders]
    )


def rank_at_most(df: DataFrame, value: str, k: int, name: str) -> DataFrame:
    """Rows with RANK() OVER (ORDER BY value DESC) <= k, rank added as `name`; ties all stay.

    The first k rows by value (a distributed top-k) hold every value that can rank so high, and
    everything greater than such a value; the ranks are read off those k rows and joined back.
    So rows tied at a rank are never gathered in one task.
    """
    top = df.select(value).orderBy(F.desc(value)).limit(k)
    ranks = (
        top.withColumn(name, F.rank().over(Window.orderBy(F.desc(value))))
        .groupBy(value)
        .agg(F.min(name).alias(name))
    )
    same = F.col(f"l.{value}").eqNullSafe(F.col(f"r.{value}"))
    return (
        df.alias("l")
        .join(ranks.alias("r"), same)
        .select(*[F.col(f"l.{c}") for c in df.columns], F.col(f"r.{name}").alias(name))
    )


@dataclass
class _Search:
    """One wanted position of one column: the value there lies in `low` to `high`, both of them
    values of the column, with at most `inside` rows strictly between them."""

    column: str
    point: str
    rank: int
    share: float
    low: float
    high: float
    inside: float
    found: float | None = None

    def counts(self, value: Column) -> list[Column]:
        """Rows below, up to and including either end."""
        return [F.count_if(value < self.low), F.count_if(value <= self.low),
                F.count_if(value < self.high), F.count_if(value <= self.high)]

    def between(self, value: Column) -> Column:
        return F.when((value > self.low) & (value < self.high), value)

    def narrow(self, counted: tuple, values: list[float], total: int, ends: tuple, grid: int, accuracy: int) -> None:
        """Take the value found, or a closer bracket, from the counts and what lies between."""
        below, low_end, high_start, upto = counted
        last = self.rank + (self.share > 0)
        if not (below <= self.rank and last < upto):  # beyond what an approximation promises
            self.low, self.high, self.inside = *ends, total
            return
        all_here = len(values) == high_start - low_end

        def at(rank: int) -> float | None:
            if rank < low_end:
                return self.low
            if rank >= high_start:
                return self.high
            return values[rank - low_end] if all_here else None

        first, second = at(self.rank), at(last)
        if first is not None and second is not None:
            self.found = first if first == second else first + (second - first) * self.share
            return
        # The grid's values are off by up to `1 / accuracy` of the rows between; its ends are the least
        # and the largest of those, so each pass leaves fewer values strictly between.
        rows = high_start - low_end
        margin = 2 + -(-grid // accuracy)
        left = max(0, (self.rank - low_end) * grid // rows - margin)
        right = min(grid, -(-(last - low_end + 1) * grid // rows) + margin)
        self.low = self.low if self.rank < low_end else values[left]
        self.high = self.high if last >= high_start else values[right]
        self.inside = rows * ((right - left) / grid + 2 / accuracy) + 2


def quantile_search(
    df: DataFrame,
    columns: list[str],
    points: dict[str, float],
    extra: list[Column] | None = None,
    accuracy: int = 20_000,
    most: int = 10_000,
    grid: int = 1000,
) -> tuple[dict[str, dict[str, float | None]], Row]:
    """Linearly interpolated quantiles per column and point, nulls and NaN left out, and the row of
    `extra` aggregates, taken in the first pass.

    Distributed selection: a first pass brackets every position between two approximate quantiles,
    whose rank is wrong by at most rows / accuracy. Each further pass counts the rows below and at
    either end of the bracket and narrows it, by a grid of approximate quantiles of what lies between,
    some hundredfold. What is strictly between is known to be at most so many rows however the values
    tie; once that is no more than `most`, those rows are returned and the position is read off.
    Each pass is one aggregation over all columns without a shuffle of rows; the driver gets a row.
    """
    # Adding 0.0 makes one zero of two.
    values = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double") + 0.0) for c in columns}
    slack = 3 / accuracy
    ends = [e for p in points.values() for e in (max(0.0, p - slack), min(1.0, p + slack))]
    wanted = F.array(*[F.lit(e) for e in ends])
    firsts = [
        F.struct(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"),
                 F.percentile_approx(v, wanted, accuracy).alias("ends"))
        for v in values.values()
    ]
    row = df.agg(*[f.alias(f"_c{i}") for i, f in enumerate(firsts)], *(extra or [])).first()
    found: dict[str, dict[str, float | None]] = {c: dict.fromkeys(points) for c in columns}
    searches, limits = [], {}
    for i, c in enumerate(columns):
        n, least, greatest, near = row[f"_c{i}"]
        limits[c] = (n, (least, greatest))
        for j, (name, p) in enumerate(points.items()) if n else ():
            position = (n - 1) * float(p)
            rank = math.floor(position)
            low = near[2 * j] if p - slack > 0 else least
            high = near[2 * j + 1] if p + slack < 1 else greatest
            searches.append(_Search(c, name, rank, position - rank, low, high, n * (2 * slack + 2 / accuracy) + 2))
    # The brackets of a small column's three points may be the same; they are counted once each still.
    probabilities = F.array(*[F.lit(i / grid) for i in range(grid + 1)])
    while searches:
        parts = []
        for s in searches:
            v = values[s.column]
            inner = s.between(v)
            if s.inside <= most:
                held = F.array_sort(F.collect_list(inner))
            else:
                held = F.coalesce(F.percentile_approx(inner, probabilities, accuracy), F.array().cast("array<double>"))
            parts.append(F.struct(*[c.alias(f"n{i}") for i, c in enumerate(s.counts(v))], held.alias("held")))
        counted = df.agg(*[p.alias(f"_s{i}") for i, p in enumerate(parts)]).first()
        for i, s in enumerate(searches):
            *counts, held = counted[f"_s{i}"]
            s.narrow(tuple(counts), held, *limits[s.column], grid, accuracy)
            found[s.column][s.point] = s.found
        searches = [s for s in searches if s.found is None]
    return found, row


def exact_quantiles(
    df: DataFrame, columns: list[str], points: dict[str, float], accuracy: int = 20_000, most: int = 10_000
) -> DataFrame:
    """(column, <point names>...) of `quantile_search`, whose passes run when this is called."""
    found, _ = quantile_search(df, columns, points, accuracy=accuracy, most=most)
    rows = [(c, *of.values()) for c, of in found.items() if any(v is not None for v in of.values())]
    schema = ", ".join(["column string", *[f"{name} double" for name in points]])
    return local_rows(df.sparkSession, schema, rows)


def long_values(df: DataFrame, columns: list[str], dtype: str) -> DataFrame:
    """(column, value) rows of `columns`, nulls left out."""
    cast = df.select(*[F.col(f"`{c}`").cast(dtype).alias(c) for c in columns])
    return cast.unpivot([], [f"`{c}`" for c in columns], "column", "value").where(
        F.col("value").isNotNull()
    )
