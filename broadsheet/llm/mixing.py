"""Sources mixed to target weights by a low-discrepancy schedule of equal-token blocks.

Every source gets a target in tokens: its weight's share of all, no more than `most` times what it
holds, the excess shared again by weight. A schedule of `2 ** m` slots, each of one block, says which
source comes when: slot i has the van der Corput point of i, its bits mirrored behind the point, and
the point falls into the stretch of one source among the cumulative targets. Any run of slots so
holds the sources in proportion, to within a few blocks.

The slots of a source, ranked, take its blocks in turn: its documents in a seeded shuffle, end to end,
pass after pass, cut into blocks of equal tokens (to within one, as the blocks of all sources add
up to the tokens there are). A document's stretch of a block is a piece; pieces meet their slots by
source and rank.

As the points of all slots are the multiples of `2 ** -m`, a source's slots are those of a run of
mirrored numbers: they are enumerated from the run, in chunks, and nothing is matched by ranges. Ranks
and places are running sums over parts of an even order, so a source may hold most of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.operators.ordering import global_row_number, running_total
from broadsheet.operators.pinning import pin

from .common import stored
from .sharding import shuffle_hash

_CHUNK = 1 << 14
_PARTS = 12
_WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mixture:
    """`rows` (row, id, source_number, size), `sources` (source_number, source, source_size, weight,
    target, slots) and `pieces` (slot, source_number, rank, row, pass, first_token, n_tokens)."""

    rows: DataFrame
    sources: DataFrame
    pieces: DataFrame


def _wide(value: Column | int) -> Column:
    return (value if isinstance(value, Column) else F.lit(str(value))).cast("decimal(38,0)")


def _div(a: Column, b: Column) -> Column:
    """The whole quotient of two wide numbers."""
    return F.call_function("div", a, b)


def water_level(sources: DataFrame, total: int, most: int) -> tuple[int, int]:
    """(numerator, denominator) of the tokens per unit of weight at which the targets add up to
    `total`, none above `most` times its source.

    Sources above the level are stopped and the rest is shared anew, until none is above: a pass
    over the table of sources each time, of which the driver gets two sums.
    """
    above, level = F.lit(False), None
    while True:
        held = F.lit(most) * F.col("source_size")
        sums = sources.agg(
            F.sum(F.when(above, _wide(held)).otherwise(_wide(0))),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))),
        ).first()
        found = (total - int(sums[0] or 0), int(sums[1] or 0))
        if found == level or not found[1]:
            return level or (0, 1)
        level = found
        above = _wide(held) * _wide(level[1]) < _wide(F.col("weight")) * _wide(level[0])


def mirrored(number: Column, bits: int) -> Column:
    """The number with its bits in reverse: the van der Corput point, times `2 ** bits`."""
    return F.conv(F.reverse(F.lpad(F.bin(number), bits, "0")), 2, 10).cast("long")


def mixture(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    block: int = 64,
    seed: str = "mix",
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> Mixture:
    """The mixture of all rows of `docs`, as long as all of them together, in words.

    Sources in order of their code points, a null one last and apart from the empty one, have the
    weights in turn. Blocks have more than half of `block` words, `block` at most; a source's pieces add up
    to its target to within one of them. No row is taken more than `most` times. Null and empty texts
    have no words and no pieces; so has an empty table. Rows that repeat id and text are
    interchangeable, each has its own number; a null id is as good as any. Other columns are left
    out, so none can clash. Reruns give the same pieces.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    slim = docs.select(
        F.col(doc_id).alias("id"),
        F.col(source).alias("source"),
        words.alias("size"),
        shuffle_hash(seed, F.col(doc_id), digest).alias("hash"),
    )
    slim = stored(slim.withColumn("row", F.monotonically_increasing_id()), "sizes")

    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = global_row_number(sizes, [F.col("source").isNull(), F.col("source")], "source_number")
    turn = ((F.col("source_number") - 1) % len(weights)).cast("int")
    weighted = pin(named.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), turn)))
    total = int(weighted.agg(F.sum("source_size")).first()[0] or 0)
    bits = max(1, (-(-total // block) - 1).bit_length())
    sources = _slots(weighted, total, most, bits)

    # One source's number is needed by each row: a table of one row a source.
    by_name = sources.select(F.col("source").alias("name"), "source_number", "source_size", "slots")
    numbered = slim.join(by_name, F.col("source").eqNullSafe(F.col("name"))).drop("source", "name", "id")
    rows = slim.join(by_name, F.col("source").eqNullSafe(F.col("name"))).select(
        "row", "id", "source_number", "size"
    )
    if not total:
        empty = "slot long, source_number long, rank long, row long, pass int, first_token long, n_tokens long"
        return Mixture(rows, sources, docs.sparkSession.createDataFrame([], empty))
    pieces = _pieces(numbered.where("size > 0"), total, most, bits)
    schedule = _schedule(sources, bits)
    # Both grow with the tokens, though they are made of small tables: neither is to be broadcast.
    scheduled = pieces.hint("merge").join(schedule, ["source_number", "rank"]).select(
        "slot", "source_number", "rank", "row", "pass", "first_token", "n_tokens"
    )
    return Mixture(rows, sources, scheduled)


def _slots(weighted: DataFrame, total: int, most: int, bits: int) -> DataFrame:
    """Add `target`, and the first of the source's mirrored slot numbers and how many there are."""
    over, under = water_level(weighted, total, most) if total else (0, 1)
    # Targets and their sums as whole numbers of `1 / under` tokens.
    most_held = _wide(F.lit(most) * F.col("source_size"))
    share = _wide(F.col("weight")) * _wide(over)
    capped = most_held * _wide(under) <= share
    units = F.when(capped, most_held * _wide(under)).otherwise(share)
    target = F.when(capped, most_held.cast("double")).otherwise(share.cast("double") / F.lit(float(under)))
    summed = running_total(
        weighted.withColumn("units", units).withColumn("target", target), "units", ["source_number"], "upto"
    )
    whole = _wide(max(1, 2 * total * under))

    def first_slot(upto: Column) -> Column:
        return _div(_wide(upto) * _wide(2 << bits) + _wide(total * under), whole)

    begun = first_slot(F.col("upto") - F.col("units"))
    return pin(
        summed.select(
            "source_number", "source", "source_size", "weight", "target",
            begun.alias("first"), (first_slot(F.col("upto")) - begun).alias("slots"),
        )
    )


def _schedule(sources: DataFrame, bits: int) -> DataFrame:
    """(slot, source_number, rank): the slots of every source, numbered from 0 as they come."""
    runs = sources.where("slots > 0").select(
        "source_number",
        (F.col("first") + F.col("slots")).alias("end"),
        F.explode(F.sequence("first", F.col("first") + F.col("slots") - 1, F.lit(_CHUNK).cast("long"))).alias("at"),
    )
    runs = runs.repartition("source_number", "at")
    last = F.least(F.col("end"), F.col("at") + _CHUNK) - 1
    slots = runs.select("source_number", F.explode(F.sequence("at", last)).alias("mirror"))
    slots = slots.select("source_number", mirrored(F.col("mirror"), bits).alias("slot"))
    # A source's slots are spread evenly, so leading bits part them evenly.
    part = F.shiftright("slot", max(0, bits - _PARTS))
    inside = F.row_number().over(Window.partitionBy("source_number", "part").orderBy("slot")) - 1
    parted = slots.withColumn("part", part).withColumn("inside", inside)
    before = Window.partitionBy("source_number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        slots.groupBy("source_number", part.alias("part"))
        .agg(F.count(F.lit(1)).alias("held"))
        .select("source_number", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    )
    ranked = parted.hint("merge").join(starts, ["source_number", "part"])
    return ranked.select("slot", "source_number", (F.col("start") + F.col("inside")).alias("rank"))


def _pieces(rows: DataFrame, total: int, most: int, bits: int) -> DataFrame:
    """(source_number, rank, row, pass, first_token, n_tokens): each row's stretch of each block."""
    placed = running_total(rows, "size", ["hash", "row"], "upto", by=["source_number"])
    passes = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass")
    shift = F.col("pass") * F.col("source_size")
    slots, all_tokens = _wide(1 << bits), _wide(total)
    ranged = (
        placed.select("*", passes)
        .withColumn("end", shift + F.col("upto"))
        .withColumn("begin", F.col("end") - F.col("size"))
        .withColumn("low", _div(_wide(F.col("begin") + 1) * slots - 1, all_tokens))
        .withColumn("high", F.least(_div(_wide(F.col("end")) * slots - 1, all_tokens), F.col("slots") - 1))
        .where("low <= high")
    )
    blocks = ranged.select(
        "source_number", "row", "pass", "begin", "end", F.explode(F.sequence("low", "high")).alias("rank")
    )

    def edge(rank: Column) -> Column:
        return _div(_wide(rank) * all_tokens, slots)

    first = F.greatest(F.col("begin"), edge(F.col("rank")))
    stop = F.least(F.col("end"), edge(F.col("rank") + 1))
    return blocks.select(
        "source_number", "rank", "row", "pass",
        (first - F.col("begin")).alias("first_token"), (stop - first).alias("n_tokens"),
    ).where("n_tokens > 0")
