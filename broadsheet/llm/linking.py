"""Groups of similar sets from shared keys, without making all pairs within a group.

`components` joins links into groups by alternating stars. `linked_groups` finds the links: nodes
that share keys are candidates, and candidates are verified on their whole sets. In crowded keys
the most central member is compared with all others first, and nodes already in one group are never
compared again, so a group of any size costs about one comparison a member. Sets in a crowd that are
too much their own to be similar to any other there, or to a given one, are not compared; every
other pair of candidates in different groups still is. Nothing is collected; keys are joined on, so
a hot key is split like any skewed join.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.operators.pinning import pin

from .common import small, stored


#: Rows of links that one task holds.
_TASK_ROWS = 1 << 20


def _star(links: DataFrame, before: DataFrame | None = None, turns: int | None = None) -> DataFrame:
    """(u, v), v < u, with the same components as the links (a, b) and the star `before` together.

    Large and small stars by turns: every link is moved to the least neighbour of its smaller end, then
    every node and its smaller neighbours are linked with the least of those. Without `turns` this goes
    on until nothing changes, about the logarithm of the longest path in turns: then `v` is the smallest
    node of the component of `u`. Each turn is checkpointed, in partitions that fit the number of links,
    which no turn raises.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if before is not None:
        edges = edges.union(before)
    edges = pin(edges.distinct())
    signature = None
    while turns is None or turns > 0:
        state = edges.agg(
            F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")
        ).first()
        if state == signature:
            break
        signature = state
        down = edges.groupBy(F.col("u").alias("end")).agg(F.min("v").alias("m"))
        large = edges.join(down, F.col("v") == F.col("end"), "left")
        large = large.select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = pin(moved.union(least).distinct().coalesce(state[0] // _TASK_ROWS + 1))
        turns = turns and turns - 1
    return edges


def components(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(node, component) of every node of the links (a, b) and of `before`, a star of some of them; a
    component is its smallest node."""
    found = _star(links, before).select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(found.select("component", "component").distinct())


#: The (node, items) of the nodes of a one-column table; items are sorted and distinct.
Sets = Callable[[DataFrame], DataFrame]


def verified(pairs: DataFrame, sets_of: Sets, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union.

    Only the sets of nodes in pairs are made, once, and moved to their pairs: grouped by node, they
    already lie as the joins need them, and Spark uses their shuffle for both.
    """
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = sets_of(nodes)
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    # By Spark itself, row by row: batches of sets for Python would take a hundred megabytes a task. The
    # items that only the second set has stand once in the condition, as they are looked for at each place.
    further, nx, ny = F.size(F.array_except("y", "x")), F.size("x").cast("long"), F.size("y").cast("long")
    return both.where(100 * ny - percent * nx >= (100 + percent) * further.cast("long")).select("a", "b")


def linked_groups(
    members: DataFrame, sets_of: Sets, percent: int, crowd: int = 32, rounds: int = 3
) -> DataFrame:
    """(node, component) of the nodes linked to another by `percent` similar sets.

    `members` has (node, n, key, need): a set of n items holds the key, and similar sets share at
    least the smaller `need` of theirs.
    """
    # Two sets share at most what either shares with anyone, and have at least that similarity.
    most = "least(n - lone, n2 - lone2)"
    near = F.expr(
        f"100 * least(n, n2) >= {percent} * greatest(n, n2) and 100 * {most} >= {percent} * (n + n2 - {most})"
    )
    star, placed = None, None
    rest, crowded = _crowded(members, sets_of, percent, crowd)

    def rows(of: DataFrame) -> DataFrame:
        if placed is None:
            return of.withColumn("c", F.col("node"))
        return of.join(small(placed), "node", "left").withColumn(
            "c", F.coalesce("component", "node")
        ).drop("component")

    for turn in range(rounds if crowded is not None else 0):
        now = rows(crowded)
        # The most central member that is in no group yet: of its items the fewest are its own.
        central = F.struct("lone", F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "c")
        alone = F.col("c") == F.col("node") if placed is not None else F.lit(True)
        hubs = stored(
            now.groupBy("key")
            .agg(
                F.count(F.lit(1)).alias("held"),
                F.min("c").alias("low"),
                F.max("c").alias("high"),
                F.min(F.when(alone, central)).alias("hub"),
            )
            .where(f"held >= {crowd} and low <> high and hub is not null")
            .select(
                "key",
                F.col("hub.node").alias("b"),
                F.col("hub.n").alias("n2"),
                F.col("hub.c").alias("c2"),
                F.col("hub.lone").alias("lone2"),
            ),
            "hubs",
        )
        met = now.join(small(hubs), "key").where("c <> c2").where(near)
        pairs = stored(met.select(F.col("node").alias("a"), "b").distinct(), "hub-pairs")
        if pairs.isEmpty():
            break
        # Two turns join nearly all of what hubs link. Equal labels are in one group; what these leave
        # apart is compared needlessly, no more.
        star = _star(pin(verified(pairs, sets_of, percent)), star, turns=2)
        labels = star.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        placed = pin(labels.coalesce(star.count() // _TASK_ROWS + 1))

    everyone = rest if crowded is None else rest.unionByName(crowded)
    now = rows(everyone)
    if placed is not None:
        # Keys whose members are all in one group have nothing left to compare. Only those with a member
        # that has a group, or is one's smallest node, can be such.
        in_group = placed.select("node").union(placed.select("component")).distinct()
        touched = everyone.join(small(in_group), "node", "left_semi").select("key").distinct()
        closed = (
            now.join(small(stored(touched, "touched")), "key", "left_semi")
            .groupBy("key")
            .agg(F.min("c").alias("low"), F.max("c").alias("high"))
            .where("low = high")
            .select("key")
        )
        now = now.join(small(stored(closed, "closed")), "key", "left_anti")
    # Sizes of similar sets differ by less than one band, so a row meets its own and the next.
    width = math.log(100 / percent) * (1 + 1e-6)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int")
    now = now.withColumn("band", band)
    left = now.select("key", "band", F.col("node").alias("a"), "n", "c", "need", "lone")
    right = now.select(
        "key",
        F.explode(F.array("band", F.col("band") + 1)).alias("band"),
        F.col("node").alias("b"),
        F.col("n").alias("n2"),
        F.col("c").alias("c2"),
        F.col("need").alias("need2"),
        F.col("lone").alias("lone2"),
    )
    pairs = (
        left.join(right, ["key", "band"])
        .where("c <> c2 and (n2 < n or (n2 = n and b < a))")
        .where(near)
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("need", "need2")).alias("least"))
        .where("shared >= least")
        .select("a", "b")
    )
    return pin(components(pin(verified(stored(pairs, "pairs"), sets_of, percent)), star))


def _crowded(
    members: DataFrame, sets_of: Sets, percent: int, crowd: int
) -> tuple[DataFrame, DataFrame | None]:
    """The rows of `members` in keys that are no crowds, and those in crowds, or None without any.

    Added is `lone`: how many items of the set no other set in any crowded key has (0 elsewhere). Rows
    of sets with so many that none of those can be similar go.
    """
    columns = ["node", "n", "key", "need", "lone"]
    everyone = members.withColumn("lone", F.lit(0)).select(*columns)
    keys = members.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where(f"held >= {crowd}")
    keys = stored(keys.select("key"), "crowded")
    if keys.isEmpty():
        return everyone, None
    keys = small(keys)
    inside = stored(members.join(keys, "key"), "crowd")
    sets = sets_of(stored(inside.select("node").distinct(), "crowd-nodes"))
    items = sets.select("node", F.explode("items").alias("item"))
    single = items.groupBy("item").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).where("k = 1")
    lone = stored(single.groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("lone")), "lone")
    counted = inside.join(small(lone), "node", "left").withColumn("lone", F.coalesce("lone", F.lit(0)))
    kept = counted.where(f"100 * (n - lone) >= {percent} * n")
    return everyone.join(keys, "key", "left_anti"), stored(kept.select(*columns), "crowd-members")
