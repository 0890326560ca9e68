"""Jaccard similarity join on word shingles with adaptive multi-match prefixes.

Two sets whose Jaccard similarity reaches the threshold share at least `ceil(t * n)` of either's n
shingles. Under any one order of all shingles, they therefore share `l` of the first
`n - ceil(t * n) + l` of either: the l-prefix. A longer prefix costs more index rows and asks for
more shared shingles, so fewer candidates are verified. Each document picks the l whose estimated
cost is least; two documents must share as many as the smaller of their l.

The order is by hash, with crowded shingles last, so that a passage in many documents leads to no
candidates unless a document consists of little else. Counting every shingle would shuffle the
corpus several times over, so shingles are counted among the first of each document by hash
(`emitted`), which is enough to hold the prefix of most. Documents with too many crowded ones there
are looked at again whole, and the few shingles this adds are looked up among the others' too, so
that no pair is lost.

Equal sets are one node throughout; crowds of similar ones are joined without making all pairs
(`linking`).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shingle_hashes, small, stored, text_portions
from .linking import linked_groups

_PORTION = 1 << 20
#: Tables of so many shingle hashes, some thirty megabytes once hashed for a join, travel to every
#: task by way of the driver; larger ones are joined by a shuffle.
_FEW_TOKENS = 400_000


def required(n: int, percent: int) -> int:
    """The least overlap of a set of n items with any similar set."""
    return -(-percent * n // 100)


def emitted(n: int, percent: int, most_shared: int) -> int:
    """How many shingles of a set of n are indexed at first."""
    return min(n, n - required(n, percent) + most_shared + max(8, n // 30))


def chosen_prefix(
    n: int, ranks: np.ndarray, counts: np.ndarray, known: int, percent: int, most_shared: int, crowd: int
) -> tuple[int, np.ndarray] | None:
    """The best l, and which of the shared shingles are in the l-prefix.

    `ranks` are the places by hash of the shingles that others have too, `counts` how many have
    them, `known` is how many shingles by hash are known at all. None if those are too few.
    """
    # Crowded shingles come last, so where not all of the set is known they are beyond any prefix.
    crowded = counts >= crowd
    light = known - int(crowded.sum())
    last = light + np.cumsum(crowded) - 1 if known == n else n
    place = np.where(crowded, last, ranks - (np.cumsum(crowded) - crowded))
    if known == n:
        light = n
    needed = required(n, percent)
    best, best_cost = 0, np.inf
    for shared in range(1, min(most_shared, needed) + 1):
        if n - needed + shared > light:
            break
        scanned = float((counts[place < n - needed + shared] - 1).sum())
        # Each candidate shares at least that many, so there are at most scanned / shared of them;
        # verifying one costs about as much as scanning its set.
        cost = scanned + n - needed + shared + n * scanned / shared
        if cost < best_cost:
            best, best_cost = shared, cost
    if not best:
        return None
    return best, place < n - needed + best


def _signed(texts: list[bytes | None], words: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of every text."""
    for hashes in shingle_hashes([t or b"" for t in texts], words):
        yield np.unique(hashes)


def _portions(batches: Iterator[pa.Array]) -> Iterator[list[bytes | None]]:
    """The texts a portion at a time, as what is made of one is handed on before the next is unpacked."""
    for batch in batches:
        for _, part in text_portions(batch, _PORTION):
            yield part


def _digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def shingle_sets(docs: DataFrame, text: str, words: int, percent: int, most_shared: int) -> DataFrame:
    """Add `n`, `digest` (null without words) and `tokens`, the first shingles by hash."""

    @F.arrow_udf("struct<n:int,digest:binary,tokens:array<long>>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in _portions(batches):
            sizes, digests, tokens = [], [], []
            for items in _signed(texts, words):
                n = len(items)
                sizes.append(n)
                digests.append(_digest(items) if n else None)
                # A copy, as a view would keep the whole set in memory.
                tokens.append(items[: emitted(n, percent, most_shared)].view(np.int64).copy())
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), _lists(tokens, pa.int64())],
                ["n", "digest", "tokens"],
            )

    kept = [c for c in docs.columns if c != text]
    return docs.select(*kept, sign(F.col(text)).alias("s")).select(*kept, "s.*")


def whole_sets(docs: DataFrame, doc_id: str, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """(node, items) of the classes in `wanted` (node, doc, digest), from a document of each."""

    @F.arrow_udf("struct<digest:binary,items:array<long>>")
    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in _portions(batches):
            digests, items = [], []
            for found in _signed(texts, words):
                digests.append(_digest(found))
                # By signed value, as the verification compares them.
                items.append(np.sort(found.view(np.int64)))
            yield pa.StructArray.from_arrays(
                [pa.array(digests, pa.binary()), _lists(items, pa.int64())], ["digest", "items"]
            )

    ids = small(wanted.select("doc").distinct())
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    rows = rows.join(ids, F.col("id").eqNullSafe(F.col("doc")), "left_semi")
    # A deterministic function would move below this join, as the next one's test for nulls, and sign
    # every document.
    signed = rows.select(whole.asNondeterministic()("t").alias("w")).select("w.*")
    # Rows with one id may have several texts, and one class may be met again: one row a class.
    return (
        signed.join(small(wanted.select("node", "digest")), "digest")
        .groupBy("node")
        .agg(F.first("items").alias("items"))
    )


def _chosen(found: list[tuple[int, np.ndarray] | None]) -> pa.Array:
    levels = [f and f[0] for f in found]
    tokens = [f[1] if f else np.empty(0, np.int64) for f in found]
    return pa.StructArray.from_arrays([pa.array(levels, pa.int32()), _lists(tokens, pa.int64())], ["l", "tokens"])


def _choose(percent: int, most_shared: int, crowd: int):
    """The l and the tokens of the prefix of a set of n, from the first shingles that others have too."""

    @F.arrow_udf("struct<l:int,tokens:array<long>>")
    def choose(n: pa.Array, shared: pa.Array) -> pa.Array:
        prefixes = []
        for size, held in zip(n.to_pylist(), shared, strict=True):
            values = held.values
            ranks = values.field("rank").to_numpy()
            order = np.argsort(ranks)
            counts = values.field("df").to_numpy()[order]
            have = emitted(size, percent, most_shared)
            found = chosen_prefix(size, ranks[order], counts, have, percent, most_shared, crowd)
            names = values.field("token").to_numpy()[order]
            prefixes.append(found and (found[0], names[found[1]]))
        return _chosen(prefixes)

    return choose


def _choose_whole(percent: int, most_shared: int, crowd: int):
    """The same from a whole set; shingles that are not among those counted are its own."""

    @F.arrow_udf("struct<l:int,tokens:array<long>>")
    def choose(items: pa.Array, counted: pa.Array) -> pa.Array:
        prefixes = []
        for held, known in zip(items, counted, strict=True):
            # In the order of the first look, which is by unsigned value.
            names = np.sort(held.values.to_numpy().view(np.uint64))
            counts = np.ones(len(names), np.int64)
            if known.is_valid:
                tokens = known.values.field("token").to_numpy().view(np.uint64)
                counts[np.searchsorted(names, tokens)] = known.values.field("df").to_numpy()
            n = len(names)
            found = chosen_prefix(n, np.arange(n), counts, n, percent, most_shared, crowd)
            prefixes.append(found and (found[0], names[found[1]].view(np.int64)))
        return _chosen(prefixes)

    return choose


def jaccard_groups(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    doc_id: str = "doc_id",
    text: str = "text",
    most_shared: int = 6,
    crowd: int = 64,
    carry: list[str] | None = None,
) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents joined by `percent` similar shingle sets.

    Shingles are runs of `words` words of the text lower-cased in A-Z; a text with fewer words has
    one, the whole. A null text or one without words has none, is linked with nothing and is its
    own component. The component is the smallest id reachable by links. Rows are kept one by one:
    repeated rows and ids each get theirs. A null id counts for links but never names a component,
    unless none of it has an id. Other columns are left out, so none can clash, but for those in
    `carry`, which follow `component`: a number of the component that it has even without any id,
    null for a text without words.
    """
    plain = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kept = [(c, f"kept_{i}") for i, c in enumerate(carry or [])]
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *[F.col(c).alias(k) for c, k in kept])
    signed = stored(shingle_sets(rows, "text", words, percent, most_shared), "shingles")
    # A class is named by its smallest id; one without any by a number from its digest.
    unnamed = F.expr("-1 - (xxhash64(digest) & 9223372036854775806)")
    classes = stored(
        signed.where("digest is not null")
        .groupBy("digest")
        .agg(F.min("id").alias("doc"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.coalesce("doc", unnamed)),
        "classes",
    )
    # One id may stand on several texts: such classes are told apart by the digest.
    shared_names = classes.groupBy("node").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("node")
    if shared_names.isEmpty():
        shared_names = None
    else:
        renamed = F.when(F.col("again").isNull(), F.col("node")).otherwise(unnamed)
        again = shared_names.select("node", F.lit(True).alias("again"))
        classes = stored(
            classes.join(again, "node", "left").withColumn("node", renamed).drop("again"), "classes"
        )

    # Tokens are taken from one row of each class, by leaving out the other rows.
    copied = classes.where("copies > 1").select("digest", "doc")
    others = signed.select("id", "digest").join(copied, "digest")
    others = stored(others.where(~F.col("id").eqNullSafe(F.col("doc"))).select("id", "digest").distinct(), "copies")
    other = small(others.select(F.col("id").alias("other_id"), F.col("digest").alias("other_digest")))
    same = (F.col("digest") == F.col("other_digest")) & F.col("id").eqNullSafe(F.col("other_id"))
    named = F.coalesce("id", unnamed) if shared_names is None else None
    ones = signed.where("digest is not null").join(other, same, "left_anti")
    if named is None:
        by_digest = small(classes.where("node <> doc").select("digest", F.col("node").alias("renamed")))
        ones = ones.join(by_digest, "digest", "left")
        named = F.coalesce("renamed", "id", unnamed)
    rows = ones.select(named.alias("node"), "n", F.posexplode("tokens").alias("rank", "token"))
    counts = stored(
        rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts"
    )
    # The size of a set is not moved with each of its shingles.
    held = rows.select("node", "rank", "token").join(counts, "token")
    shared = held.groupBy("node").agg(F.collect_list(F.struct("rank", "token", "df")).alias("shared"))
    shared = shared.join(classes.select("node", "n"), "node")
    choose = _choose(percent, most_shared, crowd)
    # Those that are looked at again keep the counts found here.
    seen = F.when(F.col("p.l").isNull(), F.transform("shared", lambda x: F.struct(x["token"].alias("token"), x["df"].alias("df"))))
    chosen = shared.select("node", "n", "shared", choose("n", "shared").alias("p"))
    first = stored(chosen.select("node", "n", "p.*", seen.alias("seen")), "prefixes")

    # Documents whose first shingles are crowded: their whole sets.
    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = classes.select("node", "doc", "digest").join(small(nodes), "node", "left_semi")
        return whole_sets(plain, "id", "text", words, stored(wanted, "wanted"))

    short_sets = stored(sets_of(first.where("l is null").select("node")), "short-sets")
    looked = short_sets.join(first.where("l is null").select("node", "seen"), "node")
    listed = looked.select("node", F.explode(F.array_except("items", "seen.token")).alias("token"))
    counted = listed.join(counts, "token").groupBy("node").agg(F.collect_list(F.struct("token", "df")).alias("more"))
    again = _choose_whole(percent, most_shared, crowd)
    second = stored(
        looked.join(counted, "node", "left")
        .withColumn("counted", F.when(F.col("more").isNull(), F.col("seen")).otherwise(F.concat("seen", "more")))
        .select("node", F.size("items").alias("n"), again("items", "counted").alias("p"))
        .select("node", "n", "p.*"),
        "second-prefixes",
    )
    prefix = first.where("l is not null").drop("seen").unionByName(second)
    members = prefix.select("node", "n", F.col("l").alias("need"), F.explode("tokens").alias("key"))
    # What only the second look found may stand, counted once, among the others' first shingles. Sizes
    # of similar sets differ by less than one band, so of the others only those of a band beside are met:
    # a passage of many documents makes up few of them.
    width = math.log(100 / percent) * (1 + 1e-6)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int")
    seconds = second.select(F.explode("tokens").alias("token"), band.alias("band"))
    seconds = seconds.join(counts, "token", "left_anti")
    beside = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    # Near copies have most of them in common, so each is met once before its bands are.
    added = stored(seconds.select("token", "band").distinct().select("token", beside).distinct(), "added")
    met = (
        rows.withColumn("band", band)
        .join(small(added, _FEW_TOKENS), ["token", "band"], "left_semi")
        .join(small(second.select("node")), "node", "left_anti")
        .join(small(first.select("node", "l")), "node", "left")
        .select("node", "n", F.coalesce("l", F.lit(1)).alias("need"), F.col("token").alias("key"))
    )
    # Keys that only one set holds lead to no pair; few are, as prefixes are of shingles that others have.
    members = stored(members.union(met).distinct(), "members")
    # Only keys of crowded shingles are crowds, which few documents have in their prefix.
    groups = linked_groups(members.select("node", "n", "key", "need"), sets_of, percent, crowd)

    named = classes.select("node", "digest", "doc").join(groups, "node", "left")
    linked = named.where("component is not null")
    smallest = linked.groupBy("component").agg(F.min("doc").alias("smallest"))
    linked = linked.join(smallest, "component").select("digest", "smallest", "component")
    single = named.where("component is null").select("digest", F.col("doc").alias("smallest"), F.col("node").alias("component"))
    further = ["component", *[F.col(k).alias(c) for c, k in kept]] if carry else []
    return (
        signed.select("id", "n", "digest", *[k for _, k in kept])
        .join(linked.union(single), "digest", "left")
        .select(
            F.col("id").alias(doc_id),
            F.col("n").cast("long").alias("n_shingles"),
            F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("smallest")).alias("component_id"),
            *further,
        )
    )
