"""Divergence between the sources of a language, by three-dimensional cube partitioning.

Terms are counted by (language, source); those in enough documents of a language are kept, and every
source has a smoothed share of each, a whole number of billionths. The divergence of source g from
source h is the sum over all kept terms of `(p - q) ** 2 / q`, rounded down term by term.

The sums over all pairs of sources and all terms form a cube, cut into cells: a block of sources, a
block of sources, a block of terms. A slice, the shares of one block of sources in one block of
terms, is replicated to the cells that need it; a cell is one task's group of bounded size and
gives the partial divergences of its pairs, both ways; these are added up along the axis of terms.
Shares of terms that a source doesn't have are all the same, so a slice lists the others only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, stored

_SCALE = 1_000_000_000
_HELD = 200_000
_LONG = 1 << 22
#: Letters in lower case and all bytes beyond ASCII stay, the rest is blank.
_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


@dataclass(frozen=True)
class Audit:
    """`groups` (lang, source, number, base: the share of a term it lacks), `pairs` (lang, source,
    other, p, value) and `terms` (lang, source, term, p, q, value) with a share above the language's."""

    groups: DataFrame
    pairs: DataFrame
    terms: DataFrame


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a few million bytes at a time."""
    at = 0
    while at < len(text):
        end = at + _LONG
        if end < len(text):
            # Only whole terms: up to the next byte that is none.
            while end < len(text) and _TERMS[text[end]] != 32:
                end += 1
        yield text[at:end].translate(_TERMS).split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of (lang, source, text): occurrences, and rows that have it.

    Tasks add up what they meet before anything is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Counter] = {}
        rows: dict[tuple, Counter] = {}

        def flushed() -> pa.RecordBatch:
            columns: list[list] = [[] for _ in range(5)]
            for (lang, source), counts in found.items():
                of = rows[lang, source]
                cells = ([lang] * len(counts), [source] * len(counts), counts, counts.values(), map(of.__getitem__, counts))
                for column, values in zip(columns, cells, strict=True):
                    column.extend(values)
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            arrays[2] = arrays[2].cast(pa.string())
            return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for key, text in zip(zip(langs, sources), batch.column("text").cast(pa.binary()), strict=True):
                counts, of = found.setdefault(key, Counter()), rows.setdefault(key, Counter())
                seen: set[bytes] = set()
                for words in words_of(text.as_py()):
                    counts.update(words)
                    seen.update(words)
                of.update(seen)
            if sum(map(len, found.values())) > _HELD:
                yield flushed()
                found, rows = {}, {}
        if found:
            yield flushed()

    counted = docs.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """`1 + floor(10 ** 9 * (count + 1) / (total + terms))` in whole numbers."""
    over = F.lit(_SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return (F.call_function("div", over, (total + terms).cast("decimal(20,0)")) + 1).cast("long")


def excess(p: Column, q: Column) -> Column:
    """`floor((p - q) ** 2 / q)`; shares are at most a little over 10 ** 9, so the square is whole."""
    return F.call_function("div", (p - q) * (p - q), q)


def _cell(group_block: int):
    def cell(key: tuple, rows: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        number = rows.column("number").to_numpy()
        p = rows.column("p").to_numpy()
        term = rows.column("term_id").to_numpy()
        header = term < 0
        groups, at = np.unique(number[header], return_index=True)
        bases = p[header][at]
        terms, column = np.unique(term[~header], return_inverse=True)
        # The last column stands for all terms of the block that none of these sources has.
        absent = int(rows.column("terms").to_numpy().max()) - len(terms)
        shares = np.repeat(bases[:, None], len(terms) + 1, axis=1)
        shares[np.searchsorted(groups, number[~header]), column] = p[~header]
        block = groups // group_block
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(len(groups)):
            others = np.flatnonzero((block == (high if block[i] == low else low)) & (groups != groups[i]))
            q = shares[others]
            parts = (shares[i] - q) ** 2 // q
            values = parts[:, :-1].sum(axis=1) + parts[:, -1] * absent
            found.append((np.full(len(others), groups[i]), groups[others], values))
        a, b, values = (np.concatenate([f[j] for f in found]).astype(np.int64) for j in range(3))
        return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "a": a, "b": b, "value": values})

    return cell


def divergences(groups: DataFrame, sizes: DataFrame, shares: DataFrame, group_block: int) -> DataFrame:
    """(lang, a, b, value): the divergence of every source from every other of its language.

    `groups` has (lang, number, group_blocks, base): numbers from 0, how many blocks of sources the
    language has, the share of an absent term. `sizes` has (lang, term_at, terms): every block of
    terms. `shares` has (lang, number, group_blocks, term_at, term_id, p).
    """
    # A slice tells its sources and how many terms there are, and the shares of those it has.
    columns = ["lang", "number", "group_blocks", "term_at", "term_id", "p", "terms"]
    headers = sizes.join(small(groups), "lang").withColumns(
        {"term_id": F.lit(-1).cast("long"), "p": F.col("base")}
    )
    entries = shares.withColumn("terms", F.lit(0).cast("long"))
    own = F.floor(F.col("number") / group_block)
    cells = (
        headers.select(*columns)
        .union(entries.select(*columns))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("group_blocks") - 1)))
        .withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
        .select("lang", "low", "high", "term_at", "number", "term_id", "p", "terms")
    )
    parts = cells.groupBy("lang", "low", "high", "term_at").applyInArrow(
        _cell(group_block), "lang string, a bigint, b bigint, value bigint"
    )
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame,
    least_docs: int = 3,
    group_block: int = 16,
    term_block: int = 8192,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
) -> Audit:
    """The divergences of all sources of each language, and the terms each has more than its share of.

    Terms are runs of letters and of characters beyond ASCII, lower-cased in A-Z. Null texts,
    languages and sources are empty ones. Every pair that occurs is a source, even without terms; in a
    language without kept terms all divergences are 0. Repeated rows count each; an empty table has no
    sources. Other columns are left out, so none can clash. Sums of divergences are long, which is
    enough while a language keeps fewer than 10 ** 9 terms.
    """
    read = [F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    plain = docs.select(*read)
    counts = stored(term_counts(plain), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    kept = stored(
        kept.where(F.col("docs") >= least_docs)
        .select("lang", "term", "lang_n")
        .withColumn("term_id", F.monotonically_increasing_id()),
        "kept-terms",
    )
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    of_lang = stored(of_lang, "languages")
    held = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "term_id", "n", "lang_n"), "kept-counts")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    everyone = plain.select("lang", "source").distinct()
    of = Window.partitionBy("lang")
    numbers = F.row_number().over(of.orderBy("source")) - 1
    groups = everyone.join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.na.fill(0, ["total", "kept", "lang_total"]).withColumns(
        {"number": numbers.cast("long"), "group_blocks": F.ceil(F.count(F.lit(1)).over(of) / group_block)}
    )
    # Without kept terms there is no share to speak of.
    none = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).otherwise(1)
    groups = stored(groups.withColumn("base", none.cast("long")), "groups")

    shares = held.join(small(groups.drop("base")), ["lang", "source"]).withColumns(
        {
            "p": share(F.col("n"), F.col("total"), F.col("kept")),
            "q": share(F.col("lang_n"), F.col("lang_total"), F.col("kept")),
        }
    )
    terms = shares.where("p > q").select("lang", "source", "term", "p", "q", excess(F.col("p"), F.col("q")).alias("value"))

    blocks = F.ceil(F.col("kept") / term_block)
    block = F.pmod(F.xxhash64("term"), blocks)
    filled = kept.join(small(of_lang), "lang").groupBy("lang", block.alias("term_at")).agg(F.count(F.lit(1)).alias("terms"))
    # A language without kept terms has one empty block.
    every = groups.select("lang", "kept").distinct()
    last = F.greatest(F.lit(1).cast("long"), blocks) - 1
    every = every.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("term_at"))
    sizes = every.join(filled, ["lang", "term_at"], "left").na.fill(0, ["terms"])
    sparse = shares.withColumn("term_at", block)
    found = divergences(groups, sizes, sparse, group_block)
    names = groups.select("lang", F.col("number"), "source")
    pairs = (
        found.join(names.withColumnRenamed("number", "a"), ["lang", "a"])
        .join(names.select("lang", F.col("number").alias("b"), F.col("source").alias("other")), ["lang", "b"])
        .select("lang", "source", "other", "value")
    )
    return Audit(groups.select("lang", "source", "number", "base"), pairs, terms)
