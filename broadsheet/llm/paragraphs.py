"""Substring dedup by paragraphs: MinHash banding, exact Jaccard, removals by component.

A paragraph is a line of at least `min_words` words, which spares headings and boilerplate lines.
Equal paragraphs (by lower-case words) are one class. Classes are signed by MinHash over shingles
of five words in bands of `rows`; paragraphs that collide in a band are joined and verified by the
exact Jaccard similarity of their shingles. With ten bands of three, a pair at 0.8 collides with
probability 1 - (1 - 0.8 ** 3) ** 10 = 0.9992. Of every component the first paragraph, by id and
place, stays, and all others are removed.

A passage may be a small part of the paragraphs it stands in, or run over several. So runs of whole
sentences are units too, across lines: from the start of each sentence to the first end of one that
makes `min_words`. They are classes by equality: hashes are counted, and where one occurs again its
runs are cut anew and compared as words.

With `stretch`, every window of so many words that occurs again is a unit as well, wherever sentences
and lines end. A window is known by the least hash among its shorter shingles, its anchor, which is
the same wherever the window stands; an anchor that stands in one place only has no repeated window.
Consecutive windows of one anchor are a chain, and equal chains, as of copies, are one row and a
count. Only where chains of one anchor differ are their windows compared one by one, those of one chain
for all its equals. Chains and windows are compared by 128 bits.

A document is told by its id and a hash of its text, so rows that share an id, or have none, are not
mixed up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.operators.ordering import global_row_number

from .common import mix, small, stored, word_hashes
from .linking import linked_groups

_WORDS = 1 << 17
_FEW_KEYS = 2_000_000
_BASE = 0x9E3779B97F4A7C15
#: Whether a word that ends in this byte ends a sentence.
_STOPS = np.isin(np.arange(256), list(b".!?"))
_OTHER_KEY = "paragraph-window"


@dataclass
class Portion:
    """Words of some texts, one after the other, and where texts, lines and sentences end."""

    first_text: int
    words: list[bytes]
    text_ends: list[int]
    line_ends: list[int]
    line_text: list[int]

    def __post_init__(self):
        self.hashes = word_hashes(self.words) if self.words else np.empty(0, np.uint64)
        self.text_starts = [0, *self.text_ends[:-1]]

    def paragraphs(self, min_words: int) -> list[tuple[int, int, int]]:
        """(text of the portion, first word, end) of the long lines."""
        starts = [0, *self.line_ends[:-1]]
        return [
            (t, a, b) for t, a, b in zip(self.line_text, starts, self.line_ends) if b - a >= min_words
        ]

    def shingles(self, k: int, hashes: np.ndarray | None = None) -> np.ndarray:
        """The hash of the k words from every word on."""
        rolled, n = np.zeros(len(self.words), np.uint64), len(self.words)
        hashes = self.hashes if hashes is None else hashes
        for i in range(k):
            rolled[: max(0, n - i)] = rolled[: max(0, n - i)] * np.uint64(_BASE) + hashes[i:]
        return mix(rolled)

    def runs(self, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, end) of every run of whole sentences."""
        n = len(self.words)
        ends = np.zeros(n + 1, bool)
        ends[1:] = _STOPS[np.fromiter(map(itemgetter(-1), self.words), np.uint8, n)]
        ends[np.array(self.line_ends, np.int64)] = True
        ends[0] = False
        text_end = np.array(self.text_ends, np.int64)
        at = np.flatnonzero(ends)
        starts = np.unique(np.concatenate([at, np.array(self.text_starts, np.int64)]))
        starts = starts[starts < n]
        stop = np.searchsorted(at, starts + min_words)
        text = np.searchsorted(text_end, starts, side="right")
        inside = stop < len(at)
        starts, stop, text = starts[inside], at[stop[inside]], text[inside]
        own = stop <= text_end[text] if len(text) else inside[:0]
        return text[own], starts[own], stop[own]

    def other_hashes(self) -> np.ndarray:
        """Hashes of the words that are independent of the first ones."""
        if not self.words:
            return self.hashes
        return word_hashes(self.words, hash_key=_OTHER_KEY)

    def run_hashes(self, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
        """A hash of the words of every run, from running sums of words times powers."""
        n, hashes = len(self.words), self.hashes if hashes is None else hashes
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]))
        inverse = np.cumprod(
            np.concatenate([[np.uint64(1)], np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)])
        )
        upto = np.concatenate([[np.uint64(0)], np.cumsum(hashes * power[:n])])
        length = mix((stops - starts).astype(np.uint64))
        return mix((upto[stops] - upto[starts]) * inverse[starts] + length).view(np.int64)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the shorter shingles, whether a window lies in one text from every word on, and
        its anchor."""
        k = shingle_of(size)
        hashes, n = self.shingles(k), len(self.words)
        whole = np.zeros(n, bool)
        for a, b in zip(self.text_starts, self.text_ends):
            whole[a : max(a, b - size + 1)] = True
        return hashes, whole, np.where(whole, _sliding(np.minimum, hashes, size - k + 1), np.uint64(0))

    def anchors(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of every place that is the anchor of a window."""
        hashes, whole, least = self.windows(size)
        # A place is an anchor if its hash is the least of some window over it, so the largest of those.
        reach = _sliding(np.maximum, least[::-1], size - shingle_of(size) + 1)[::-1]
        at = np.flatnonzero((reach == hashes) & (reach > 0))
        return at, hashes[at]

    def texts_at(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.text_ends, np.int64), places, side="right")

    def chains(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, windows, anchor, periodic) of the chains: consecutive windows of one
        text that share the anchor. Only in a periodic one can two windows be equal, as its anchor
        stands in several places.
        """
        _, whole, least = self.windows(size)
        text = self.texts_at(np.arange(len(whole)))
        starts = np.flatnonzero(whole)
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(starts) > 1) | (np.diff(least[starts]) != 0) | (np.diff(text[starts]) != 0)
        first = starts[new]
        counts = np.diff(np.append(np.flatnonzero(new), len(starts)))
        at, hashes = self.anchors(size)
        order = np.lexsort((at, hashes))
        near = (np.diff(hashes[order]) == 0) & (np.diff(at[order]) <= 2 * size)
        return text[first], first, counts, least[first], np.isin(least[first], hashes[order][1:][near])

    def window_keys(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the window from every word on, by two independent hashes of its words."""
        return self.shingles(size).view(np.int64), self.shingles(size, self.other_hashes()).view(np.int64)

    def digest(self, first: int, end: int) -> bytes:
        return hashlib.blake2b(b" ".join(self.words[first:end]), digest_size=16).digest()


def shingle_of(size: int) -> int:
    """The words of the shingles of which a window's anchor is one; shorter ones make longer chains."""
    return size // 4 + 1


def _sliding(choose: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The chosen of the `width` values from every place on, of fewer at the end."""
    found, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        found[:-step] = choose(found[:-step], found[step:])
        have += step
    return found


def _distinct(values: np.ndarray) -> int:
    """How many different values there are."""
    ordered = np.sort(values)
    return min(len(ordered), 1) + int(np.count_nonzero(ordered[1:] != ordered[:-1]))


def _texts(batch: pa.Array) -> Iterator[str | None]:
    return (t.as_py() for t in batch)


def portions(texts: Iterator[str | None]) -> Iterator[Portion]:
    """Texts in portions with a bounded number of words, one text at least."""
    number, first = 0, 0
    words: list[bytes] = []
    text_ends: list[int] = []
    line_ends: list[int] = []
    line_text: list[int] = []
    for text in texts:
        if text:
            for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n"):
                words += line.split()
                line_ends.append(len(words))
                line_text.append(number - first)
        number += 1
        text_ends.append(len(words))
        if len(words) >= _WORDS:
            yield Portion(first, words, text_ends, line_ends, line_text)
            first, words, text_ends, line_ends, line_text = number, [], [], [], []
    if text_ends:
        yield Portion(first, words, text_ends, line_ends, line_text)


def band_keys(flat: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key per band of the shingles in every pair of bounds, from the smallest values under
    `rows` functions each."""
    keys = np.empty((len(bounds) // 2, bands), np.uint64)
    factors = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    for band in range(bands):
        key = np.full(len(keys), band, np.uint64)
        for factor in factors[band * rows : (band + 1) * rows]:
            key = mix(key ^ np.minimum.reduceat(flat * factor, bounds)[::2])
        keys[:, band] = key
    return keys.view(np.int64)


def _listed(values: pa.Array, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.empty(0, np.int64), *parts])
    return _listed(pa.array(flat, pa.int64()), np.array([len(p) for p in parts], np.int64))


def signed_units(
    docs: DataFrame, min_words: int, k: int, bands: int, rows: int, stretch: int | None = None
) -> DataFrame:
    """(id, twin, paragraphs, runs, anchors) of (id, twin, text): the paragraphs signed, the hashes of
    the runs, and the anchors of the windows of `stretch` words."""
    kind = "first:int,last:int,n:int,digest:binary,bands:array<bigint>"

    @F.arrow_udf(f"struct<paragraphs:array<struct<{kind}>>,runs:array<bigint>,anchors:array<bigint>>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts = np.zeros(len(batch), np.int64)
            run_counts = np.zeros(len(batch), np.int64)
            anchor_counts = np.zeros(len(batch), np.int64)
            columns: list[list] = [[] for _ in range(4)]
            keys, runs = [np.empty((0, bands), np.int64)], [np.empty(0, np.int64)]
            anchors = [np.empty(0, np.int64)]
            for part in portions(_texts(batch)):
                held = part.paragraphs(min_words)
                if held:
                    flat = np.append(part.shingles(k), np.uint64(0))
                    bounds = np.array([x for _, a, b in held for x in (a, b - k + 1)], np.int64)
                    keys.append(band_keys(flat, bounds, bands, rows))
                for text, a, b in held:
                    counts[part.first_text + text] += 1
                    start = part.text_starts[text]
                    distinct = _distinct(flat[a : b - k + 1])
                    for column, value in zip(columns, (a - start, b - start, distinct, part.digest(a, b)), strict=True):
                        column.append(value)
                text, starts, stops = part.runs(min_words)
                run_counts += np.bincount(text + part.first_text, minlength=len(batch))
                runs.append(part.run_hashes(starts, stops))
                if stretch:
                    at, hashes = part.anchors(stretch)
                    text = part.texts_at(at)
                    anchor_counts += np.bincount(text + part.first_text, minlength=len(batch))
                    anchors.append(hashes.view(np.int64))
            values = np.concatenate(keys)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
            fields = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            fields.append(_listed(pa.array(values.ravel()), np.full(len(values), bands)))
            names = ["first", "last", "n", "digest", "bands"]
            yield pa.StructArray.from_arrays(
                [
                    _listed(pa.StructArray.from_arrays(fields, names), counts),
                    _listed(pa.array(np.concatenate(runs)), run_counts),
                    _listed(pa.array(np.concatenate(anchors)), anchor_counts),
                ],
                ["paragraphs", "runs", "anchors"],
            )

    return docs.select("id", "twin", sign("text").alias("s")).select("id", "twin", "s.*")


def paragraph_sets(docs: DataFrame, min_words: int, k: int, wanted: DataFrame) -> DataFrame:
    """(node, items) of the classes in `wanted` (node, head), from the document named."""

    @F.arrow_udf("array<struct<node:binary,items:array<bigint>>>")
    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts, nodes, items = np.zeros(len(batch), np.int64), [], []
            for part in portions(_texts(batch)):
                flat = part.shingles(k)
                for text, a, b in part.paragraphs(min_words):
                    counts[part.first_text + text] += 1
                    nodes.append(part.digest(a, b))
                    items.append(np.unique(flat[a : b - k + 1].view(np.int64)))
            fields = [pa.array(nodes, pa.binary()), _lists(items)]
            yield _listed(pa.StructArray.from_arrays(fields, ["node", "items"]), counts)

    rows = _of_docs(docs, wanted.select("head.id", "head.twin").distinct())
    found = rows.select(F.explode(whole("text")).alias("w")).select("w.*")
    return found.join(wanted.select("node"), "node").groupBy("node").agg(F.first("items").alias("items"))


def _of_docs(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the documents in `wanted` (id, twin)."""
    named = small(wanted.select(F.col("id").alias("doc"), F.col("twin").alias("doc_twin")))
    return docs.join(named, F.col("id").eqNullSafe(F.col("doc")) & (F.col("twin") == F.col("doc_twin")), "left_semi")


_RUN, _CHAIN = 0, 1


def recut(docs: DataFrame, min_words: int, stretch: int | None) -> DataFrame:
    """(kind, id, twin, first, size, probe, x, y, periodic) of the runs of sentences, `size` their
    words, `probe` their hash, and of the chains of windows, `size` their windows, `probe` the anchor;
    x and y are 128 bits of their words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(_texts(batch.column("text"))):
                other, begin = part.other_hashes(), np.array(part.text_starts, np.int64)
                text, starts, stops = part.runs(min_words)
                probe = part.run_hashes(starts, stops)
                found = [(_RUN, text, starts, stops - starts, probe, stops, np.zeros(len(text), bool))]
                if stretch:
                    text, starts, counts, probe, periodic = part.chains(stretch)
                    stops = starts + counts + stretch - 1
                    found.append((_CHAIN, text, starts, counts, probe.view(np.int64), stops, periodic))
                for kind, text, starts, sizes, probe, stops, periodic in found:
                    at = pa.array(text + part.first_text)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(text), kind, np.int32)),
                            batch.column("id").take(at),
                            batch.column("twin").take(at),
                            pa.array(starts - begin[text], pa.int32()),
                            pa.array(sizes, pa.int32()),
                            pa.array(probe),
                            pa.array(part.run_hashes(starts, stops)),
                            pa.array(part.run_hashes(starts, stops, other)),
                            pa.array(periodic),
                        ],
                        ["kind", "id", "twin", "first", "size", "probe", "x", "y", "periodic"],
                    )

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "twin", "text").mapInArrow(
        cut,
        f"kind int, id {id_type}, twin bigint, first int, size int, probe bigint, x bigint, y bigint, periodic boolean",
    )


def repeated_cuts(docs: DataFrame, signed: DataFrame, min_words: int, stretch: int | None) -> DataFrame:
    """The runs of sentences whose hash occurs again, and the chains whose anchor does."""
    probes = signed.select(
        "id",
        "twin",
        F.explode(
            F.concat(
                F.transform("runs", lambda h: F.struct(F.lit(_RUN).alias("kind"), h.alias("probe"))),
                F.transform("anchors", lambda h: F.struct(F.lit(_CHAIN).alias("kind"), h.alias("probe"))),
            )
        ).alias("p"),
    ).select("id", "twin", "p.*")
    again = probes.groupBy("kind", "probe").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("kind", "probe")
    again = small(stored(again, "probes"), _FEW_KEYS)
    ids = stored(probes.join(again, ["kind", "probe"], "left_semi").select("id", "twin").distinct(), "probe-docs")
    cuts = recut(_of_docs(docs, ids), min_words, stretch)
    return stored(cuts.join(again, ["kind", "probe"], "left_semi"), "cuts")


def repeated_runs(cuts: DataFrame) -> DataFrame:
    """(id, twin, first, last, head, removed) of the runs of sentences that occur more than once."""
    runs = cuts.where(F.col("kind") == _RUN)
    place = F.struct("id", "twin", "first")
    heads = (
        runs.groupBy("x", "y")
        .agg(F.count(F.lit(1)).alias("k"), F.min(place).alias("head"))
        .where("k > 1")
        .select("x", "y", "head")
    )
    last = (F.col("first") + F.col("size")).alias("last")
    return runs.join(heads, ["x", "y"]).select("id", "twin", "first", last, "head", _removed("head"))


def _removed(head: str) -> Column:
    """Whether a unit is another than the first of its class."""
    return (~F.struct("id", "twin", "first").eqNullSafe(F.col(head))).alias("removed")


def repeated_windows(docs: DataFrame, cuts: DataFrame, size: int) -> DataFrame:
    """(id, twin, first, last, head, removed) of the windows of `size` words that occur more than
    once, those of a chain that overlap and are all removed or all kept as one, with the least head."""
    chains = cuts.where(F.col("kind") == _CHAIN).select(
        "id", "twin", "first", F.col("size").alias("n"), F.col("probe").alias("anchor"), "x", "y", "periodic"
    )
    place = F.struct("id", "twin", "first")
    distinct = chains.groupBy("anchor", "x", "y").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min(place).alias("head"),
        F.first("n").alias("n"),
        F.max("periodic").alias("periodic"),
    )
    # Numbered in the order of their heads, so the least number and place of a window is its head.
    distinct = global_row_number(distinct, [F.col("head.id"), F.col("head.twin"), F.col("head.first")], "number")
    several = distinct.groupBy("anchor").agg(
        (F.count(F.lit(1)) > 1).alias("several"), F.max("periodic").alias("again")
    )
    several = stored(several.where("several or again").select("anchor"), "mixed-anchors")
    mixed = distinct.join(small(several, _FEW_KEYS), "anchor", "left_semi")
    alone = distinct.where("copies > 1").join(small(several, _FEW_KEYS), "anchor", "left_anti")

    # Chains that alone have their anchor: all their windows are repeated, the head's are kept.
    whole = alone.select(
        "number",
        F.explode(F.array(F.lit(True), F.lit(False))).alias("own"),
        F.lit(0).alias("low"),
        (F.col("n") - 1).alias("high"),
        F.col("number").alias("head_number"),
        F.lit(0).alias("head_at"),
    ).withColumn("removed", ~F.col("own"))
    columns = ["number", "own", "removed", "low", "high", "head_number", "head_at"]
    found = stored(whole.select(*columns).union(_mixed_windows(docs, mixed, size).select(*columns)), "windows")

    heads = distinct.select(F.col("number").alias("head_number"), F.col("head").alias("of"))
    named = found.join(heads, "head_number").select(
        "number", "own", "removed", "low", "high",
        F.struct("of.id", "of.twin", (F.col("of.first") + F.col("head_at")).alias("first")).alias("head"),
    )
    spans = distinct.select("number", "anchor", "x", "y", F.col("head").alias("chain_head")).join(named, "number")
    spans = spans.select(
        "anchor", "x", "y", "own", "chain_head", "low", "high", F.col("head").alias("window_head"), "removed"
    )
    at_head = place.eqNullSafe(F.col("chain_head"))
    return (
        chains.join(spans, ["anchor", "x", "y"])
        .where(at_head == F.col("own"))
        .select(
            "id", "twin", (F.col("first") + F.col("low")).alias("first"),
            (F.col("first") + F.col("high") + size).alias("last"), F.col("window_head").alias("head"), "removed",
        )
    )


def _mixed_windows(docs: DataFrame, mixed: DataFrame, size: int) -> DataFrame:
    """(number, own, removed, low, high, head_number, head_at) of the repeated windows of chains that
    differ from others of their anchor; `own` for the chain's head, else for its other places."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            for part in portions(_texts(batch.column("text"))):
                keys = part.window_keys(size)
                for text, begin in enumerate(part.text_starts):
                    runs = wanted[part.first_text + text].values
                    first, n = (runs.field(c).to_numpy() for c in ("first", "n"))
                    starts = np.repeat(first.astype(np.int64) + begin - (np.cumsum(n) - n), n)
                    inside = starts + np.arange(int(n.sum()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            runs.field("number"),
                            runs.field("several"),
                            *[_listed(pa.array(key[inside]), n.astype(np.int64)) for key in keys],
                        ],
                        ["number", "several", "x", "y"],
                    )

    of_doc = F.collect_list(F.struct(F.col("head.first").alias("first"), "n", "number", (F.col("copies") > 1).alias("several")))
    wanted = mixed.groupBy(F.col("head.id").alias("doc"), F.col("head.twin").alias("doc_twin")).agg(of_doc.alias("wanted"))
    same = F.col("id").eqNullSafe(F.col("doc")) & (F.col("twin") == F.col("doc_twin"))
    # Rows that repeat id and text are met once.
    texts = docs.join(wanted, same).groupBy("id", "twin").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    keys = texts.select("text", "wanted").mapInArrow(
        cut, "number bigint, several boolean, x array<bigint>, y array<bigint>"
    )
    windows = keys.select("number", "several", F.posexplode(F.arrays_zip("x", "y")).alias("at", "key"))
    windows = stored(windows.select("number", "several", "at", "key.x", "key.y"), "mixed-windows")
    heads = (
        windows.groupBy("x", "y")
        .agg(
            F.count(F.lit(1)).alias("k"),
            F.max("several").alias("several"),
            F.min(F.struct("number", "at")).alias("head"),
        )
        .where("k > 1 or several")
        .select("x", "y", "head")
    )
    met = windows.join(heads, ["x", "y"])
    here = ~F.struct("number", "at").eqNullSafe(F.col("head"))
    at_head = F.struct(F.lit(True).alias("own"), here.alias("removed"))
    elsewhere = F.struct(F.lit(False).alias("own"), F.lit(True).alias("removed"))
    both = F.when(F.col("several"), F.array(at_head, elsewhere)).otherwise(F.array(at_head))
    placed = met.select("number", "at", "head", F.explode(both).alias("b")).select("number", "at", "head", "b.*")
    along = Window.partitionBy("number", "own", "removed").orderBy("at")
    opened = (F.col("at") - F.lag("at").over(along) >= size).cast("int")
    numbered = placed.withColumn("new", F.coalesce(opened, F.lit(0)))
    numbered = numbered.withColumn(
        "island", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return (
        numbered.groupBy("number", "own", "removed", "island")
        .agg(F.min("at").alias("low"), F.max("at").alias("high"), F.min("head").alias("head"))
        .select("*", F.col("head.number").alias("head_number"), F.col("head.at").alias("head_at"))
    )


def repeated_paragraphs(
    docs: DataFrame,
    min_words: int = 20,
    percent: int = 80,
    k: int = 5,
    bands: int = 10,
    rows: int = 3,
    doc_id: str = "doc_id",
    text: str = "text",
    stretch: int | None = None,
) -> DataFrame:
    """(doc_id, first_word, last_word, class_doc, class_word, removed) of repeated passages.

    Every paragraph that another one in the table equals or is `percent` similar to, directly or by
    way of others, every run of sentences that occurs again, and with `stretch` every window of so
    many words that does, as stretches of words of its document (from 0, the last one excluded);
    those that overlap are one stretch. Each class keeps its first unit by id and place and names
    it; the others are removed. A stretch of several classes names the first of them. Null and empty
    texts have no units; null ids come first.
    Rows that share an id but not the text are told apart; rows that repeat both are reported once.
    Other columns are left out, so none can clash.
    """
    plain = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("twin"), F.col(text).alias("text"))
    signed = stored(signed_units(plain, min_words, k, bands, rows, stretch), "units")
    units = signed.select("id", "twin", F.explode("paragraphs").alias("p")).select("id", "twin", "p.*")
    classes = stored(
        units.groupBy(F.col("digest").alias("node")).agg(
            F.count(F.lit(1)).alias("copies"),
            F.min(F.struct("id", "twin", "first")).alias("head"),
            F.first("n").alias("n"),
            F.first("bands").alias("bands"),
        ),
        "paragraph-classes",
    )
    keyed = classes.select("node", "n", F.explode("bands").alias("key"))
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    members = stored(
        keyed.join(small(stored(met, "keys"), _FEW_KEYS), "key").select("node", "n", "key", F.lit(1).alias("need")),
        "bands",
    )

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = classes.select("node", "head").join(small(nodes), "node", "left_semi")
        return paragraph_sets(plain, min_words, k, stored(wanted, "wanted"))

    groups = linked_groups(members, sets_of, percent)
    placed = classes.select("node", "copies", "head").join(groups, "node", "left")
    linked = placed.where("component is not null")
    heads = linked.groupBy("component").agg(F.min("head").alias("least"))
    of_class = (
        linked.join(heads, "component")
        .select("node", F.col("least").alias("head"))
        .union(placed.where("component is null and copies > 1").select("node", "head"))
    )
    heads = small(stored(of_class, "heads"), _FEW_KEYS // 4)
    paragraphs = units.withColumnRenamed("digest", "node").join(heads, "node")
    found = paragraphs.select("id", "twin", "first", "last", "head", _removed("head"))
    cuts = repeated_cuts(plain, signed, min_words, stretch)
    found = found.union(repeated_runs(cuts))
    if stretch:
        found = found.union(repeated_windows(plain, cuts, stretch))
    return _stretches(found).select(
        F.col("id").alias(doc_id),
        F.col("first").alias("first_word"),
        F.col("last").alias("last_word"),
        F.col("head.id").alias("class_doc"),
        F.col("head.first").alias("class_word"),
        "removed",
    )


def _stretches(found: DataFrame) -> DataFrame:
    """Overlapping units of a document as one, those removed apart from those kept."""
    along = Window.partitionBy("id", "twin", "removed").orderBy("first", "last")
    before = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("new", F.when(F.col("first") < before, 0).otherwise(1))
    numbered = opened.withColumn("stretch", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("id", "twin", "removed", "stretch").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("head").alias("head")
    )
