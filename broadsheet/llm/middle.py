"""Fill-in-middle transformation: texts are cut in three, and the middle goes last.

The units of a text are its words with the blanks before them, and blanks at its end. Two random
cuts between units part it into prefix, middle and suffix.

A text is split into blocks of `block` bytes of UTF-8. A Fenwick tree over its blocks stores how many
units end and how many code points begin in them. A cut after some number of units is found by
binary lifting: a descent of the tree, a bit of the block's number a step, skips whole blocks while
the units in them are too few, and adds up the code points skipped. Inside the block reached, the
boundary is looked up byte by byte. A descent takes as many steps as a block number has bits, and the
trees of all texts of a portion lie in one array and are descended together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_portions

_PORTION = 4 << 20
#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


class Forest:
    """The Fenwick trees of some texts, and their bytes, one after the other."""

    def __init__(self, texts: list[bytes], block: int):
        self.block = block
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        blank = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        # A unit ends with a word, and with the text.
        self.unit_end = np.ones(len(self.data), bool)
        self.unit_end[:-1] = ~blank[:-1] & blank[1:]
        ends = (self.starts + self.sizes - 1)[self.sizes > 0]
        self.unit_end[ends] = True
        self.code_point = (self.data & 0xC0) != 0x80
        self.blocks = -(-self.sizes // block)
        # Nodes are numbered from 1 in each tree, so each has one place that is not used.
        self.roots = np.cumsum(self.blocks + 1) - (self.blocks + 1)
        node = np.arange(int((self.blocks + 1).sum())) - np.repeat(self.roots, self.blocks + 1)
        self.units, self.totals = self._tree(self.unit_end, node)
        self.code_points, _ = self._tree(self.code_point, node)

    def _tree(self, flags: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the blocks, and onto every node those of the nodes below it, level by level; and
        the sums of the texts."""
        tree = np.zeros(len(node), np.int64)
        inner = np.flatnonzero(node)
        if not len(inner):
            return tree, np.zeros(len(self.blocks), np.int64)
        text = np.repeat(np.arange(len(self.blocks)), self.blocks)
        first = self.starts[text] + (node[inner] - 1) * self.block
        tree[inner] = np.add.reduceat(flags, first, dtype=np.int64)
        totals = np.bincount(text, tree[inner], len(self.blocks)).astype(np.int64)
        last = np.repeat(self.blocks, self.blocks + 1)
        level = 1
        while level < int(self.blocks.max()):
            # Of one level, no two nodes have the same parent.
            at = np.flatnonzero(((node & (2 * level - 1)) == level) & (node + level <= last))
            tree[at + level] += tree[at]
            level *= 2
        return tree, totals

    def cut(self, text: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, code points) of each text named before the cut after so many of its units."""
        block, left, points = np.zeros(len(text), np.int64), units.copy(), np.zeros(len(text), np.int64)
        step = 1 << max(0, int(self.blocks.max(initial=1)).bit_length() - 1)
        while step:
            ahead = block + step
            inside = ahead <= self.blocks[text]
            node = self.roots[text] + np.where(inside, ahead, 0)
            go = inside & (self.units[node] < left)
            block = np.where(go, ahead, block)
            left -= np.where(go, self.units[node], 0)
            points += np.where(go, self.code_points[node], 0)
            step >>= 1
        # The block holds the end looked for: as many bytes of it as come before the end.
        first = self.starts[text] + block * self.block
        size = np.minimum(self.sizes[text] - block * self.block, self.block)
        at = np.minimum(first[:, None] + np.arange(self.block), max(len(self.data) - 1, 0))
        own = np.arange(self.block) < size[:, None]
        if not len(self.data):
            return np.zeros(len(text), np.int64), points
        ends = np.cumsum(self.unit_end[at] & own, axis=1)
        taken = np.argmax(ends >= left[:, None], axis=1) + 1
        before = (np.arange(self.block) < taken[:, None]) & own
        points += (self.code_point[at] & before).sum(axis=1)
        none = units == 0
        return np.where(none, 0, first + taken - self.starts[text]), np.where(none, 0, points)


def transformed(
    texts: list[bytes], numbers: np.ndarray, fim_percent: int, spm_percent: int, block: int
) -> list[tuple]:
    """(units, form, code points of prefix and of middle, output) of every text under its row of
    four random numbers; nulls for the code points of plain texts."""
    forest = Forest(texts, block)
    n = forest.totals
    marks = [m.encode() for m in MARKS]
    plain = np.fromiter((not t or any(m in t for m in marks) for t in texts), bool, len(texts))
    plain |= numbers[:, 2] % 100 >= fim_percent
    spm = numbers[:, 3] % 100 < spm_percent
    cuts = np.sort(numbers[:, :2] % (n + 1)[:, None], axis=1)
    changed = np.flatnonzero(~plain)
    low_bytes, low_points = forest.cut(changed, cuts[changed, 0])
    high_bytes, high_points = forest.cut(changed, cuts[changed, 1])
    found: list[tuple] = [(int(k), "plain", None, None, t) for k, t in zip(n, texts, strict=True)]
    ends = zip(
        changed.tolist(), low_bytes.tolist(), high_bytes.tolist(), low_points.tolist(),
        (high_points - low_points).tolist(), strict=True,
    )
    p, s, m = marks
    for i, a, b, before, between in ends:
        prefix, middle, suffix = texts[i][:a], texts[i][a:b], texts[i][b:]
        parts = [s, suffix, p, prefix] if spm[i] else [p, prefix, s, suffix]
        found[i] = (int(n[i]), "spm" if spm[i] else "psm", before, between, b"".join([*parts, m, middle]))
    return found


def numbers_of(key: Column, seed: int = 42) -> list[Column]:
    """Four 32-bit numbers of a row: the first digits of the SHA-256 of the seed and its key."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")))
    digits = F.sha2(text, 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def filled_in_middle(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: int = 42,
    fim_percent: int = 50,
    spm_percent: int = 80,
    block: int = 256,
) -> DataFrame:
    """`docs` with `n` (units), `form`, `prefix_chars`, `middle_chars` and `output`.

    Of the texts `fim_percent` are cut, of these `spm_percent` get suffix, prefix, middle, the others
    prefix, suffix, middle, each behind its mark. A null, empty or marked text is `plain` and its own
    output (null: empty), as are the rest. What happens to a row depends on its id and text alone, so
    rows that repeat both get the same; a null id is an id of its own. Columns with the names added
    are replaced; an empty table gives an empty result. Memory follows the longest text.
    """

    @F.arrow_udf(
        "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"
    )
    def transform(
        batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]],
    ) -> Iterator[pa.Array]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for texts, *drawn in batches:
            numbers = np.stack([d.to_numpy(zero_copy_only=False) for d in drawn], axis=1).astype(np.int64)
            columns: list[list[pa.Array]] = [[] for _ in kinds]
            for a, part in text_portions(texts, _PORTION):
                whole = [t or b"" for t in part]
                rows = transformed(whole, numbers[a : a + len(part)], fim_percent, spm_percent, block)
                for column, cells, kind in zip(columns, zip(*rows), kinds, strict=True):
                    column.append(pa.array(cells, kind))
            joined = [pa.concat_arrays([pa.array([], k), *c]) for c, k in zip(columns, kinds, strict=True)]
            joined[-1] = joined[-1].cast(pa.string())
            yield pa.StructArray.from_arrays(joined, list(_ADDED))

    rest = [c for c in docs.columns if c not in _ADDED]
    made = transform(F.col(text), *numbers_of(F.col(doc_id), seed))
    return docs.select(*rest, made.alias("__made")).select(*rest, "__made.*")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made of.

    No text that is cut holds a mark, and none can arise across a mark's edge, so an output parts
    at its three marks.
    """
    part = F.split(output, "|".join(MARKS), -1)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(part[1], part[3], part[2]))
        .otherwise(F.concat(part[2], part[3], part[1]))
    )
