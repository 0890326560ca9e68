"""Quality rules: how much of a text repeats itself, by suffix array and common prefixes.

Each text gets its own suffix array over code points, built by prefix doubling in numpy: suffixes
are sorted by their first eight bytes at once, then only those still tied are sorted again by twice
as many symbols. Neighbours whose longest common prefix reaches `min_chars` bound the intervals of
repeated substrings; for every suffix the deepest interval it lies in gives the longest substring
that starts there and occurs again. One that cannot be extended to the left is maximal. The union
of the maximal spans is the covered part of the text; that fraction and the longest repeat are
limited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS

SYMBOLS = b"#*$%&|<>"
BASE_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _keys(text: str) -> tuple[np.ndarray, int]:
    """The next symbols of every suffix in one big-endian number, and how many they are.

    A symbol is its code point plus one, so that the end of the text sorts first. Most texts need
    one byte a symbol.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    top = int(codes.max())
    width = 1 if top < 255 else 2 if top < 65535 else 4
    held = np.zeros(len(codes) + 8, f">u{width}")
    held[: len(codes)] = codes + np.uint32(1)
    keys = np.ndarray((len(codes),), ">u8", buffer=held, strides=(width,)).astype(np.uint64)
    return keys, 8 // width


def _doubled(keys: np.ndarray, step: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffix array, and per number of symbols every suffix's rank by that many (end: 0)."""
    n = len(keys)
    order = np.argsort(keys)
    by_key = keys[order]
    new = np.ones(n, bool)
    new[1:] = by_key[1:] != by_key[:-1]
    slots, levels = np.arange(n), []
    while True:
        rank = np.zeros(n + 1, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
        levels.append((step, rank))
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order, levels
        suffixes = order[at]
        pair = rank[suffixes] * (n + 1) + rank[np.minimum(suffixes + step, n)]
        sub = np.argsort(pair)
        order[at] = suffixes[sub]
        pair = pair[sub]
        new[at[1:]] |= pair[1:] != pair[:-1]
        step *= 2


def longest_repeats(text: str, min_chars: int) -> np.ndarray:
    """For every position the longest substring starting there that occurs again, 0 if shorter
    than `min_chars`."""
    n = len(text)
    longest = np.zeros(n, np.int64)
    if n <= min_chars:
        return longest
    keys, step = _keys(text)
    order, levels = _doubled(keys, step)
    # Pairs of neighbours that agree on as many symbols as the last level within the minimum.
    known = [rank for k, rank in levels if k <= min_chars]
    slots = np.arange(1, n)
    if known:
        slots = slots[known[-1][order[1:]] == known[-1][order[:-1]]]
    left, right = order[slots - 1], order[slots]
    common = np.zeros(len(slots), np.int64)
    for k, rank in reversed(levels):
        common += k * (rank[np.minimum(left + common, n)] == rank[np.minimum(right + common, n)])
    # What is left is shorter than one key: compare its symbols one by one.
    first = np.zeros(n + 1, np.uint64)
    first[:n] = keys >> np.uint64(64 - 64 // step)
    going = np.ones(len(slots), bool)
    for _ in range(step - 1):
        a, b = first[np.minimum(left + common, n)], first[np.minimum(right + common, n)]
        going &= (a == b) & (a != 0)
        common += going
    between = np.zeros(n + 1, np.int64)
    between[slots] = np.where(common >= min_chars, common, 0)
    longest[order] = np.maximum(between[:-1], between[1:])
    return longest


def repeated_spans(text: str, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the maximal repeated substrings, at each position the longest."""
    longest = longest_repeats(text, min_chars)
    start = longest > 0
    start[1:] &= longest[:-1] <= longest[1:]
    at = np.flatnonzero(start)
    return at, longest[at]


def covered(starts: np.ndarray, lengths: np.ndarray) -> int:
    """Size of the union of spans sorted by start."""
    if not len(starts):
        return 0
    reach = np.maximum.accumulate(starts + lengths)
    before = np.concatenate([[starts[0]], reach[:-1]])
    return int((reach - np.maximum(starts, np.minimum(before, reach))).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated three-word windows."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    word_chars = len(text) - (len(data) - len(data.translate(None, BLANKS)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.split()]
    repeated = 0
    if n >= 4:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        two = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        _, window, found = np.unique(
            two[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True
        )
        twice = found[window] > 1
        inside = np.zeros(n, bool)
        for i in range(3):
            inside[i : i + n - 2] |= twice
        repeated = int(inside.sum())
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated


def with_repetition(
    docs: DataFrame,
    min_chars: int = 50,
    max_covered_percent: int = 50,
    max_repeat: int = 1000,
    text: str = "text",
) -> DataFrame:
    """`docs` with the base counts, `n_repeats`, `repeat_chars`, `longest_repeat`, `base_failed`
    and `kept`; columns of these names are replaced.

    Failing by repetition: more than `max_covered_percent` of the code points lie in repeated
    substrings of `min_chars` or more, or one of those is longer than `max_repeat`. A null text
    counts as an empty one; both fail by having fewer than 50 words. Each row is judged alone, so
    repeated rows get equal answers. A text takes some forty bytes of memory a code point, and eight
    more for every doubling that its longest repeat needs: 136 for 400,000 equal characters.
    """
    names = [*BASE_FIELDS, "n_repeats", "repeat_chars", "longest_repeat", "__chars"]
    fields = ",".join(f"{c}:bigint" for c in names)

    @F.arrow_udf(f"struct<{fields}>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = np.zeros((len(texts), len(names)), np.int64)
            for i, t in enumerate(texts):
                value = t.as_py() or ""
                starts, lengths = repeated_spans(value, min_chars)
                found[i] = (
                    *base_counts(value),
                    len(starts),
                    covered(starts, lengths),
                    lengths.max(initial=0),
                    len(value),
                )
            yield pa.StructArray.from_arrays([pa.array(c) for c in found.T.copy()], names)

    added = [*names[:-1], "base_failed", "kept"]
    rest = [c for c in docs.columns if c not in added]
    m = docs.select(*rest, measure(F.col(text)).alias("__m"))
    failed = (F.col("__m.n_words") < 50) | (
        100 * F.col("__m.n_repeat_words") > 50 * F.col("__m.n_words")
    )
    repeats = (
        100 * F.col("__m.repeat_chars") > max_covered_percent * F.col("__m.__chars")
    ) | (F.col("__m.longest_repeat") > max_repeat)
    return m.select(
        *rest,
        *[F.col(f"__m.{c}").alias(c) for c in names[:-1]],
        failed.alias("base_failed"),
        (~failed & ~repeats).alias("kept"),
    )
