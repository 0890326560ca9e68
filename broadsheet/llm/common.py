"""What several operators share: reading tables, words, hashes in numpy, scratch tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators.pinning import scratch_dir

#: Words are runs without these bytes, which are also what `bytes.split()` splits on.
BLANKS = b" \t\n\r\x0b\x0c"
#: The same as a Java and RE2 expression.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet into the shared folder and read again: cuts the lineage, and every
    later use sees the same rows, whichever executors are lost."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """`df`, a table of narrow rows, marked for broadcast if it has at most so many; else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes], **kind: str) -> np.ndarray:
    """A hash of every word. Told one by one: looking for equal words first takes several times as long."""
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False, **kind)


def shingle_hashes(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Per text the hash of every run of `k` words, in order; of the whole if there are fewer.

    Texts are lower-cased in A-Z; one without words has no shingle.
    """
    return run_hashes([t.lower().split() for t in texts], k)


def run_hashes(split: list[list[bytes]], k: int) -> list[np.ndarray]:
    """Per list of words the hash of every run of `k`; of the whole list if it is shorter."""
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    if not sizes.sum():
        return [np.empty(0, np.uint64)] * len(split)
    words = word_hashes([w for ws in split for w in ws])
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(words), np.uint64)
        for i in range(min(k, len(words))):
            rolled[: len(words) - i] = (
                rolled[: len(words) - i] * np.uint64(0x9E3779B97F4A7C15) + words[i:]
            )
        rolled = mix(rolled)
        found, start = [], 0
        for n in sizes.tolist():
            if n >= k:
                found.append(rolled[start : start + n - k + 1])
            elif n:
                whole = np.uint64(n)
                for w in words[start : start + n]:
                    whole = whole * np.uint64(0x9E3779B97F4A7C15) + w
                found.append(mix(np.array([whole], np.uint64)))
            else:
                found.append(np.empty(0, np.uint64))
            start += n
    return found


def bounds(sizes: list[int], most: int):
    """(first, end) of runs of items whose sizes add up to about `most`, one item at least."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def portions(texts: list[bytes | None], most_bytes: int):
    """(first, end) of runs of texts with about `most_bytes` together, one text at least."""
    return bounds([len(text or b"") for text in texts], most_bytes)


def text_portions(texts: pa.Array, most_bytes: int):
    """(first, texts as bytes) of runs of an Arrow array of strings; only one run is unpacked at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for start, end in bounds(sizes, most_bytes):
        yield start, texts[start:end].cast(pa.binary()).to_pylist()
