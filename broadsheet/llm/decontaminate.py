"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame only.

Test items are short and documents long, so a document's own MinHash says nothing about an item in
it. Items are therefore partitioned by size: of the class s are those of more than s / 2 and up to
s shingles. For each class, documents are cut into windows of 2 s shingles that overlap by half, so
a whole item always lies within one. Item and window are signed by their bottom-k MinHash, the
`sketch_size(s)` smallest of their distinct shingle hashes, and an item is retrieved where the two
sketches meet. A window misses an item only if none of its smallest hashes is the item's: for the
default sizes and an item at the threshold in the least favourable class, three in a thousand, and
less than one in ten thousand for a verbatim one.

Ahead of that, all shingles of the documents are looked up among the values of the items' sketches: a
text that holds none of them has none in any window, and is not cut into windows.

What is found is verified by exact containment of the item's shingles, as text, in the whole
document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, small, stored


def words_of(text: Column) -> Column:
    """Lower-case words; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP, -1), "")


def _starts(words: str, k: int) -> Column:
    """The place of every shingle: runs of k words, or all of them if there are fewer."""
    return F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1)))


def shingle_hashes(words: str, k: int) -> Column:
    def of_run(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(k)])  # places past the end are null

    return F.when(F.size(words) > 0, F.transform(_starts(words, k), of_run)).otherwise(
        F.array().cast("array<bigint>")
    )


def shingle_texts(words: str, k: int) -> Column:
    """The distinct shingles themselves."""
    return F.when(
        F.size(words) > 0,
        F.array_distinct(F.transform(_starts(words, k), lambda i: F.array_join(F.slice(words, i, k), " "))),
    ).otherwise(F.array().cast("array<string>"))


def sketch_size(size: int) -> int:
    """Values kept of a window of class `size`, out of twice that; all of them in small classes."""
    return 8 + size // 2


def _smallest(hashes: Column, k: int) -> Column:
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def window_values(hashes: str, size: int) -> Column:
    """The distinct values of the sketches of all windows of class `size`."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(hashes), F.lit(1)), F.lit(size))
    sketches = F.transform(starts, lambda i: _smallest(F.slice(hashes, i, 2 * size), sketch_size(size)))
    return F.array_distinct(F.flatten(sketches))


def item_classes(items: DataFrame, item_id: str, text: str, k: int, smallest: int) -> DataFrame:
    """(item, shingles, hashes, class) of the items with words; class is a power of two."""
    worded = items.select(F.col(item_id).alias("item"), words_of(F.col(text)).alias("words")).where(
        F.size("words") > 0
    )
    cut = worded.select(
        "item",
        shingle_texts("words", k).alias("shingles"),
        F.array_distinct(shingle_hashes("words", k)).alias("hashes"),
        _starts("words", k).alias("starts"),
    )
    power = F.ceil(F.log2(F.size("starts").cast("double")))
    return cut.withColumn("class", F.greatest(F.pow(F.lit(2), power), F.lit(smallest)).cast("int")).drop("starts")


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    k: int = 5,
    percent: int = 80,
    smallest: int = 4,
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found): items of which a document holds `percent` or more.

    Shares are of the item's distinct shingles of k lower-case words (fewer words are one shingle).
    A null or blank text, on either side, contains nothing and is contained in nothing. Repeated
    items and documents each get their rows; a null id is reported as null. Equal texts are
    searched once. Other columns are left out, so none can clash.
    """
    classed = stored(item_classes(items, item_id, text, k, smallest), "items")
    classes = sorted(r[0] for r in classed.select("class").distinct().collect())
    keyed = docs.select(F.col(doc_id).alias("doc"), F.sha2(F.col(text), 256).alias("key"), F.col(text).alias("text"))
    kept = F.floor(F.col("class") / 2).cast("int") + sketch_size(0)
    signed = classed.select("item", "class", F.explode(F.slice(F.array_sort("hashes"), 1, kept)).alias("value"))
    signed = stored(signed, "signed")
    # Not by the number of words: that test would move below the cutting and cut every text twice.
    worded = keyed.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))

    def hashed(rows: DataFrame) -> DataFrame:
        cut = rows.select("key", words_of(F.col("text")).alias("words"))
        return cut.select("key", shingle_hashes("words", k).alias("hashes"))

    # Outer, or Spark would test the hashes for any below the cutting, where each is made anew.
    each = hashed(worded).select("key", F.explode_outer("hashes").alias("value"))
    met = each.join(small(signed.select("value").distinct()), "value", "left_semi").select("key").distinct()
    holders = worded.join(small(stored(met, "holders")), "key", "left_semi").select("key", "text")
    signed = small(signed)
    # All classes in one pass; without any, of an empty benchmark, there are no windows.
    of_class = [F.struct(F.lit(s).alias("class"), window_values("hashes", s).alias("values")) for s in classes]
    none = F.array().cast("array<struct<class:int,values:array<bigint>>>")
    windows = hashed(holders).select("key", F.explode(F.array(*of_class) if classes else none).alias("w"))
    values = windows.select("key", "w.class", F.explode("w.values").alias("value"))
    hits = values.join(signed, ["class", "value"])
    candidates = stored(hits.select("key", "item").distinct(), "candidates")

    # Only the texts of candidates are cut into shingles again, as text.
    wanted = small(candidates.select("key").distinct())
    texts = keyed.join(wanted, "key", "left_semi").select("key", "text").distinct()
    held = texts.select("key", words_of(F.col("text")).alias("words")).select(
        "key", shingle_texts("words", k).alias("held")
    )
    needed = classed.select("item", "shingles").distinct()
    same_item = F.col("c.item").eqNullSafe(F.col("n.item"))
    checked = (
        candidates.alias("c")
        .join(needed.alias("n"), same_item)
        .select("c.key", "c.item", "n.shingles")
        .join(held, "key")
        .select(
            "key",
            "item",
            F.size("shingles").alias("n_shingles"),
            F.size(F.array_intersect("shingles", "held")).alias("n_found"),
        )
        .where(F.col("n_found") * 100 >= percent * F.col("n_shingles"))
    )
    return keyed.select("doc", "key").join(stored(checked, "contained"), "key").select(
        F.col("doc").alias(doc_id), F.col("item").alias(item_id), "n_shingles", "n_found"
    )

