"""From raw documents to token ids in five stages, each by one operator of `broadsheet.llm`.

A stage takes the documents its predecessor kept and returns those it keeps, with the columns of
the table; the last returns their pieces. Stages are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import decontaminate, jaccard_join, language, pieces, secrets
from broadsheet.llm.common import small, stored, table
from broadsheet.llm.queries import default_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; null and letterless texts go.

    The model learns from the labelled documents, its calibration fold apart. Without any labelled
    document there is nothing to tell by, and all texts with letters stay.
    """
    model = language.train(docs.where(~language.held_out()))
    return language.identified(docs, model).where(~F.col("rejected")).select(*COLUMNS)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs` whose id and text are not those of a row in `gone` (doc_id, text_key)."""
    named = small(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")))
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key"))
    return docs.join(named, same, "left_anti")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates; one without an id
    only if no other has one.

    Similar are 0.8 of five-word shingles. Rows without words stay. Rows are told by id and text: an
    id on two texts goes with one of them only, and of rows that repeat both one stays.
    """
    keyed = docs.withColumn("text_key", F.sha2(F.col("text"), 256))
    found = jaccard_join.jaccard_groups(keyed, words=5, percent=80, carry=["text_key"])
    groups = stored(found.where("component is not null"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    least = groups.groupBy("component").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("rows"))
    members = groups.join(small(stored(least.where("rows > 1"), "least")), "component")
    stays = order.eqNullSafe(F.col("least"))
    others = stored(members.where(~stays).select("doc_id", "text_key").distinct(), "others")
    twice = members.where(stays).groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = stored(twice.select("doc_id", "text_key"), "twice")
    kept = _without(keyed, others)
    if twice.isEmpty():
        return kept.select(*COLUMNS)
    again = twice.select(F.col("doc_id").alias("again_id"), F.col("text_key").alias("again_key"))
    same = F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("text_key") == F.col("again_key"))
    repeated = kept.join(small(again), same, "left_semi").dropDuplicates(["doc_id", "text_key"])
    return _without(kept, twice).select(*COLUMNS).union(repeated.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text contains no benchmark item."""
    keyed = docs.withColumn("text_key", F.sha2(F.col("text"), 256))
    leaks = decontaminate.contained_items(keyed, table(spark, sf_dir, "benchmark"), doc_id="text_key")
    leaked = stored(leaks.select(F.col("text_key").alias("leaked_key")).distinct(), "leaked")
    return keyed.join(small(leaked), F.col("text_key") == F.col("leaked_key"), "left_anti").select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; n_chars is counted again."""
    found = secrets.with_spans(docs, list(COLUMNS))
    clean = found.withColumn("text", secrets.masked("text", "spans"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, and whether decoding gives its text back."""
    found = pieces.encoded(F.col("text"), F.col("doc_id"), default_model())
    return docs.select("doc_id", "lang", "source", found.alias("p")).select(
        "doc_id",
        "lang",
        "source",
        F.coalesce(F.size("p.ids"), F.lit(0)).cast("long").alias("n_pieces"),
        "p.ids",
        "p.lossless",
    )


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("SentencePiece encoding and decoding", as_pieces),
]

#: A trained classifier and sampled pieces are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i + 1}")
    return docs
