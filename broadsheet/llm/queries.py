"""The registered queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import (
    archive,
    decontaminate,
    divergence,
    jaccard_join,
    language,
    licenses,
    middle,
    mixing,
    paragraphs,
    pieces,
    repetition,
    secrets,
    sharding,
)
from broadsheet.operators.pinning import scratch_dir

from .common import table
from .oracle import ORACLE as ORACLE


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, repetition and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.with_repetition(docs).drop("text", "longest_repeat", "n_repeats")


def default_model() -> str:
    """The vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, and whether decoding gives its text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spelt = docs.select("doc_id", pieces.encoded(F.col("text"), F.col("doc_id"), default_model()).alias("p"))
    return spelt.select(
        "doc_id",
        F.coalesce(F.size("p.ids"), F.lit(0)).cast("long").alias("n_pieces"),
        "p.ids",
        "p.lossless",
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back by byte ranges."""
    path = scratch_dir(spark, "warc")
    archive.write_archive(table(spark, sf_dir, "pages"), path)
    records = archive.read_archive(spark, path)
    response = F.col("record_type") == "response"
    return records.select(
        archive.page_number(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long"))
        .otherwise(F.col("payload_length"))
        .alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        archive.page_number(F.col("refers_to")).alias("refers_to"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of strong secrets, and of weak ones beside a complementary part."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.with_spans(docs, ["doc_id"])

    def of_kind(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in secrets.STRONG],
        F.sha2(secrets.written(of_kind(*secrets.STRONG)), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
    )


def op5_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards with the mixture of sources of the whole, and equal counts."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    identity = ["doc_id", "size", "text_crc32"]
    dealt = sharding.interleaved_shards(slim, "source", identity, shards=8)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined by 0.85 similar sets of four-word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_groups(docs, words=4, percent=85)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every document, learnt from four fifths of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~language.held_out()))
    marked = docs.select("doc_id", "text", language.held_out().alias("held_out"))
    return language.identified(marked, model).drop("text")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates and short notices found in every document."""
    wanted = licenses.TEMPLATES | licenses.NOTICES
    return licenses.license_matches(table(spark, sf_dir, "documents"), wanted)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items of which a document contains four fifths or more."""
    return decontaminate.contained_items(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op10_repeated_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that repeat within or across documents, and which of them are removed."""
    return paragraphs.repeated_paragraphs(table(spark, sf_dir, "documents"), stretch=50)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved last, or as it is, and the text made of that again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = middle.filled_in_middle(docs, spm_percent=80)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mixture of all sources takes."""
    mix = mixing.mixture(table(spark, sf_dir, "documents"))
    taken = mix.pieces.groupBy("row").agg(F.sum("n_tokens").alias("taken"))
    sources = mix.sources.select("source_number", "source_size", "target")
    return (
        mix.rows.join(sources, "source_number")
        .join(taken, "row", "left")
        .select(
            F.col("id").alias("doc_id"),
            "size",
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's divergence from each other one of its language, and its 200 foremost terms."""
    found = divergence.audit(table(spark, sf_dir, "documents"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = found.pairs.withColumnRenamed("other", "item").withColumn("rank", place)
    terms = found.terms.withColumnRenamed("term", "item").withColumn("rank", place).where("rank <= 200")
    columns = ["item", "value", "rank"]
    return pairs.select("lang", "source", F.lit("pair").alias("part"), *columns).union(
        terms.select("lang", "source", F.lit("term").alias("part"), *columns)
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_sampled_pieces,
        op3_warc,
        op4_secrets,
        op5_interleaved_shards,
        op6_jaccard_join,
        op7_language,
        op8_licenses,
        op9_decontamination,
        op10_repeated_paragraphs,
        op11_fill_in_middle,
        op12_mixed_sources,
        op13_source_divergence,
    )
}
