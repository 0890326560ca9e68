"""Secret scans with multipart credential linking, in DataFrame expressions only.

Strong spans (a long value given to a password, an access key, a long hexadecimal run) stand on
their own. Weak ones (a user or key name, a short secret, an endpoint) say little alone and are
reported only where complementary parts co-occur: intervals of the same scope with at most `reach`
characters between them, a secret beside an identifier or an endpoint. A scope is a stretch of text
without a blank line.

The interval join needs no pairs: for intervals in order, the nearest part of a role is the one
before that ends last or the one behind that starts first, which two windows find. Every row is
scanned; the matches of equal texts are then taken as one. Positions come from the lengths of the
matches and of the text between them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: The strong patterns, in the order in which kinds are listed.
ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Weak patterns, and the blank lines that bound scopes.
IDENTIFIER = (
    r"""(?i:access_?key(?:_?id)?|client_?id|user_?name|user|login|account)"""
    r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}"""
)
SECRET = (
    r"""(?i:pass(?:word|wd|phrase|code)?|pwd|(?:client_?|access_?)?secret(?:_?key)?|token|api_?key"""
    r"""|private_?key|credentials?)["']?\x20*[:=]\x20*["']?[^\x20\x09-\x0D"',;]{4,}"""
)
ENDPOINT = (
    r"""(?i:(?:https?|ftps?|ssh|s3|redis|amqps?|mongodb|mysql|postgres(?:ql)?|jdbc:[a-z]+)://"""
    r"""[^\x20\x09-\x0D"'<>]+|(?:endpoint|host|hostname|server)["']?\x20*[:=]\x20*["']?[a-z0-9.:-]{3,})"""
)
GAP = r"\n[\x20\x09\x0B-\x0D]*\n"

#: Kind, pattern, shortest match, role in linking. Kinds of one start are listed in this order.
KINDS = (
    ("assign", ASSIGN, "secret"),
    ("access", ACCESS, "identifier"),
    ("hex", HEX, "none"),
    ("identifier", IDENTIFIER, "identifier"),
    ("secret", SECRET, "secret"),
    ("endpoint", ENDPOINT, "endpoint"),
    ("gap", GAP, "gap"),
)
STRONG = ("assign", "access", "hex")
SHORTEST_VALUE = 12


def matches(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, listed, role, start, end) of every match of every pattern, by code points.

    A text without any match but blank lines gives no row. Equal keys must have equal texts.
    """
    any_match = reduce(or_, [F.col(text).rlike(p) for kind, p, _ in KINDS if kind != "gap"])
    found = F.array(
        *[
            F.when(
                F.col(text).rlike(p),
                F.struct(
                    F.lit(i).alias("listed"),
                    F.split(F.col(text), p, -1).alias("between"),
                    F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("hits"),
                ),
            )
            for i, (_, p, _) in enumerate(KINDS)
        ]
    )
    kinds = texts.where(any_match).select(key, F.explode(F.array_compact(found)).alias("f"))
    parts = (
        kinds.select(key, "f.listed", F.posexplode(F.arrays_zip("f.between", "f.hits")).alias("i", "p"))
        .where("p.hits is not null")
        .select(
            key,
            "listed",
            "i",
            F.length("p.between").alias("ahead"),
            F.length("p.hits").alias("size"),
            (
                (F.col("listed") != 0)
                | (F.length(F.regexp_extract("p.hits", ASSIGN, 2)) >= SHORTEST_VALUE)
            ).alias("valid"),
        )
        .distinct()
    )
    upto = Window.partitionBy(key, "listed").orderBy("i")
    end = F.sum(F.col("ahead") + F.col("size")).over(upto)
    names = F.array(*[F.lit(k) for k, _, _ in KINDS])
    roles = F.array(*[F.lit(r) for _, _, r in KINDS])
    return (
        parts.withColumn("end", end)
        .where("valid")
        .select(
            key,
            F.element_at(names, F.col("listed") + 1).alias("kind"),
            "listed",
            F.element_at(roles, F.col("listed") + 1).alias("role"),
            (F.col("end") - F.col("size")).alias("start"),
            "end",
        )
    )


def linked_spans(found: DataFrame, key: str, reach: int) -> DataFrame:
    """The strong spans, and the weak ones beside a complementary part of their scope."""
    order = [F.col("start"), F.col("listed"), F.col("end")]
    ahead = Window.partitionBy(key).orderBy(*order)
    scoped = (
        found.withColumn("scope", F.sum((F.col("role") == "gap").cast("int")).over(ahead))
        .withColumn(
            "assigned",
            F.max(F.when(F.col("kind") == "assign", F.col("end"))).over(
                ahead.rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .where("kind <> 'gap'")
        # A weak secret that an assignment already covers is that assignment.
        .where("not (kind = 'secret' and coalesce(assigned > start, false))")
    )
    inside = Window.partitionBy(key, "scope").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    behind = inside.rowsBetween(1, Window.unboundedFollowing)

    def near(role: str) -> Column:
        is_role = F.col("role") == role
        last = F.max(F.when(is_role, F.col("end"))).over(before)
        first = F.min(F.when(is_role, F.col("start"))).over(behind)
        return F.coalesce(F.col("start") - last <= reach, F.lit(False)) | F.coalesce(
            first - F.col("end") <= reach, F.lit(False)
        )

    beside = scoped.select(
        "*", *[near(r).alias(f"near_{r}") for r in ("identifier", "secret", "endpoint")]
    )
    reported = (
        F.col("kind").isin(*STRONG)
        | ((F.col("role") == "secret") & (F.col("near_identifier") | F.col("near_endpoint")))
        | (F.col("role").isin("identifier", "endpoint") & F.col("near_secret"))
    )
    return beside.where(reported).select(key, "kind", "listed", "start", "end")


def spans_of_texts(docs: DataFrame, key: str = "key", text: str = "text", reach: int = 200) -> DataFrame:
    """(key, spans) of the texts with any: spans in order of start, then of kind as listed."""
    spans = linked_spans(matches(docs, key, text), key, reach)
    listed = F.sort_array(F.collect_list(F.struct("start", "listed", "end", "kind")))
    return spans.groupBy(key).agg(listed.alias("spans"))


def text_key(text: str = "text") -> Column:
    """What equal texts have in common; null for null."""
    return F.sha2(F.col(text), 256)


def with_spans(
    docs: DataFrame, columns: list[str], text: str = "text", reach: int = 200, few: int = 1_000_000
) -> DataFrame:
    """`columns` of `docs`, and `spans` (empty for a text without any, and for null and empty).

    Every row is kept, repeated ones too; a column named spans is replaced. The spans are joined
    by text, as a broadcast if they are `few`, else by a shuffle that splits hot texts.
    """
    keyed = docs.withColumn("__key", text_key(text))
    spans = spans_of_texts(keyed, "__key", text, reach)
    if text in columns:
        spans = stored(spans, "spans")
        if (spans.agg(F.sum(F.size("spans"))).first()[0] or 0) <= few:  # so rows are narrow
            spans = F.broadcast(spans)
    rest = [c for c in columns if c != "spans"]
    none = F.array().cast("array<struct<start:bigint,listed:int,end:bigint,kind:string>>")
    return (
        keyed.select(*rest, "__key")
        .join(spans, "__key", "left")
        .select(*rest, F.coalesce("spans", none).alias("spans"))
    )


def written(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.concat_ws(
        ",",
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])),
    )


def masked(text: str = "text", spans: str = "spans", mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by a mark."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        kept = F.substring(F.col(text), (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        # A span that overlaps the last one or follows it at once lengthens its mark.
        more = F.when((s["start"] < done["at"]) & (done["out"] != ""), F.lit("")).otherwise(
            F.concat(F.when(s["start"] > done["at"], kept).otherwise(F.lit("")), F.lit(mark))
        )
        return F.struct(
            F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["out"], more).alias("out")
        )

    def finish(done: Column) -> Column:
        return F.concat(done["out"], F.substring(F.col(text), (done["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) == 0, F.col(text)).otherwise(
        F.aggregate(F.col(spans), start, step, finish)
    )
