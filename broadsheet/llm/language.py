"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its character runs of two to four, hashed into a fixed
table; a linear layer with softmax on that mean names the language. Embeddings and layer are
learnt together by stochastic gradient descent in numpy, on a sample of labelled rows whose size is
bounded by two parameters: about `per_language` rows of each language, fewer if there are so many
languages that `most_rows` would be exceeded. Every label that has rows is learnt. Their subword
counts are made by Spark tasks from the whole texts; the driver gets only those counts.

A fifth of the sample is kept from the descent. On it a temperature is fitted, so that the score
is a calibrated probability, and two bounds are set below which a text is rejected: the `reject`
quantile of the scores there, and that of the share of a text's subwords that training has seen, each
at most `ceiling`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored

BUCKETS = 1 << 15
RUNS = (2, 3, 4)
UNKNOWN = "und"
_CHUNK = 1 << 20


@dataclass(frozen=True)
class Model:
    """`scores` is the table of embeddings times the linear layer: one row per bucket; `seen` says
    which buckets training has met."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    seen: np.ndarray
    temperature: float
    threshold: float
    least_seen: float


def subword_counts(text: str) -> np.ndarray:
    """How often each bucket occurs among the text's runs of lower-case characters and gaps.

    Up to code point 169 everything but a to z is one gap, so digits, marks and layout of Latin
    texts say nothing; beyond, every character counts, marks and digits of other scripts too. Long
    texts are counted in chunks that carry the last characters over, so memory does not grow with
    the counts and no run is lost or met twice.
    """
    counts = np.zeros(BUCKETS, np.int64)
    lowered = text.lower()
    carry = np.array([32], np.uint64)
    for at in range(0, len(lowered) + 1, _CHUNK):
        chunk, last = lowered[at : at + _CHUNK], at + _CHUNK > len(lowered)
        codes = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        codes[(codes < 97) | ((codes > 122) & (codes < 170))] = 32
        # The text ends in a gap, as it begins with one.
        codes = np.concatenate([carry, codes, np.full(int(last), 32, np.uint64)])
        gap = codes == 32
        keep = np.ones(len(codes), bool)
        keep[1:] = ~(gap[1:] & gap[:-1])
        codes, old = codes[keep], len(carry)
        rolled = codes.copy()
        for n in range(2, RUNS[-1] + 1):
            if len(codes) < n:
                break
            rolled = rolled[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            # Runs that end in what was carried over are counted already.
            new = rolled[max(0, old - n + 1) :]
            if n in RUNS:
                spread = (new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)
                counts += np.bincount(spread.astype(np.int64), minlength=BUCKETS)
        carry = codes[-(RUNS[-1] - 1) :]
    return counts


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def bucket_fraction(doc_id: Column) -> Column:
    """An even number in [0, 1) from an id, for taking samples that do not depend on layout."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16**13))


def _sample(labelled: DataFrame, per_language: int, most_rows: int) -> list:
    """(lang, order, buckets, counts) of about `per_language` rows of each language, and no more
    than `most_rows` in all, but for a row of each language."""
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(bucket_fraction(F.col("doc_id"))).alias("least"))
    counts = stored(counts, "labels")
    languages = counts.count()
    if not languages:
        return []
    wanted = max(1, min(per_language, most_rows // languages))
    # The rows of a language below its share of the even order, its first row at any rate, and a hard
    # bound on all of them.
    share = F.greatest(F.least(F.lit(1.0), F.lit(float(wanted)) / F.col("n")), F.col("least") + F.lit(1e-12))
    shares = counts.select(F.col("lang").alias("label"), share.alias("share"))
    chosen = (
        labelled.withColumn("order", bucket_fraction(F.col("doc_id")))
        .join(small(shares), F.col("lang") == F.col("label"))
        .where(F.col("order") < F.col("share"))
        .limit(2 * (wanted + 1) * languages)
    )

    # As bytes, which the driver holds in a tenth of the memory of lists.
    @F.arrow_udf("struct<bucket:binary,n:binary>")
    def sparse(texts: pa.Array) -> pa.Array:
        buckets, numbers = [], []
        for text in texts:
            counts = subword_counts(text.as_py() or "")
            at = np.flatnonzero(counts)
            buckets.append(at.astype(np.int32).tobytes())
            numbers.append(counts[at].astype(np.int32).tobytes())
        return pa.StructArray.from_arrays(
            [pa.array(buckets, pa.binary()), pa.array(numbers, pa.binary())], ["bucket", "n"]
        )

    rows = chosen.select("lang", "order", sparse("text").alias("x")).select("lang", "order", "x.*")
    return sorted(rows.collect(), key=lambda r: (r["order"], r["lang"], bytes(r["bucket"]), bytes(r["n"])))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    labelled: DataFrame,
    per_language: int = 400,
    most_rows: int = 20_000,
    dimensions: int = 16,
    epochs: int = 12,
    rate: float = 4.0,
    reject: float = 0.001,
    ceiling: float = 0.5,
    seed: int = 7,
) -> Model:
    """Learn from the columns doc_id, text and lang; rows without text or lang are left out.

    The sample has `per_language` rows of a language, or `most_rows` divided by the number of
    languages if that is less, twice as many at most. Without any labelled row the model knows no
    language and answers `und` to everything, and rejects none but texts without letters.
    """
    usable = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    rows = [r for r in _sample(usable, per_language, most_rows) if r["bucket"]]
    names = sorted({r["lang"] for r in rows})
    if not rows:
        none = np.zeros(0, np.float32)
        return Model([], np.zeros((BUCKETS, 0), np.float32), none, np.zeros(BUCKETS, bool), 1.0, 0.0, 0.0)
    shares = []
    for r in rows:
        n = np.frombuffer(r["n"], np.int32).astype(np.float32)
        shares.append((np.frombuffer(r["bucket"], np.int32), n / n.sum()))
    number = {name: i for i, name in enumerate(names)}
    y = np.array([number[r["lang"]] for r in rows])
    # Every fifth row of a language, so that all have rows to learn from.
    place = np.empty(len(rows), np.int64)
    for i in range(len(names)):
        of = np.flatnonzero(y == i)
        place[of] = np.arange(len(of))
    held = place % 5 == 4
    fit = np.flatnonzero(~held)
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / dimensions, 1 / dimensions, (BUCKETS, dimensions)).astype(np.float32)
    layer = rng.uniform(-1, 1, (dimensions, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    goal = np.eye(len(names), dtype=np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(fit)
        for at in range(0, len(order), 32):
            batch = order[at : at + 32]
            # Only the buckets that the batch has, as a dense table.
            touched, place = np.unique(np.concatenate([shares[i][0] for i in batch]), return_inverse=True)
            x = np.zeros((len(batch), len(touched)), np.float32)
            row = np.repeat(np.arange(len(batch)), [len(shares[i][0]) for i in batch])
            x[row, place] = np.concatenate([shares[i][1] for i in batch])
            mean = x @ embed[touched]
            error = (_softmax(mean @ layer + bias) - goal[y[batch]]) / len(batch)
            back = error @ layer.T
            layer -= step * (mean.T @ error)
            bias -= step * 0.1 * error.sum(axis=0)
            embed[touched] -= step * 20 * (x.T @ back)
    scores = (embed @ layer).astype(np.float32)
    check = np.flatnonzero(held) if held.any() else fit
    z = np.stack([shares[i][1] @ scores[shares[i][0]] for i in check]) + bias

    def loss(t: float) -> float:
        return float(-np.log(_softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean())

    temperature = min(np.geomspace(0.1, 10, 81), key=loss)
    confidence = _softmax(z / temperature).max(axis=1)
    threshold = min(float(np.quantile(confidence, reject)), ceiling)
    seen = np.zeros(BUCKETS, bool)
    for i in fit:
        seen[shares[i][0]] = True
    known = [float(shares[i][1][seen[shares[i][0]]].sum()) for i in check]
    least_seen = min(float(np.quantile(known, reject)), ceiling)
    return Model(names, scores, bias, seen, float(temperature), threshold, least_seen)


def predict(text: str | None, model: Model) -> tuple[str, float, bool]:
    """Language, calibrated score, and whether to reject it; `und` and 0 for null, for no letter,
    both rejected, or if no language is known."""
    if not model.languages or not has_letter(text):
        return UNKNOWN, 0.0, not has_letter(text)
    counts = subword_counts(text)
    at = np.flatnonzero(counts)
    n = counts[at].astype(np.float64)
    z = (n @ model.scores[at]) / n.sum() + model.bias
    p = _softmax(z[None, :].astype(np.float64) / model.temperature)[0]
    best = int(p.argmax())
    unsure = p[best] < model.threshold or n[model.seen[at]].sum() < model.least_seen * n.sum()
    return model.languages[best], float(p[best]), bool(unsure)


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `lang_pred`, `score` and `rejected`; columns of these names are replaced.

    A rejected row has no language (`und`) or falls below a bound of the model. Only the text
    goes to Python; the model travels with the function, its size is fixed by buckets times
    languages.
    """

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def tell(texts: pa.Array) -> pa.Array:
        told = [predict(t.as_py(), model) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([t[i] for t in told], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))],
            ["lang", "score", "rejected"],
        )

    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    told = docs.select(*rest, tell(F.col(text)).alias("__told"))
    return told.select(*rest, F.col("__told.lang").alias("lang_pred"), "__told.score", "__told.rejected")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the row is kept from learning: its id's CRC-32 is a multiple of five (null: 0)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
