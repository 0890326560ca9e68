"""Operators that judge each text alone: repetition, pieces, licenses, language, sharding."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import language, licenses, pieces, queries, repetition, sharding

ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t\n"),
    (4, "a"),
    (5, "ein Wort\x85 und \x1cnoch ▁ eins 日本語 🎉 \x00 x"),
    (None, "row without an id"),
    (7, "same text"),
    (7, "same text"),
    (8, "x" * 70_000),
    (9, "long words and more of them, " * 3000),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


# Repetition


def longest_by_hand(text: str, least: int) -> list[int]:
    found = [0] * len(text)
    for i in range(len(text)):
        for j in range(len(text)):
            n = 0
            while i != j and max(i, j) + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            if n >= least:
                found[i] = max(found[i], n)
    return found


def test_repeats_equal_brute_force():
    rng = random.Random(5)
    for _ in range(250):
        letters = rng.choice(["ab", "abc\x00", "aé€", "a𐍈b", "abcdefgh", "ÿa"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        text += text[: rng.randint(0, len(text))] if rng.random() < 0.4 else ""
        least = rng.choice([1, 2, 3, 8, 9, 16, 17])
        expected = longest_by_hand(text, least)
        assert repetition.longest_repeats(text, least).tolist() == expected
        marked = np.zeros(len(text), bool)
        for i, n in enumerate(expected):
            marked[i : i + n] = True
        assert repetition.covered(*repetition.repeated_spans(text, least)) == marked.sum()


def base_by_hand(text: str):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


def test_quality_rules(spark, odd, sf_dir):
    docs = odd.withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    rows = repetition.with_repetition(docs).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = r["text"] or ""
        base = base_by_hand(text) if len(text) < 50_000 else tuple(r[c] for c in repetition.BASE_FIELDS)
        assert tuple(r[c] for c in repetition.BASE_FIELDS) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[8]["longest_repeat"] == 69_999 and by_id[8]["repeat_chars"] == 70_000
    assert not any(r["kept"] for r in rows)
    assert repetition.with_repetition(docs.limit(0)).count() == 0


def test_repeated_half_is_refused_and_prose_kept(spark):
    rng = random.Random(2)
    prose = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(200))
    half = prose[:400]
    docs = spark.createDataFrame([(1, prose), (2, prose + " " + half), (3, half + " - " + half)], "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in repetition.with_repetition(docs).collect()}
    assert kept == {1: True, 2: True, 3: False}


# Pieces


def test_pieces_give_every_text_back(odd):
    model = queries.default_model()
    found = pieces.encoded(F.col("text"), F.col("doc_id"), model)
    spelt = odd.select("doc_id", "text", found.alias("p")).select("doc_id", "text", "p.*")
    rows = spelt.select("*", pieces.decoded(F.col("ids"), model).alias("back")).collect()
    assert len(rows) == len(ODD)
    assert all(r["back"] == r["text"] and r["lossless"] for r in rows)
    assert [r["ids"] for r in rows if r["doc_id"] == 1] == [None]
    assert [r["ids"] for r in rows if r["doc_id"] == 2] == [[]]
    same = [r["ids"] for r in rows if r["doc_id"] == 7]
    assert same[0] == same[1]
    split = odd.repartition(7).select("doc_id", found["ids"].alias("ids")).collect()
    assert Counter((r["doc_id"], str(r["ids"])) for r in split) == Counter((r["doc_id"], str(r["ids"])) for r in rows)


def drawn_in_portions(docs, portion, held):
    """The ids of every row, sampled `portion` rows at a time."""
    found = {}
    for at in range(0, len(docs), portion):
        part = docs[at : at + portion]
        keys = np.array([i * 7919 for i, _ in part], np.int64).astype(np.uint64)
        offsets, ids = pieces.sample([t for _, t in part], keys, held, 0)
        found |= {i: ids[a:b].tolist() for (i, _), a, b in zip(part, offsets, offsets[1:])}
    return found


@pytest.fixture(scope="module")
def texts_of_the_table(spark, sf_dir):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_pieces_do_not_depend_on_the_portion(texts_of_the_table):
    words, docs = pieces.vocabulary(queries.default_model(), 1.0), texts_of_the_table
    whole = drawn_in_portions(docs, len(docs), pieces.Lattices(words))
    for portion, order in ((7, 1), (31, 1), (len(docs), -1), (7, -1)):
        assert drawn_in_portions(docs[::order], portion, pieces.Lattices(words)) == whole


def test_long_chunks_are_drawn_like_short_ones(texts_of_the_table, monkeypatch):
    words, docs = pieces.vocabulary(queries.default_model(), 1.0), texts_of_the_table[:40]
    docs = [*docs, (-1, "Donaudampfschiffahrt" * 9 + " 日本語の文章 x")]
    together = drawn_in_portions(docs, 50, pieces.Lattices(words))
    monkeypatch.setattr(pieces, "_LONG", 3)
    assert drawn_in_portions(docs, 50, pieces.Lattices(words)) == together


def test_a_million_characters_without_a_blank():
    words = pieces.vocabulary(queries.default_model(), 1.0)
    text = "漢字だけの文章です" * 55_000 + "abcdefgh" * 62_500
    offsets, ids = pieces.sample([text], np.array([1], np.uint64), pieces.Lattices(words), 0)
    assert pieces.spelt_texts(offsets, ids, words) == [text]


def test_pieces_of_an_empty_table(odd):
    found = pieces.encoded(F.col("text"), F.col("doc_id"), queries.default_model())
    assert odd.limit(0).select(found.alias("p")).collect() == []


def test_pieces_are_handed_on_portion_by_portion(monkeypatch):
    # What a task gets is the function itself.
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda f: lambda *columns: f)
    texts = [None, "", *(f"word {i} of many others" for i in range(90))]
    batch = pa.array(texts, pa.string()), pa.array(range(len(texts)), pa.int64())
    encode = pieces.encoded(F.lit(""), F.lit(0), queries.default_model())
    whole = [x for found in encode(iter([batch])) for x in found.to_pylist()]
    monkeypatch.setattr(pieces, "_PORTION", 200)
    parts = [found.to_pylist() for found in encode(iter([batch, batch]))]
    assert len(parts) >= 18 and max(map(len, parts)) <= 12
    assert [x for part in parts for x in part] == whole * 2
    assert whole[:2] == [{"ids": None, "lossless": True}, {"ids": [], "lossless": True}]


def test_sampling_follows_the_weights_of_the_paths():
    path = queries.default_model()
    words = pieces.vocabulary(path, 1.0)
    known = {p: i for i, p in enumerate(piece_names(path)) if i >= 259}

    def paths(rest):
        if not rest:
            yield (), 0.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in known:
                first = known[rest[:n]]
                for p, w in paths(rest[n:]):
                    yield (first, *p), words.weight[first] + w

    weights = {p: math.exp(w) for p, w in paths("▁hello")}
    total, n = sum(weights.values()), 20_000
    offsets, ids = pieces.sample([" hello"] * n, np.arange(n), pieces.Lattices(words), 11)
    drawn = Counter(tuple(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:]))
    assert set(drawn) <= set(weights)
    assert all(abs(w / total - drawn[p] / n) < 0.015 for p, w in weights.items())


def piece_names(path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]


# Licenses


def containment_by_hand(text: str, template: str, k: int = 5) -> tuple[int, int]:
    def shingles(t):
        words = licenses.words_of(t.encode())
        return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()

    needed = shingles(template)
    return len(needed), len(needed & shingles(text))


def test_licenses_equal_brute_force(spark, sf_dir, odd):
    notice = licenses.TEMPLATES["apache-2.0-header"]
    words = notice.split()
    part, less = " ".join(words[: int(len(words) * 0.9)]), " ".join(words[: int(len(words) * 0.5)])
    extra = [(100, "intro " * 40 + notice + " more" * 30), (101, part), (102, less), (103, notice.upper())]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).union(odd)
    found = licenses.license_matches(docs.withColumn("template", F.lit("clash"))).collect()
    expected = Counter()
    for doc_id, text in docs.collect():
        for name, template in licenses.TEMPLATES.items():
            needed, shared = containment_by_hand(text or "", template)
            if 100 * shared >= 80 * needed:
                expected[doc_id, name, needed, shared] += 1
    assert Counter((r["doc_id"], r["template"], r["n_shingles"], r["n_found"]) for r in found) == expected
    assert {r["doc_id"] for r in found if r["template"] == "apache-2.0-header"} == {100, 101, 103}
    assert licenses.license_matches(docs, {}).count() == 0


def test_short_notices_are_found_inside_long_texts(spark, sf_dir):
    texts = ["word " * 50 + "\nAll rights reserved.", "all RIGHTS reserved", "all rights are reserved here " * 9, None, ""]
    texts += ["All rights reserved. Released under the MIT License. All rights reserved.", "rights reserved", "x MIT y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = licenses.TEMPLATES | licenses.NOTICES | {"one": "MIT"}
    found = {tuple(r) for r in licenses.license_matches(docs, wanted).collect()}
    assert found == {
        (0, "all-rights-reserved", 1, 1, 50, 52),
        (1, "all-rights-reserved", 1, 1, 0, 2),
        (5, "all-rights-reserved", 1, 1, 0, 10),
        (5, "mit-notice", 1, 1, 3, 7),
        (5, "one", 1, 1, 6, 6),
        (7, "one", 1, 1, 1, 1),
    }
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = {r["doc_id"] for r in queries.op8_licenses(spark, sf_dir).collect() if r["template"] == "all-rights-reserved"}
    noticed = {r["doc_id"] for r in docs.collect() if "all rights reserved" in " ".join(re.findall("[a-z0-9]+", (r["text"] or "").lower()))}
    assert told == noticed and told


# Language


def test_language_held_out_accuracy(spark, sf_dir):
    rows = queries.op7_language(spark, sf_dir).collect()
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = [r for r in rows if r["held_out"]]
    assert len(rows) == len(known) and len(out) > 20
    assert sum(r["lang_pred"] == known[r["doc_id"]] for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs)
    told = language.identified(odd.withColumn("score", F.lit("clash")), model).collect()
    assert len(told) == len(ODD)
    for r in told:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not lettered)
        assert r["rejected"] or lettered
    unread = language.identified(spark.createDataFrame([(1, "漢字だけの文章です。" * 5)], "doc_id long, text string"), model)
    assert unread.first()["rejected"]
    nothing = language.train(docs.limit(0))
    unlearnt = language.identified(odd, nothing).collect()
    assert {r["lang_pred"] for r in unlearnt} == {"und"}
    assert all(r["rejected"] != any(c.isalpha() for c in r["text"] or "") for r in unlearnt)
    assert language.identified(odd.limit(0), model).count() == 0


def test_only_letters_are_counted():
    text = "Schöne neue Welt, 42 mal! " * 30
    whole = language.subword_counts(text)
    assert whole.sum() > 0
    assert language.subword_counts("1234 !?").sum() == 0
    assert (language.subword_counts("ab, 12 ab") == language.subword_counts(" ab ab!")).all()


def buckets_by_hand(text):
    found = Counter()
    folded = "".join(c if "a" <= c <= "z" or ord(c) >= 170 else " " for c in text.lower())
    codes = [ord(c) for c in f" {' '.join(folded.split(' '))} "]
    codes = [c for i, c in enumerate(codes) if not (i and c == 32 and codes[i - 1] == 32)]
    for n in (2, 3, 4):
        for i in range(len(codes) - n + 1):
            value = 0
            for c in codes[i : i + n]:
                value = (value * 0x100000001B3 + c) % 2**64
            found[value * 0x9E3779B97F4A7C15 % 2**64 >> 49] += 1
    return found


@pytest.mark.parametrize("chunk", [1, 2, 5, 1 << 20])
def test_subwords_equal_plain_counts_in_chunks_of_any_size(monkeypatch, chunk):
    monkeypatch.setattr(language, "_CHUNK", chunk)
    for text in ("", "a", "Ab  c1d", "x" * 9, "1 2 3", "Größe, Σίσυφος ½²! ", " ab\n\ncd ef" * 3):
        counts = language.subword_counts(text)
        assert {i: n for i, n in enumerate(counts.tolist()) if n} == buckets_by_hand(text)


def test_predictions_equal_plain_counts_and_softmax(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs.where(~language.held_out()))
    told = language.identified(docs, model).collect()
    for r in told[:60]:
        counts = buckets_by_hand(r["text"] or "")
        total = sum(counts.values())
        z = [
            (sum(n * float(model.scores[b, j]) for b, n in counts.items()) / total + float(model.bias[j])) / model.temperature
            for j in range(len(model.languages))
        ]
        e = [math.exp(x - max(z)) for x in z]
        best = e.index(max(e))
        assert r["lang_pred"] == model.languages[best] and abs(r["score"] - e[best] / sum(e)) < 1e-6
        seen = sum(n for b, n in counts.items() if model.seen[b])
        assert r["rejected"] == (r["score"] < model.threshold or seen < model.least_seen * total)


def test_texts_without_letters_have_no_language(spark, sf_dir):
    model = language.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for text in ("½ ²", "①", "Ⅷ", "٣", "_", " ", "!"):
        assert language.predict(text, model) == ("und", 0.0, True)
    assert language.predict("ª", model)[0] != "und"


def test_every_label_is_learnt(spark):
    rows = [(i, f"wort{i % 300} nummer{i % 300} text", f"l{i % 300:03}") for i in range(600)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_rows=400, epochs=1)
    assert len(model.languages) == 300


# Sharding


def test_shards_follow_the_mixture(spark, sf_dir):
    rows = queries.op5_interleaved_shards(spark, sf_dir).collect()
    n = Counter(r["shard"] for r in rows)
    assert set(n) == set(range(8)) and max(n.values()) - min(n.values()) <= 1
    for shard, size in n.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(size))
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    each = Counter((r["shard"], source[r["doc_id"]]) for r in rows)
    for name, total in Counter(source.values()).items():
        assert all(abs(each[s, name] - total / 8) <= 2 for s in n)


def test_shards_of_odd_rows(spark):
    rows = [(None, None), (None, None), (1, "a"), (1, "a"), (2, None)] + [(i, "hot") for i in range(3, 60)]
    table = spark.createDataFrame(rows, "doc_id long, source string").withColumn("shard", F.lit("clash"))
    dealt = sharding.interleaved_shards(table, "source", ["doc_id"], 4, buckets=8).collect()
    assert Counter((r["doc_id"], r["source"]) for r in dealt) == Counter(rows)
    n = Counter(r["shard"] for r in dealt)
    assert max(n.values()) - min(n.values()) <= 1
    assert all(sorted(r["slot"] for r in dealt if r["shard"] == s) == list(range(n[s])) for s in n)
    again = sharding.interleaved_shards(table.repartition(5), "source", ["doc_id"], 4, buckets=64).collect()
    place = lambda rs: {r["doc_id"]: r["shard"] for r in rs if r["source"] == "hot"}
    assert place(again) == place(dealt)
    assert sharding.interleaved_shards(table.limit(0), "source", ["doc_id"], 4).count() == 0
