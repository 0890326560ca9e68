"""Fill-in-middle, mixing by weights and source divergence against plain versions of them."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from broadsheet.llm import divergence, middle, mixing

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
WORD = re.compile("[^\x20\x09-\x0d]+")

ODD = [
    (1, None, "de", "a"),
    (2, "", "de", "a"),
    (3, " \n\t ", None, "b"),
    (4, "a", "de", None),
    (5, "ein Wort\x85 und \x1cnoch ▁ eins 日本語 🎉 \x00 x ", "de", "c"),
    (None, "row without an id", "en", ""),
    (7, "same text", "en", "a"),
    (7, "same text", "en", "a"),
    (8, "x" * 70_000, "en", "b"),
    (9, "long words and more of them, " * 3000, "en", "b"),
    (10, "marked <P> text <S> here", "en", "c"),
    (11, "almost < P> <S <M and <", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


# Fill-in-middle


def cut_by_hand(doc_id, text, percent=50, spm_percent=80):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    spm = h[3] % 100 < spm_percent
    output = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if spm else "psm", len(p), len(m), output


@pytest.mark.parametrize("block", [1, 3, 256])
def test_trees_find_every_cut(block):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab €🎉\n", k=rng.randint(0, 40))) for _ in range(120)] + ["", " ", "a"]
    forest = middle.Forest([t.encode() for t in texts], block)
    for i, text in enumerate(texts):
        units = UNIT.findall(text)
        assert forest.totals[i] == len(units)
        for k in range(len(units) + 1):
            size, points = forest.cut(np.array([i]), np.array([k]))
            before = "".join(units[:k])
            assert (size[0], points[0]) == (len(before.encode()), len(before))


def test_fenwick_sums_cover_their_range():
    text = ("ab " * 50).encode()
    forest = middle.Forest([text], 4)
    for node in range(1, int(forest.blocks[0]) + 1):
        low = node - (node & -node)
        assert forest.code_points[node] == len(text[4 * low : 4 * node])


def test_fill_in_middle_equals_plain_version(odd):
    # Columns of the names added are replaced, others stay.
    docs = odd.withColumns({"form": F.lit("clash"), "n": F.lit("clash"), "extra": F.lit(1)})
    made = middle.filled_in_middle(docs, fim_percent=100, spm_percent=50, block=64)
    assert made.columns == ["doc_id", "text", "lang", "source", "extra", *middle._ADDED]
    made = made.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(made) == len(ODD)
    for r in made:
        expected = cut_by_hand(r["doc_id"], r["text"], 100, 50)
        assert tuple(r[c] for c in middle._ADDED) == expected
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = middle.filled_in_middle(docs.repartition(5)).collect()
    assert len(made) == docs.count()
    for r in made:
        assert tuple(r[c] for c in middle._ADDED) == cut_by_hand(r["doc_id"], r["text"])
    share = sum(r["form"] != "plain" for r in made) / len(made)
    assert 0.35 < share < 0.65


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert middle.filled_in_middle(empty).collect() == []
    mix = mixing.mixture(empty)
    assert mix.rows.collect() == [] and mix.pieces.collect() == [] and mix.sources.collect() == []
    found = divergence.audit(empty)
    assert found.pairs.collect() == [] and found.terms.collect() == [] and found.groups.collect() == []


# Mixing


def targets_by_hand(sizes, weights, most):
    """Sharing round by round until no source is above what it may give."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in stopped}
        left = total - sum(stopped.values())
        share = {s: Fraction(left * w, sum(rest.values())) for s, w in rest.items()}
        above = {s: most * sizes[s] for s in rest if share[s] > most * sizes[s]}
        if not above:
            return share | stopped
        stopped |= above


def mixed_docs(seed, rows, sources):
    rng = random.Random(seed)
    made = []
    for i in range(rows):
        source = rng.choice([*sources, sources[0], sources[0]])
        n = rng.choice([0, 1, 5, 40, 40, 300])
        made.append((i, " ".join(["w"] * n) + " " * (i % 3), "en", source))
    return made


@pytest.mark.parametrize("seed", [1, 2])
def test_mixture_follows_its_schedule(spark, seed):
    rows = mixed_docs(seed, 400, ["s1", "s2", "s3", None, "", "é", "tiny", "S"])
    rows = [r for r in rows if r[3] != "tiny"] + [(1000, "only two", "en", "tiny"), (1000, "only two", "en", "tiny")]
    mix = mixing.mixture(spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("clash")), block=16)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(WORD.findall(text))
    total = sum(sizes.values())
    wanted = targets_by_hand(sizes, (5, 2, 1), 3)
    sources = {r["source_number"]: r for r in mix.sources.collect()}
    assert [sources[i]["source"] for i in sorted(sources)] == sorted(sizes, key=lambda s: (s is None, s))
    bits = 0
    while total > 16 << bits:
        bits += 1
    edge = lambda r: r * total >> bits
    for r in sources.values():
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == float(wanted[r["source"]])
    assert sum(r["slots"] for r in sources.values()) == 1 << bits

    held = {r["row"]: r for r in mix.rows.collect()}
    assert len(held) == len(rows)
    assert Counter(r["id"] for r in held.values()) == Counter(r[0] for r in rows)
    pieces = mix.pieces.collect()
    by_slot = defaultdict(list)
    for p in pieces:
        assert held[p["row"]]["source_number"] == p["source_number"]
        by_slot[p["slot"]].append(p)
    # A slot's point lies among the cumulative targets of its source, to within the rounding of a slot.
    upto, stretch = Fraction(0), {}
    for number in sorted(sources):
        size = wanted[sources[number]["source"]] / total
        stretch[number] = (upto, upto + size)
        upto += size
    half = Fraction(1, 2 << bits)
    ranks = defaultdict(list)
    for slot in sorted(by_slot):
        point = Fraction(int(f"{slot:0{bits}b}"[::-1], 2), 1 << bits)
        (number,) = {p["source_number"] for p in by_slot[slot]}
        (rank,) = {p["rank"] for p in by_slot[slot]}
        low, high = stretch[number]
        assert low - half <= point <= high + half
        ranks[number].append(rank)
        words = sum(p["n_tokens"] for p in by_slot[slot])
        # Whole blocks, but for what would go beyond the last pass.
        assert words == edge(rank + 1) - edge(rank) or edge(rank + 1) > 3 * sources[number]["source_size"]
    for number, found in ranks.items():
        assert found == list(range(len(found)))
    # Every pass takes a row's words in order and once; no row goes beyond three passes.
    taken = Counter()
    of_row = defaultdict(list)
    for p in pieces:
        taken[p["source_number"]] += p["n_tokens"]
        of_row[p["row"], p["pass"]].append((p["first_token"], p["n_tokens"]))
    for (row, turn), stretches in of_row.items():
        assert 0 <= turn < 3
        at = 0
        for first, n in sorted(stretches):
            assert first == at and n > 0
            at += n
        assert at <= held[row]["size"]
    for number, r in sources.items():
        assert abs(taken[number] - wanted[r["source"]]) <= 16
    # Any run of slots from the first on has the sources in proportion, to within a few blocks.
    seen, all_slots = Counter(), 1 << bits
    for i in range(all_slots):
        if i in by_slot:
            seen[by_slot[i][0]["source_number"]] += 1
        for number, r in sources.items():
            assert abs(seen[number] - (i + 1) * r["slots"] / all_slots) <= bits + 1


def test_mixture_does_not_depend_on_layout(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def taken(df):
        mix = mixing.mixture(df)
        pieces = mix.pieces.join(mix.rows.select("row", "id"), "row").drop("row")
        return sorted(map(tuple, pieces.collect()))

    assert taken(docs) == taken(docs.repartition(7))


def test_mixture_of_no_words(spark, odd):
    mix = mixing.mixture(odd.where("doc_id <= 3"))
    assert {(r["source"], r["target"], r["slots"]) for r in mix.sources.collect()} == {("a", 0.0, 0), ("b", 0.0, 0)}
    assert mix.rows.count() == 3 and mix.pieces.count() == 0


def test_mixture_of_odd_rows(spark, odd):
    mix = mixing.mixture(odd.drop("lang"))
    sizes = Counter()
    for _, text, _, source in ODD:
        sizes[source] += len(WORD.findall(text or ""))
    wanted = targets_by_hand(sizes, (5, 2, 1), 3)
    for r in mix.sources.collect():
        assert r["target"] == float(wanted[r["source"]])
    assert mix.rows.count() == len(ODD)


# Divergence


def audit_by_hand(rows, least_docs):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = {c: c + 32 for c in range(65, 91)}
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        words = term.findall((text or "").translate(lower))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    pairs, terms = {}, {}
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(counts[g])

        def share(count, kept=kept):
            n = sum(count[t] for t in kept)
            return lambda t: 1 + 10**9 * (count[t] + 1) // (n + len(kept))

        p, q = share(counts[lang, source]), share(whole)
        for t in kept:
            if counts[lang, source][t] and p(t) > q(t):
                terms[lang, source, t] = (p(t) - q(t)) ** 2 // q(t)
        for other in (s for l, s in groups if l == lang and s != source):
            o = share(counts[lang, other])
            pairs[lang, source, other] = sum((p(t) - o(t)) ** 2 // o(t) for t in kept)
    return groups, pairs, terms


@pytest.mark.parametrize(("group_block", "term_block"), [(16, 8192), (2, 3), (1, 1)])
def test_divergence_equals_plain_version(spark, group_block, term_block):
    rng = random.Random(11)
    words = ["Der", "die", "das", "ÄÖ", "ñu", "x1y", "don't", "日本語", "e-mail"]
    rows = list(ODD)
    for i in range(150):
        text = " ".join(rng.choices(words, k=rng.randint(0, 12)))
        rows.append((100 + i, text, rng.choice(["de", "en", None]), rng.choice(["a", "b", "c", "d", "e", None])))
    rows.append((300, "alone", "fr", "a"))
    rows.append((301, None, "fr", "b"))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit("clash"))
    found = divergence.audit(docs, 3, group_block, term_block)
    groups, pairs, terms = audit_by_hand(rows, 3)
    assert {(r["lang"], r["source"]) for r in found.groups.collect()} == groups
    assert {(r["lang"], r["source"], r["other"]): r["value"] for r in found.pairs.collect()} == pairs
    assert {(r["lang"], r["source"], r["term"]): r["value"] for r in found.terms.collect()} == terms
    assert pairs["fr", "a", "b"] == 0


def test_long_texts_are_split_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "_LONG", 7)
    text = "ab cde fghijklmnop q, rs é日本語日本語 t"
    split = [w for part in divergence.words_of(text.encode()) for w in part]
    assert split == [w.encode() for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]


def test_counts_beyond_a_long_are_shared(spark):
    df = spark.sql("select 20000000000L as c, 30000000000000L as n, 7L as v")
    p = df.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).first()[0]
    assert p == 1 + 10**9 * (20000000000 + 1) // (30000000000000 + 7)


def test_the_new_queries_are_registered():
    names = {n.split("_")[0] for n in entry.queries()}
    assert {"op11", "op12", "op13"} <= names
