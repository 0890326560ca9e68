"""License scans: MinHash bands over overlapping windows retrieve templates, containment verifies.

Templates are cut into pieces of up to `piece` shingles and parted by size: of the class s are the
pieces of more than s / 2 and up to s shingles. For each class a text has windows of 2 s shingles
that overlap by half, so a whole piece lies within one. A piece of which four fifths are there has a
similarity of at least 0.19 with that window; with bands of one row, `bands` of them collide at
least once with probability 1 - 0.81 ** bands: 0.9988 for 32. A verbatim piece has 0.25 at least:
0.9999.

Retrieved templates are verified by exact containment: the share of their distinct shingles that
the whole text has. An exact lookup of all templates' shingles goes ahead: a window without any of
them cannot collide in any band but by chance, so only windows around such shingles are signed. A template of fewer words than a shingle is one
shingle of its own length, and looked for among the text's shingles of that length. The templates are a parameter of bounded size and
travel with the function; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, portions, run_hashes

_WORD = re.compile(rb"[a-z0-9]+")
_PORTION = 4 << 20

#: Notices and headers as their licenses give them.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "mit-notice": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version."
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met"
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    ),
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

#: Notices shorter than a shingle of five words.
NOTICES = {"all-rights-reserved": "All rights reserved."}


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters and digits, lower-case; marks and layout differ between copies."""
    return _WORD.findall(text.lower())


class Templates:
    """The templates' shingles, and the signatures of their pieces by size class."""

    def __init__(self, texts: dict[str, str], k: int, bands: int, piece: int):
        self.k = k
        self.names = sorted(n for n, t in texts.items() if words_of(t.encode()))
        hashes = run_hashes([words_of(texts[n].encode()) for n in self.names], k)
        self.sets = [np.unique(h) for h in hashes]
        self.all = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
        self.salts = mix(np.arange(1, bands + 1, dtype=np.uint64))
        parts: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, h in enumerate(hashes):
            # Pieces of even length, so that none is a small remainder.
            for part in np.array_split(h, -(-len(h) // piece)):
                size = 1 << (len(part) - 1).bit_length()
                parts.setdefault(size, []).append((i, self.signature(part)))
        self.classes = {
            size: (np.array([i for i, _ in held]), np.stack([s for _, s in held]))
            for size, held in parts.items()
        }

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """The MinHash value of every band."""
        return mix(hashes[:, None] ^ self.salts[None, :]).min(axis=0)

    def retrieved(self, hashes: np.ndarray, shared: np.ndarray) -> set[int]:
        """Templates of which a piece collides with a window around the shared shingles."""
        found: set[int] = set()
        for size, (owners, signatures) in self.classes.items():
            block = shared // size
            for window in np.unique(np.concatenate([block, np.maximum(block - 1, 0)])).tolist():
                own = self.signature(hashes[window * size : (window + 2) * size])
                found.update(owners[(signatures == own).any(axis=1)].tolist())
        return found

    @classmethod
    def by_length(cls, texts: dict[str, str], k: int, bands: int, piece: int) -> list[Templates]:
        """The templates parted by the length of their shingles: k words, or all if there are fewer."""
        parts: dict[int, dict[str, str]] = {}
        for name, text in texts.items():
            if size := min(k, len(words_of(text.encode()))):
                parts.setdefault(size, {})[name] = text
        return [cls(part, size, bands, piece) for size, part in sorted(parts.items())]

    def matches(self, hashes: np.ndarray, percent: int) -> list[tuple[str, int, int, int, int]]:
        """(name, shingles, found, first and last place) of the templates contained."""
        at = np.minimum(np.searchsorted(self.all, hashes), len(self.all) - 1)
        shared = np.flatnonzero(self.all[at] == hashes) if len(self.all) else np.empty(0, int)
        result = []
        for i in sorted(self.retrieved(hashes, shared)) if len(shared) else ():
            of_it = shared[np.isin(hashes[shared], self.sets[i])]
            found = len(np.unique(hashes[of_it]))
            if 100 * found >= percent * len(self.sets[i]):
                result.append((self.names[i], len(self.sets[i]), found, int(of_it[0]), int(of_it[-1])))
        return result


def license_matches(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    percent: int = 80,
    k: int = 5,
    bands: int = 32,
    piece: int = 64,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, template, n_shingles, n_found, first_word, last_word), a row per template found.

    A template is found in a text that has `percent` of its distinct shingles of k words (one of
    fewer words, if the text has them all in a row); the words span the shingles found. A null or
    blank text matches nothing; repeated rows get theirs each; no template, no rows. Other columns
    are left out, so none can clash. Without `templates`, those of TEMPLATES are looked for.
    """
    texts = TEMPLATES if templates is None else templates
    kind = pa.struct(
        [("template", pa.string())]
        + [(n, pa.int64()) for n in ("n_shingles", "n_found", "first_word", "last_word")]
    )

    @F.arrow_udf(
        "array<struct<template:string,n_shingles:bigint,n_found:bigint,first_word:bigint,last_word:bigint>>"
    )
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = Templates.by_length(texts, k, bands, piece)
        names = [f.name for f in kind]
        for batch in batches:
            values, found = batch.cast(pa.binary()).to_pylist(), []
            for a, b in portions(values, _PORTION):
                split = [words_of(v or b"") for v in values[a:b]]
                rows: list[list[dict]] = [[] for _ in split]
                for part in held:
                    for row, hashes in zip(rows, run_hashes(split, part.k), strict=True):
                        row += [
                            dict(zip(names, (*m[:4], m[4] + part.k - 1), strict=True))
                            for m in part.matches(hashes, percent)
                        ]
                found += rows
            yield pa.array(found, pa.list_(kind))

    scanned = docs.select(F.col(doc_id).alias("__id"), scan(F.col(text)).alias("__found"))
    return scanned.select("__id", F.explode("__found").alias("m")).select(F.col("__id").alias(doc_id), "m.*")
