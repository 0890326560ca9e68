"""SentencePiece encoding by sampling, and lossless decoding.

A text is cut into chunks that no piece of the vocabulary crosses: a run of blanks with the word
behind it, or a single line break where no longer piece holds one. Over each chunk stands a lattice
of all pieces that spell a stretch of it. Forward filtering sums the weights of all paths to every
place; backward sampling then draws the last piece in proportion to the weight of the paths through
it, and so on to the front. As every path meets at the chunk ends, that samples whole texts.

A vocabulary of merges has ranks, not probabilities. Pieces are weighted by Zipf's law over their
rank, to the power of `sharpness`; a byte weighs as much as the last rank.

The draw at a place depends only on the seed, the row's key and the place, and the odds at a place, kept
as whole numbers, on its chunk alone: a row gets the same pieces however rows are split into batches
and tasks. Chunks are filtered together, place by place, but for long ones, which go one by one. Characters without a piece, and the blank
mark itself where a text has it, are spelt as bytes, so that decoding gives back every text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import mix, text_portions

MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PORTION = 1 << 18
_SLOTS = 18
#: Chunks of more characters are filtered and drawn one by one and not kept.
_LONG = 256
#: Edges kept for later portions of a task, about ten bytes each, and chunks.
_MOST_EDGES = 4_000_000
_MOST_CHUNKS = 100_000
#: Odds are whole numbers of `2 ** -31`.
_ODDS = 31


class Vocabulary:
    """Pieces, log weights and bytes of a model file."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [
            i
            for i in range(size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        rank = np.empty(len(plain))
        rank[np.argsort([-model.get_score(i) for i in plain], kind="stable")] = np.arange(1, len(plain) + 1)
        weight = -sharpness * np.log(rank * (1 / np.arange(1, len(plain) + 1)).sum())
        self.byte_weight = float(weight.min())
        self.byte_id = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(model.is_unknown(i) for i in self.byte_id):
            raise ValueError(f"{path} has no byte pieces, so not every text can be spelt")
        spelt = [model.id_to_piece(i) for i in plain]
        self.longest = max(map(len, spelt))
        if self.longest > 255:
            raise ValueError(f"{path} has pieces of more than 255 characters")
        self.weight = np.full(size, self.byte_weight)
        self.weight[plain] = weight
        self._index(spelt, np.array(plain, np.int32))
        self.bytes_of = [model.id_to_piece(i).replace(MARK, " ").encode() for i in range(size)]
        for b, i in enumerate(self.byte_id):
            self.bytes_of[i] = bytes([b])
        for i in range(size):
            if model.is_control(i) or model.is_unknown(i):
                self.bytes_of[i] = b""
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in spelt):
            raise ValueError(f"{path} has pieces that cross blanks")
        # Blank characters that no longer piece holds stand alone, which keeps chunks short.
        joined = {c for p in spelt if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\r\t" if c not in joined)
        alone_class = f"[{alone}]|" if alone else ""
        self.chunks = re.compile(f"{alone_class}{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+")


    def _index(self, spelt: list[str], ids: np.ndarray) -> None:
        """Open tables by different bits of the hash; what collides in one is in the next."""
        hashes = np.empty(len(spelt), np.uint64)
        for i, piece in enumerate(spelt):
            value = ord(piece[0]) + 1
            for c in piece[1:]:
                value = (value * int(_BASE) + ord(c)) & (2**64 - 1)
            hashes[i] = value
        if len(set(hashes.tolist())) < len(spelt):
            raise ValueError("two pieces have the same hash")
        self.tables = []
        while len(ids):
            shift = np.uint64(64 - _SLOTS)
            spread = mix(np.array([len(self.tables) + 1], np.uint64))[0] | np.uint64(1)
            with np.errstate(over="ignore"):
                slot = ((hashes * spread) >> shift).astype(np.int64)
            held, names = np.zeros(1 << _SLOTS, np.uint64), np.full(1 << _SLOTS, -1, np.int32)
            held[slot], names[slot] = hashes, ids
            self.tables.append((spread, shift, held, names))
            rest = names[slot] != ids
            hashes, ids = hashes[rest], ids[rest]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece with each hash, or -1."""
        found = np.full(len(hashes), -1, np.int32)
        for spread, shift, held, names in self.tables:
            slot = ((hashes * spread) >> shift).astype(np.int64)
            same = np.flatnonzero(held[slot] == hashes)
            found[same] = names[slot[same]]
        return found


@lru_cache(maxsize=2)
def vocabulary(path: str, sharpness: float) -> Vocabulary:
    return Vocabulary(path, sharpness)


class Lattices:
    """Filtered lattices of the chunks met so far, in arrays that grow by half.

    A node is a place in a chunk behind its first character. Its edges are the pieces that end
    there, the longest first, with the running sums of their odds given that a path ends there.
    """

    def __init__(self, words: Vocabulary):
        self.words = words
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.base, self.length = np.empty(1024, np.int64), np.empty(1024, np.int64)
        self.first = np.empty(1 << 16, np.int64)
        self.upto = np.empty(1 << 16, np.uint32)
        self.back, self.piece = np.empty(1 << 16, np.uint8), np.empty(1 << 16, np.int32)
        self.nodes = self.edges = 0

    def add(self, chunks: list[str]) -> None:
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        first, upto, back, piece = self._filtered("".join(chunks), lengths)
        old = len(self.number)
        self.number.update(zip(chunks, range(old, old + len(chunks)), strict=True))
        self.base = self._put(self.base, old, self.nodes + np.cumsum(lengths) - lengths)
        self.length = self._put(self.length, old, lengths)
        self.first = self._put(self.first, self.nodes, self.edges + first)
        self.upto = self._put(self.upto, self.edges, upto)
        self.back = self._put(self.back, self.edges, back)
        self.piece = self._put(self.piece, self.edges, piece)
        self.nodes += len(first)
        self.edges += len(upto)

    @staticmethod
    def _put(x: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
        if at + len(values) > len(x):
            grown = np.empty(max(at + len(values), len(x) * 3 // 2), x.dtype)
            grown[:at] = x[:at]
            x = grown
        x[at : at + len(values)] = values
        return x

    def _edges(self, text: str, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """End, length, piece and weight of every piece found, by rolling hashes of each length; by
        end, the longest first.

        A character without a piece of its own gets an edge of piece -1: its bytes.
        """
        words = self.words
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        at, rolled, found = np.arange(len(codes)), np.zeros(len(codes) + 1, np.uint64), []
        for size in range(1, words.longest + 1):
            at = at[place[at] >= size - 1]
            if not len(at):
                break
            # rolled[i + 1] is the hash of the characters that end at i.
            hashes = rolled[at] * _BASE + codes[at] if size > 1 else codes[at] + np.uint64(1)
            rolled[at + 1] = hashes
            piece = words.find(hashes)
            hit = piece >= 0
            if size == 1:
                bare = at[~hit]
                size_of = np.searchsorted([0x80, 0x800, 0x10000], codes[bare], side="right") + 1
                found.append((bare, np.full(len(bare), -1, np.int32), size_of * words.byte_weight, 1))
            found.append((at[hit], piece[hit], words.weight[piece[hit]], size))
        found.reverse()
        end = np.concatenate([f[0] for f in found])
        back = np.repeat([f[3] for f in found], [len(f[0]) for f in found])
        order = np.argsort(end, kind="stable")
        return (
            end[order],
            back[order],
            np.concatenate([f[1] for f in found])[order],
            np.concatenate([f[2] for f in found])[order],
        )

    def _filtered(self, text: str, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Forward filtering of all chunks together, place by place.

        Gives each node's first edge, and the edges' running probabilities, lengths and pieces.
        Sums are kept as logarithms, so long chunks neither vanish nor overflow.
        """
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(text)) - np.repeat(starts, lengths)
        end, back, piece, weight = self._edges(text, place)
        per_node = np.bincount(end, minlength=len(text))
        first = np.cumsum(per_node) - per_node
        level, share = np.zeros(len(text)), np.empty(len(end))
        for p in range(int(lengths.max())):
            nodes = starts[lengths > p] + p
            count = per_node[nodes]
            offset = np.cumsum(count) - count
            flat = np.repeat(first[nodes] - offset, count) + np.arange(int(count.sum()))
            before = np.where(back[flat] == p + 1, 0.0, level[end[flat] - back[flat]])
            w = weight[flat] + before
            top = np.maximum.reduceat(w, offset)
            e = np.exp(w - np.repeat(top, count))
            total = np.add.reduceat(e, offset)
            level[nodes] = top + np.log(total)
            share[flat] = e / np.repeat(total, count)
        # Whole numbers add up to the same wherever a chunk stands.
        run = np.cumsum((share * (1 << _ODDS)).astype(np.int64))
        run -= np.repeat(run[first] - (share[first] * (1 << _ODDS)).astype(np.int64), per_node)
        run[first + per_node - 1] = 1 << _ODDS  # no draw goes past the last edge
        return first, run, back, piece

    def drawn(self, chunk: str, draws: np.ndarray) -> tuple[list[int], list[int]]:
        """Pieces, last to first, and their ends in a long chunk, by the draws at its places."""
        end, back, piece, weight = self._edges(chunk, np.arange(len(chunk)))
        first = np.searchsorted(end, np.arange(len(chunk) + 1)).tolist()
        sizes, weights, level = back.tolist(), weight.tolist(), [0.0] * (len(chunk) + 1)
        odds: list[list[float]] = []
        for at in range(len(chunk)):
            paths = [weights[e] + level[at + 1 - sizes[e]] for e in range(first[at], first[at + 1])]
            top = max(paths)
            shares = [math.exp(w - top) for w in paths]
            total = sum(shares)
            level[at + 1] = top + math.log(total)
            odds.append([s / total for s in shares])
        pieces, ends, bound = [], [], draws.tolist()
        at = len(chunk)
        while at:
            left, edge = bound[at - 1] / (1 << _ODDS), first[at - 1]
            for share in odds[at - 1][:-1]:
                left -= share
                if left < 0:
                    break
                edge += 1
            pieces.append(int(piece[edge]))
            ends.append(at)
            at -= sizes[edge]
        return pieces, ends

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The number of every chunk; new ones are filtered first."""
        if len(self.number) > _MOST_CHUNKS or self.edges > _MOST_EDGES:
            self.clear()
        if new := set(chunks).difference(self.number):
            self.add(list(new))
        return np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))


def sample(
    texts: list[str], keys: np.ndarray, held: Lattices, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of the sampled pieces of all texts, one after the other."""
    words = held.words
    split = [words.chunks.findall(_marked(t)) for t in texts]
    per_text = np.fromiter(map(len, split), np.int64, len(split))
    if not per_text.sum():
        return np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int32)
    flat = [c for s in split for c in s]
    length = np.fromiter(map(len, flat), np.int64, len(flat))
    row = np.repeat(np.arange(len(texts)), per_text)
    ends = np.cumsum(length)
    of_row = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
    start = ends - length - of_row[row]  # where each chunk begins in its text
    stream = mix(keys.astype(np.uint64) ^ mix(np.array([seed], np.uint64)))[row]

    def draws(chunk: np.ndarray, node_end: np.ndarray) -> np.ndarray:
        place = (start[chunk] + node_end).astype(np.uint64)
        return mix(stream[chunk] + place * _BASE) >> np.uint64(64 - _ODDS)

    steps = []
    with np.errstate(over="ignore"):
        where = np.flatnonzero(length <= _LONG)
        number = held.numbers([flat[i] for i in where.tolist()])
        base, node_end = held.base[number], length[where]
        while len(where):
            u = draws(where, node_end)
            edge = held.first[base + node_end - 1]
            past = np.flatnonzero(held.upto[edge] <= u)
            while len(past):
                edge[past] += 1
                past = past[held.upto[edge[past]] <= u[past]]
            steps.append((where, held.piece[edge], node_end))
            node_end = node_end - held.back[edge]
            going = node_end > 0
            where, node_end, base = where[going], node_end[going], base[going]
        long = np.flatnonzero(length > _LONG).tolist()
        each = [
            held.drawn(flat[i], draws(np.full(length[i], i), np.arange(1, length[i] + 1))) for i in long
        ]
    taken = np.zeros(len(flat), np.int64)
    for w, _, _ in steps:
        taken[w] += 1
    taken[long] = [len(pieces) for pieces, _ in each]
    last = np.cumsum(taken)
    ids, ends_at = np.empty(int(last[-1]), np.int32), np.empty(int(last[-1]), np.int64)
    for i, (w, piece, end) in enumerate(steps):
        ids[last[w] - 1 - i] = piece
        ends_at[last[w] - 1 - i] = end
    for w, (pieces, places) in zip(long, each, strict=True):
        ids[last[w] - len(pieces) : last[w]] = pieces[::-1]
        ends_at[last[w] - len(pieces) : last[w]] = places[::-1]
    sizes = np.bincount(row, taken, len(texts)).astype(np.int64)
    spelt = np.flatnonzero(ids < 0)
    if len(spelt):
        of_chunk = np.searchsorted(last, spelt, side="right")
        spelling = [
            [words.byte_id[b] for b in flat[c][e - 1].translate(_UNMARKED).encode("utf-8", "surrogatepass")]
            for c, e in zip(of_chunk.tolist(), ends_at[spelt].tolist(), strict=True)
        ]
        extra = np.array([len(s) - 1 for s in spelling])
        sizes += np.bincount(row[of_chunk], extra, len(texts)).astype(np.int64)
        repeats = np.ones(len(ids), np.int64)
        repeats[spelt] += extra
        ids = np.repeat(ids, repeats)
        ids[np.flatnonzero(ids < 0)] = [b for s in spelling for b in s]
    return np.concatenate([[0], np.cumsum(sizes)]), ids


#: A text's own mark stands aside while blanks are marks. No UTF-8 text holds a lone surrogate.
_ASIDE = "\ud800"
_UNMARKED = str.maketrans({_ASIDE: MARK})


def _marked(text: str) -> str:
    return text.replace(MARK, _ASIDE).replace(" ", MARK)


def encoded(
    text: Column,
    key: Column,
    model_path: str,
    seed: int = 0,
    sharpness: float = 1.0,
) -> Column:
    """(ids, lossless): sampled piece ids of the text (null: null, empty: none) under the row's
    key, and whether decoding them has given back the text (null: true).

    Rows of equal key and text get equal pieces. A null key is a key like any other. Texts are
    handled some 260,000 bytes at a time, or one by one if longer.
    """

    @F.arrow_udf("struct<ids:array<int>,lossless:boolean>")
    def encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        # Kept for one task, as a worker that waits for the next should hold no memory.
        held = Lattices(vocabulary(model_path, sharpness))
        for texts, keys in batches:
            numbers = np.array(keys.to_pylist(), np.int64).astype(np.uint64)
            # A portion is handed on before the next is taken, so no batch's ids are held together.
            for a, values in text_portions(texts, _PORTION):
                yield _portion(texts[a : a + len(values)], values, numbers[a : a + len(values)], held, seed)

    return encode(text, F.xxhash64(key))


def _portion(
    texts: pa.Array, values: list[bytes | None], keys: np.ndarray, held: Lattices, seed: int
) -> pa.Array:
    """(ids, lossless) of the texts, whose bytes are `values`."""
    part = [(v or b"").decode("utf-8", "surrogatepass") for v in values]
    offsets, ids = sample(part, keys, held, seed)
    same = [x == y for x, y in zip(spelt_texts(offsets, ids, held.words), part, strict=True)]
    lists = pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=texts.is_null()
    )
    return pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], ["ids", "lossless"])


def spelt_texts(offsets: np.ndarray, ids: np.ndarray, words: Vocabulary) -> list[str]:
    """The texts that runs of ids spell."""
    spelling, ends = words.bytes_of, offsets.tolist()
    data = [spelling[i] for i in ids.tolist()]
    return [b"".join(data[a:b]).decode("utf-8", "surrogatepass") for a, b in zip(ends, ends[1:])]


def decoded(ids: Column, model_path: str) -> Column:
    """The text that piece ids spell; null for null ids."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = vocabulary(model_path, 1.0)
        for lists in batches:
            sizes = [len(x.values or ()) for x in lists]
            offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            found = spelt_texts(offsets, lists.flatten().to_numpy(), words)
            nulls = lists.is_null().to_pylist()
            yield pa.array([None if null else t for t, null in zip(found, nulls)], pa.string())

    return decode(ids)
