"""Encoding of a whole corpus with a byte-level BPE vocabulary (problem 8).

Everything is done on whole Arrow batches with numpy; no Python code runs per
row or per character.

1. The UTF-8 buffer of a batch is cut into pieces by character class, as the
   published pattern of the vocabulary does
   (``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``).
2. Equal pieces are found by a 64-bit content hash, then compared byte for byte
   with the first piece of that hash; pieces that differ are encoded on their own.
3. The distinct pieces of one length class are merged side by side. Each piece
   has a segment tree over its adjacent pairs whose leaves hold
   ``rank * width + position``; the root therefore names the leftmost pair of
   lowest rank. A merge changes three leaves and their paths to the root.
   The rounds end when no root holds a mergeable pair.

Defined results: a null or empty text gives an empty list; strings that look like
special tokens are ordinary text; very long pieces go through the same tree.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: Code points with the Unicode property White_Space (fixed values).
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]

#: Bytes of text worked on at once; bounds the memory of a Python worker.
CHUNK_BYTES = 2_000_000

EMPTY = np.int64(1 << 62)
_NO_KEY = np.uint32(0xFFFFFFFF)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def default_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed package of public tokenizers keeps the file ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space, other."""
    table = np.zeros(0x110000, np.uint8)
    try:  # its Unicode tables are as new as those of the public encoders
        import regex

        every = "".join(map(chr, range(0x110000)))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            for m in regex.finditer(pattern, every):
                table[m.start() : m.end()] = kind
    except ImportError:
        known = {"L": LETTER, "N": NUMBER}
        table[:] = np.fromiter((known.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


def _byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Merge tables of one vocabulary file; their size is that of the vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        if max(vocab.values(), default=0) >= 1 << 16:
            raise ValueError("pairs of ids are packed in 16 bits each; this vocabulary is larger")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.byte_id = np.zeros(256, np.int32)
        for ch, b in _byte_alphabet().items():
            self.byte_id[b] = vocab[ch]
        left = np.array([vocab[a] for a, _ in merges], np.uint32)
        right = np.array([vocab[b] for _, b in merges], np.uint32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self._fill_slots(left << np.uint32(16) | right)

    def _fill_slots(self, keys: np.ndarray) -> None:
        self.bits = 20
        size = 1 << self.bits
        self.slot_key = np.full(size, _NO_KEY, np.uint32)
        self.slot_rank = np.zeros(size, np.int32)
        todo, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            self.probes += 1
            free = self.slot_key[slot] == _NO_KEY
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            self.slot_key[slot[first]] = keys[todo[first]]
            self.slot_rank[slot[first]] = todo[first]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, slot = todo[rest], (slot[rest] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where it does not merge."""
        keys = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        slot = self._slot(keys)
        found = self.slot_key[slot]
        out = np.where(found == keys, self.slot_rank[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found != _NO_KEY))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_rank[slot[open_[hit]]]
            open_ = open_[~hit & (found != _NO_KEY)]
        return out

    def merge(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces ``data[start:start+length]``: flat ids and their number for each piece."""
        count = np.ones(len(start), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        done = np.flatnonzero(length == 1)
        parts.append((done, np.ones(len(done), np.int64), self.byte_id[data[start[done]]]))
        width = 2
        longest = int(length.max(initial=1))
        while width // 2 < longest:
            own = np.flatnonzero((length > width // 2) & (length <= width))
            step = max(1, 1_500_000 // width)
            for k in range(0, len(own), step):
                ids = own[k : k + step]
                n, flat = self._merge_class(data, start[ids], length[ids], width)
                parts.append((ids, n, flat))
            width *= 2
        for ids, n, _ in parts:
            count[ids] = n
        offset = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(offset[-1], np.int32)
        for ids, n, flat in parts:
            out[_spread(offset[ids], n)] = flat
        return out, count

    def _merge_class(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Segment trees of all pieces of one class, worked on side by side. Positions are numbered over the whole class."""
        words, shift = len(start), width.bit_length() - 1
        col = np.arange(width)
        inside = col[None, :] < length[:, None]
        sym = np.zeros((words, width), np.int32)
        sym[inside] = self.byte_id[data[_spread(start, length)]]
        sym = sym.ravel()
        last = np.arange(words) * width + length  # one past the end of each piece
        at = np.arange(words * width)
        nxt, prv = at + 1, at - 1
        has = np.zeros((words, width), bool)
        has[:, :-1] = inside[:, 1:]
        leaf = np.full(words * width, EMPTY, np.int64)
        i = np.flatnonzero(has.ravel())
        r = self.rank(sym[i], sym[i + 1])
        ok = r >= 0
        i, r = i[ok], r[ok].astype(np.int64)
        leaf[i] = r << shift | (i & (width - 1))
        tree = np.full((words, 2 * width), EMPTY, np.int64)
        tree[:, width:] = leaf.reshape(words, width)
        size = width
        while size > 1:
            size //= 2
            np.minimum(tree[:, 2 * size : 4 * size : 2], tree[:, 2 * size + 1 : 4 * size : 2], out=tree[:, size : 2 * size])
        flat = tree.ravel()
        alive = inside.ravel().copy()
        live = np.flatnonzero(tree[:, 1] < EMPTY)
        while len(live):
            root = flat[live * (2 * width) + 1]
            going = root < EMPTY
            live, root = live[going], root[going]
            if not len(live):
                break
            base, top, end = live * width, live * (2 * width), last[live]
            i = base + (root & (width - 1))
            j = nxt[i]
            k = nxt[j]
            sym[i] = self.merged[root >> shift]
            alive[j] = False
            nxt[i] = k
            inner = k < end
            prv[k[inner]] = i[inner]
            h = prv[i]
            before = h >= base
            self._set(flat, top, base, j, np.full(len(j), EMPTY), width)
            right = np.full(len(i), -1, np.int64)
            right[inner] = self.rank(sym[i[inner]], sym[k[inner]])
            self._set(flat, top, base, i, np.where(right >= 0, right << shift | (i - base), EMPTY), width)
            if before.any():
                hb, ib = h[before], i[before]
                left = self.rank(sym[hb], sym[ib]).astype(np.int64)
                self._set(flat, top[before], base[before], hb, np.where(left >= 0, left << shift | (hb - base[before]), EMPTY), width)
        return alive.reshape(words, width).sum(1), sym[alive]

    @staticmethod
    def _set(flat: np.ndarray, top: np.ndarray, base: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
        """Point update of one leaf in each tree."""
        node = at - base + width
        flat[top + node] = value
        while width > 1:
            width //= 2
            node = node >> 1
            child = top + 2 * node
            flat[top + node] = np.minimum(flat[child], flat[child + 1])

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end in ``data``; ``ends`` has the byte after each. Flat ids and their number for each text."""
        texts = len(ends)
        if not len(data):
            return np.empty(0, np.int32), np.zeros(texts, np.int64)
        start = piece_starts(data, ends)
        length = np.diff(np.append(start, len(data)))
        code, first = distinct_pieces(data, start, length)
        ids, count = self.merge(data, start[first], length[first])
        offset = np.concatenate([[0], np.cumsum(count)])
        n = count[code]
        flat = ids[_spread(offset[code], n)]
        per_text = np.searchsorted(start, ends, side="left")  # pieces before the end of each text
        total = np.concatenate([[0], np.cumsum(n)])
        return flat, np.diff(total[np.concatenate([[0], per_text])])


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start[0], start[0]+1, ... (n[0] of them), start[1], ..."""
    total = int(n.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = start - np.concatenate([[0], np.cumsum(n)[:-1]])
    return np.repeat(shift, n) + np.arange(total)


def piece_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Byte positions at which the pieces of all texts start."""
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    byte_at = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(cp)
    cls = char_classes()[cp]
    new_text = np.zeros(n + 1, bool)
    new_text[0] = new_text[n] = True
    new_text[np.searchsorted(byte_at, ends)] = True
    differs = np.empty(n, bool)
    differs[0] = True
    np.not_equal(cls[1:], cls[:-1], out=differs[1:])
    differs |= new_text[:-1]
    space = cls == SPACE
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (cp[:-1] == 32) & ~new_text[1:-1]
    starts = differs & (space | ~blank_before)
    starts[:-1] |= space[:-1] & ~space[1:] & ~new_text[1:-1]
    for quote in _contractions(cp, starts, new_text):
        at, size = quote
        starts[at + 1] = False
        nxt = at + size
        nxt = nxt[nxt < n]
        starts[nxt] = True
    return byte_at[starts]


def _contractions(cp: np.ndarray, starts: np.ndarray, new_text: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Positions of apostrophes that begin a contraction, with its length."""
    n = len(cp)
    at = np.flatnonzero(starts & (cp == 39))
    at = at[at + 1 < n]
    at = at[~new_text[at + 1]]
    one = np.isin(cp[at + 1], [ord(c) for c in "stmd"])
    yield at[one], 2
    at = at[~one]
    at = at[at + 2 < n]
    at = at[~new_text[at + 2]]
    a, b = cp[at + 1], cp[at + 2]
    two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    yield at[two], 3


@lru_cache(maxsize=1)
def _byte_weights() -> np.ndarray:
    return np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INV, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def distinct_pieces(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the number of its distinct form, and where each form stands first. Equal hashes are compared byte for byte."""
    room = 1 << int(len(data) + 1).bit_length()
    up, down = _powers(room)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_weights()[data] * up[: len(data)], out=total[1:])
    h = (total[start + length] - total[start]) * down[start] + length.astype(np.uint64)
    code, forms = pd.factorize(h)
    first = np.zeros(len(forms), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    same_length = length[first[code]] == length
    shift = np.where(same_length, start[first[code]] - start, 0)
    differs = data[np.repeat(shift, length) + np.arange(len(data))] != data
    bad = ~same_length
    if differs.any():
        bad |= np.add.reduceat(differs, start) > 0
    if bad.any():
        odd = np.flatnonzero(bad)
        code = code.copy()
        code[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate([first, odd])
    return code, first


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """The tables of a vocabulary file, read once in a worker."""
    return ByteBpe(path)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and end offsets of a string column; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def encode_column(bpe: ByteBpe, column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Encodes a column in chunks of whole texts: first row, row after the last, flat ids, ids per row."""
    data, ends = text_buffer(column)
    row, byte = 0, 0
    while row < len(ends):
        upto = max(row + 1, int(np.searchsorted(ends, byte + chunk_bytes, side="right")))
        part = data[byte : ends[upto - 1]]
        flat, n = bpe.encode(part, ends[row:upto] - byte)
        yield row, upto, flat, n
        row, byte = upto, int(ends[upto - 1])


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and ``ids`` of each row of ``docs``. Narrow: one scan of two columns, no shuffle.

    Null and empty texts give an empty list, a null key stays null, repeated rows are encoded each on
    their own, an empty table gives an empty result. Other columns of ``docs`` are never read.
    """
    where = path or default_path()
    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = slim.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(where)
        for batch in batches:
            for a, b, flat, n in encode_column(bpe, batch.column(1)):
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], ["k", "ids"])

    return slim.mapInArrow(run, f"k {kind}, ids array<int>").select(F.col("k").alias(key), "ids")


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and ``n_tokens`` of each row; as :func:`encode`, but the ids never leave the worker."""
    where = path or default_path()
    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = slim.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(where)
        for batch in batches:
            for a, b, _, n in encode_column(bpe, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n)], ["k", "n_tokens"])

    return slim.mapInArrow(run, f"k {kind}, n_tokens bigint").select(F.col("k").alias(key), "n_tokens")
