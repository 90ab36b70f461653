"""One consistent form for text that looks the same but is stored in different characters (problem 2).

The code points of a whole Arrow batch are one numpy array. A lookup table says how many code points each becomes and
which (none for invisible ones, several for ligatures and composed letters); offsets of the expansion place them; marks
are put in canonical order and composed again, the first mark of all letters at once, then the second, and so on.

What becomes equal: full-width and half-width forms, composed and decomposed letters, invisible characters, kinds of
space, ligatures, letters of another script drawn alike. What stays different: case, accents, superscripts, fractions,
circled digits, Roman numerals, symbols. A joiner between pictographs is visible and stays. Letters drawn alike become
Latin, but Cyrillic in a word with a letter that only Cyrillic has, so ordinary Russian words stay as they are.

Defined results: null stays null, empty stays empty; the form of a form is itself; each row is on its own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairolog.llm.byte_bpe import _spread, text_buffer

#: Letters drawn alike, each with the Latin one (fixed values).
CYRILLIC = dict(zip("асԁеһіјорԛѕԝхуАВСЕԌНІЈКМОРԚЅТԜХУ", "acdehijopqswxyABCEGHIJKMOPQSTWXY", strict=True))
GREEK = dict(zip("οϲϳνΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ocjvABEZHIKMNOPTYXCJ", strict=True))
OTHERS = dict(zip("օՕ", "oO", strict=True))

#: Invisible characters besides those of category Cf, as ranges (fixed values).
INVISIBLE = [(0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF)]
#: Characters of category Cf that are drawn, or that change what is drawn in flags.
DRAWN = [(0x600, 0x605), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0xE0020, 0xE007F)]
#: Letters of two letters that are no ligatures by name.
DIGRAPHS = [*range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4)]
JOINER = 0x200D
CHUNK_BYTES = 2_000_000


def _in(c: int, ranges: list[tuple[int, int]]) -> bool:
    return any(a <= c <= b for a, b in ranges)


def _one(c: int) -> str:
    """What one code point becomes, before composition."""
    ch = chr(c)
    kind = unicodedata.category(ch)
    if c in (0x85, 0x2028, 0x2029):
        return "\n"
    if kind == "Zs" and c != 0x1680:
        return " "
    if _in(c, INVISIBLE) or (kind == "Cf" and not _in(c, DRAWN)) or (kind == "Cc" and c not in (9, 10)):
        return ""
    parts = unicodedata.decomposition(ch)
    if parts[:1] == "<":
        tag = parts.split(">")[0]
        whole = tag in ("<wide", "<narrow") or c in DIGRAPHS or "LIGATURE" in unicodedata.name(ch, "")
        return "".join(_one(int(x, 16)) for x in parts.split("> ")[1].split()) if whole else ch
    if parts:
        return "".join(_one(ord(x)) for x in unicodedata.normalize("NFD", ch))
    return CYRILLIC.get(ch) or GREEK.get(ch) or OTHERS.get(ch) or ch


@lru_cache(maxsize=1)
class Tables:
    """Lookup tables, made once in a worker from the Unicode database."""

    def __init__(self) -> None:
        n = 0x110000
        self.size = np.ones(n, np.uint8)
        self.start = np.arange(n, dtype=np.int64)
        flat = list(range(n))
        self.mark = np.zeros(n, np.uint8)
        pairs: dict[int, int] = {}
        self.cyrillic_only = np.zeros(n, bool)
        self.back = np.arange(n, dtype=np.uint32)
        for ch, latin in CYRILLIC.items():
            self.back[ord(latin)] = ord(ch)
        for c in range(n):
            if 0xAC00 <= c <= 0xD7A3 or 0xD800 <= c <= 0xDFFF or 0x4E00 <= c <= 0x9FFF or 0x20000 <= c <= 0x2A6DF or 0xE000 <= c <= 0xF8FF or c >= 0xE0200:
                continue
            ch = chr(c)
            self.mark[c] = unicodedata.combining(ch)
            new = _one(c)
            if new != ch:
                self.size[c], self.start[c] = len(new), len(flat)
                flat.extend(map(ord, new))
            parts = unicodedata.decomposition(ch)
            if parts and parts[0] != "<" and " " in parts and unicodedata.normalize("NFC", ch) == ch:
                a, b = (int(x, 16) for x in parts.split())
                pairs[a << 21 | b] = c
        # composition also from the Latin letters that look like a Cyrillic or Greek base
        self.flat = np.array(flat, np.uint32)
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_to = np.array([pairs[k] for k in sorted(pairs)], np.uint32)
        self.second = np.zeros(n, bool)
        self.second[self.pair_key & 0x1FFFFF] = True
        look = set(map(ord, CYRILLIC))
        for c in [*range(0x400, 0x530)]:
            if chr(c).isalpha() and c not in look and _one(c) == chr(c):
                self.cyrillic_only[c] = True
        self.letter = np.zeros(n, bool)
        for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250), *range(0x300, 0x370), *range(0x370, 0x530)]:
            self.letter[c] = chr(c).isalpha() or 0x300 <= c < 0x370


def _pictograph(cp: np.ndarray) -> np.ndarray:
    return (cp >= 0x1F000) & (cp < 0x20000) | (cp >= 0x2600) & (cp <= 0x27BF) | (cp >= 0x2B00) & (cp <= 0x2BFF) | (cp == 0xFE0F)


def _compose(cp: np.ndarray, text: np.ndarray, t: Tables) -> np.ndarray:
    """Composes marks; returns the code points with those that were absorbed set to 0xFFFFFFFF."""
    combining = t.mark[cp]
    marks = np.flatnonzero(combining > 0)
    if len(marks):  # canonical order within each run of marks
        new = np.ones(len(marks), bool)
        new[1:] = (marks[1:] != marks[:-1] + 1) | (text[marks[1:]] != text[marks[:-1]])
        run = np.cumsum(new)
        order = np.lexsort((np.arange(len(marks)), combining[marks], run))
        cp[marks] = cp[marks[order]]
        combining = t.mark[cp]
    joins = t.second[cp] & (combining == 0)
    follow = np.flatnonzero((combining > 0) | joins)
    follow = follow[follow > 0]
    if not len(follow):
        return cp
    starter = np.where((combining > 0) | joins, 0, np.arange(len(cp)))
    np.maximum.accumulate(starter, out=starter)
    base = starter[follow - 1]
    ok = (text[base] == text[follow]) & (combining[base] == 0)
    follow, base = follow[ok], base[ok]
    turn = follow - base
    highest = np.zeros(len(cp), np.int16)  # class of the last mark kept after a base; -1: blocked
    order = np.argsort(turn, kind="stable")
    follow, base, turn = follow[order], base[order], turn[order]
    edges = np.append(np.flatnonzero(np.append(True, turn[1:] != turn[:-1])), len(turn)) if len(turn) else np.zeros(1, np.int64)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):  # the first mark of all letters, then the second, ...
        f, b = follow[lo:hi], base[lo:hi]
        free = np.where(combining[f] > 0, (highest[b] >= 0) & (highest[b] < combining[f]), highest[b] == 0)
        key = cp[b].astype(np.int64) << 21 | cp[f]
        at = np.minimum(np.searchsorted(t.pair_key, key), len(t.pair_key) - 1)
        hit = free & (t.pair_key[at] == key)
        cp[b[hit]] = t.pair_to[at[hit]]
        kept = ~hit
        highest[b[kept]] = np.where(combining[f[kept]] > 0, np.maximum(highest[b[kept]], combining[f[kept]]), -1)
        cp[f[hit]] = 0xFFFFFFFF
    return cp


def _hangul(cp: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins conjoining jamo to syllables."""
    for first, last, step in (((0x1100, 0x1112), (0x1161, 0x1175), 0), ((0xAC00, 0xD7A3), (0x11A8, 0x11C2), 1)):
        b = (cp >= last[0]) & (cp <= last[1])
        if not b.any():
            continue
        i = np.flatnonzero(b)
        i = i[i > 0]
        a = cp[i - 1].astype(np.int64)
        ok = (a >= first[0]) & (a <= first[1]) & (text[i - 1] == text[i]) & ((a - 0xAC00) % 28 == 0 if step else True)
        i, a = i[ok], a[ok]
        cp[i - 1] = a + cp[i] - 0x11A7 if step else 0xAC00 + ((a - 0x1100) * 21 + cp[i] - 0x1161) * 28
        keep = np.ones(len(cp), bool)
        keep[i] = False
        cp, text = cp[keep], text[keep]
    return cp, text


def _restore_cyrillic(cp: np.ndarray, text: np.ndarray, t: Tables) -> None:
    only = t.cyrillic_only[cp]
    if not only.any():
        return
    letter = t.letter[cp]
    edge = np.ones(len(cp), bool)
    edge[1:] = (letter[1:] != letter[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(edge)
    russian = np.logical_or.reduceat(only, at)
    inside = np.repeat(russian, np.diff(np.append(at, len(cp)))) & letter
    cp[inside] = t.back[cp[inside]]


def canonical_chunk(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Canonical forms of texts laid end to end in ``data``."""
    t = Tables()
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    size = np.diff(np.concatenate([[0], np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), ends)]))
    text = np.repeat(np.arange(len(ends), dtype=np.int32), size)
    n, first = t.size[cp].astype(np.int64), t.start[cp]
    joiner = np.flatnonzero(cp == JOINER)
    joiner = joiner[(joiner > 0) & (joiner + 1 < len(cp))]
    joiner = joiner[_pictograph(cp[joiner - 1]) & _pictograph(cp[joiner + 1]) & (text[joiner - 1] == text[joiner + 1])]
    n[joiner], first[joiner] = 1, JOINER
    carriage = np.flatnonzero(cp == 13)
    if len(carriage):  # a lone carriage return ends a line, one before a line feed is invisible
        lone = carriage[(carriage + 1 == len(cp)) | (np.append(cp, 0)[carriage + 1] != 10)]
        n[lone], first[lone] = 1, 10
    text = np.repeat(text, n)
    cp = t.flat[_spread(first, n)]
    if len(cp):
        cp = _compose(cp, text, t)
        kept = cp != 0xFFFFFFFF
        cp, text = _hangul(cp[kept], text[kept])
        _restore_cyrillic(cp, text, t)
    width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    per_text = np.bincount(text, weights=width, minlength=len(ends)).astype(np.int64) if len(cp) else np.zeros(len(ends), np.int64)
    offsets = np.concatenate([[0], np.cumsum(per_text)])
    utf8 = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets.tobytes()), pa.py_buffer(utf8))


def canonical_column(column: pa.Array) -> pa.Array:
    """Canonical forms of a string column; nulls stay null."""
    data, ends = text_buffer(column)
    parts, row, byte = [], 0, 0
    while row < len(ends):
        upto = max(row + 1, int(np.searchsorted(ends, byte + CHUNK_BYTES, side="right")))
        parts.append(canonical_chunk(data[byte : ends[upto - 1]], ends[row:upto] - byte))
        row, byte = upto, int(ends[upto - 1])
    out = pa.chunked_array(parts, pa.large_string()).combine_chunks() if parts else pa.array([], pa.large_string())
    out = out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out
    if column.null_count:
        import pyarrow.compute as pc

        out = pc.if_else(pc.is_valid(column), out, pa.scalar(None, pa.large_string()))
    return out.cast(pa.string())


def canonicalize(rows: DataFrame, key: str, text: str = "text", out: str = "canonical") -> DataFrame:
    """``key``, ``text`` and its canonical form. Narrow: no shuffle."""
    slim = rows.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = slim.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), canonical_column(batch.column(1))], ["k", "t", "c"])

    return slim.mapInArrow(run, f"k {kind}, t string, c string").select(F.col("k").alias(key), F.col("t").alias(text), F.col("c").alias(out))


def _members(rows: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """``c, k, t``: class (digest of the form), key and digest of the stored text of the rows of mixed classes; ``n`` rows are in the class.

    Texts are told apart by 128-bit digests. Classes stored in one way alone, nearly all, drop out in an aggregation with map-side combine.
    """
    long = rows.where((F.length(text) >= least) & F.col(key).isNotNull())
    forms = canonicalize(long, key, text).select(F.col(key).alias("k"), F.unhex(F.md5(F.col("canonical").cast("binary"))).alias("c"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("t"))
    mixed = forms.groupBy("c").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("c", "n")
    return forms.join(mixed, "c").groupBy("c", "k", "t").agg(F.max("n").alias("n"))


def same_looking_pairs(rows: DataFrame, key: str = "rowid", text: str = "text", least: int = 20, per_group: int = 2_000) -> DataFrame:
    """``a, b``: keys of rows whose texts of at least ``least`` characters are stored differently but look the same, smaller key first.

    Each row of the join is a row of the result. One side of a class is spread over groups of about ``per_group`` rows and the other goes
    to each of them, so that no task makes all pairs of a large class.
    """
    members = _members(rows, key, text, least)
    groups = F.ceil(F.col("n") / per_group).cast("int")
    one = members.withColumn("g", F.pmod(F.xxhash64("k"), groups).cast("int"))
    other = members.select("c", F.col("k").alias("b"), F.col("t").alias("u"), F.explode(F.sequence(F.lit(0), groups - 1)).alias("g"))
    return one.join(other, ["c", "g"]).where((F.col("k") < F.col("b")) & (F.col("t") != F.col("u"))).select(F.col("k").alias("a"), "b").distinct()


def same_looking_classes(rows: DataFrame, key: str = "rowid", text: str = "text", least: int = 20) -> DataFrame:
    """``key, class, links``: the rows of :func:`same_looking_pairs` with the smallest key of their class and in how many pairs they are. As many rows as keys, however large a class is."""
    members = _members(rows, key, text, least)
    heads = members.groupBy("c").agg(F.min("k").alias("class"), F.count_distinct("k").alias("keys"))
    alike = members.groupBy("c", "t").agg(F.count_distinct("k").alias("alike"))
    return members.join(alike, ["c", "t"]).join(heads, "c").groupBy(F.col("k").alias(key), "class").agg((F.max("keys") - F.min("alike")).alias("links"))
