"""Long exact spans shared between records (problem 10).

A run of at least ``least`` code points of a record is shared if it stands verbatim in
another record; it is enough to know, for each window of exactly ``least`` code points,
whether two different records hold it, since every shared run is a union of such windows.

Recompression finds the windows worth comparing:

* Two rounds rename the text: a run of two equal tokens gets a name, then every pair whose
  first token's name hashes to *left* and whose second hashes to *right* gets one. A name is a
  64-bit hash of what it stands for. So naming is global without an exchange per round: equal
  things have equal names in all tasks. (Longer runs stay as they are: their name would depend on how far they go
  on outside the window, and the window would no longer decide its own symbols.)
* Each step can disturb only the outermost token at either side of a shared run, of a length
  known in advance. With these rounds at most ``LOSS`` code points at either side of a window
  are named differently in two records; all tokens between are the same in both. A third round would disturb
  more than the windows can spare.
* A phrase, the tokens that start within ``reach`` code points, is the high-level symbol. Of
  the phrases that start in the undisturbed part of a window, the one of least name stands for
  the window. It depends on the window's text alone, so two equal windows have the same one.

Spark groups these symbols by name (one for about 33 code points of text). Windows whose symbol
two records share are candidates. Consecutive windows with one symbol, a stretch, travel as one piece of
text and are compared code point by code point: a hash only says which windows to lay side by side. Nothing is
paired: a group of equal windows is reduced to its least and greatest record.

Skew: within a chunk of some megabytes equal symbols and equal stretches are sent
once, and the records of the chunk that hold them are marked at once. A stretch that repeats within one record goes
with all its positions, as another chunk may hold it too. A boilerplate that a third of
all records carry therefore costs one row for each chunk, not for each record. A symbol in more than ``HOT`` such rows (a short
heading before ever different text) is split: its windows travel one by one, each keyed by its own text. A group is
compared block by block, and what is kept between blocks is one piece for each different text.

Defined results: null, empty and short texts and rows with a null key give no row; repeated rows of
a key are one record, so a key shares nothing with itself; code points are compared as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairolog.llm.byte_bpe import _spread, text_buffer

LEAST = 160
#: Code points at either side of a window that the rounds may name differently: 2 by runs and 2 and 4 by pairs.
LOSS = 8
#: Longest token after the rounds.
TOKEN = 8
#: Rows of a symbol from which on its windows travel one by one.
HOT = 20_000
CHUNK_BYTES = 2_000_000

_B = np.uint64(0xD1342543DE82EF95)
_B_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base of the text hashes and of its inverse, made longer when needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            room = 1 << n.bit_length()
            cls.up, cls.down = np.full(room, _B, np.uint64), np.full(room, _B_INV, np.uint64)
            cls.up[0] = cls.down[0] = 1
            cls.up, cls.down = np.multiply.accumulate(cls.up), np.multiply.accumulate(cls.down)
        return cls.up, cls.down


def prefix_sums(names: np.ndarray) -> np.ndarray:
    up, _ = Powers.upto(len(names) + 1)
    out = np.zeros(len(names) + 1, np.uint64)
    np.cumsum(names * up[: len(names)], out=out[1:])
    return out


def _join(names: np.ndarray, fresh: np.ndarray, pos: np.ndarray, first: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens ``first`` and those after them become one token each."""
    names[first] = mix(names[first] * np.uint64(3) + names[first + 1] + np.uint64(salt))
    keep = np.ones(len(names), bool)
    keep[first + 1] = False
    return names[keep], fresh[keep], pos[keep]


def recompress(chars: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and start positions of the tokens after both rounds; ``fresh`` marks the first code point of each text."""
    names, pos = chars.copy(), np.arange(len(chars))
    same = names[1:] == names[:-1]
    same &= ~fresh[1:]
    i = np.flatnonzero(same)
    if len(i):
        lone = np.ones(len(i), bool)  # the run has two tokens, no more
        lone[1:] &= i[1:] != i[:-1] + 1
        lone[:-1] &= i[:-1] + 1 != i[1:]
        names, fresh, pos = _join(names, fresh, pos, i[lone], 11)
    for salt in (21, 22):
        right = ((names * np.uint64(2 * salt + 1)) >> np.uint64(47)).astype(np.uint8) & 1 == 1
        pair = ~right[:-1] & right[1:] & ~fresh[1:]
        names, fresh, pos = _join(names, fresh, pos, np.flatnonzero(pair), salt)
    return names, pos


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i:i+width] for each i that has so many; blocks of ``width`` with running minima from either side."""
    n = len(x)
    if n < width:
        return np.empty(0, x.dtype)
    pad = -n % width
    blocks = np.concatenate([x, np.full(pad, _MOST, x.dtype)]).reshape(-1, width)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], fore[width - 1 : n])


def reach(least: int) -> tuple[int, int]:
    """The stretch in which a phrase's tokens start, and the number of positions at which the phrase of a window may start."""
    long = least * 9 // 20
    starts = least - 2 * LOSS - long - TOKEN + 1
    if starts < 2:
        raise ValueError(f"spans of {least} code points are too short to have a symbol of their own; 48 is the least")
    return long, starts


def code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)


class Chunk:
    """Texts laid end to end: for each window of ``least`` code points within a text the name of its symbol."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, least: int = LEAST):
        long, starts = reach(least)
        self.least, self.data = least, data
        self.cp = cp = code_points(data)
        self.byte_at = byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        self.ends = np.searchsorted(byte_at[:-1], ends)
        self.begins = np.concatenate([[0], self.ends[:-1]])
        self.chars = mix(cp.astype(np.uint64) + np.uint64(1))
        fresh = np.zeros(len(cp) + 1, bool)
        fresh[self.begins] = True
        names, pos = recompress(self.chars, fresh[:-1])
        started = np.zeros(len(cp) + long + 1, np.int32)
        started[pos + 1] = 1
        np.cumsum(started, out=started)  # tokens that start before each position
        sums = prefix_sums(names)
        _, down = Powers.upto(len(names) + 1)
        phrase = mix((sums[started[pos + long]] - sums[:-1]) * down[: len(names)])
        value = np.full(len(cp), _MOST, np.uint64)
        value[pos] = phrase
        smallest = sliding_min(value, starts)
        size = np.maximum(self.ends - self.begins - least + 1, 0)
        self.text = np.repeat(np.arange(len(ends)), size)  # of each window
        self.at = np.arange(len(self.text)) + np.repeat(self.begins - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        self.symbol = smallest[self.at + LOSS] if len(self.at) else np.empty(0, np.uint64)

    def stretches(self) -> np.ndarray:
        """Windows at which a stretch with one symbol begins."""
        if not len(self.at):
            return np.empty(0, np.int64)
        new = np.ones(len(self.at), bool)
        new[1:] = (self.symbol[1:] != self.symbol[:-1]) | (self.text[1:] != self.text[:-1])
        return np.flatnonzero(new)

    def hashes(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hash of the ``size`` code points from each position."""
        if not hasattr(self, "sums"):
            self.sums = prefix_sums(self.chars)
        _, down = Powers.upto(len(self.chars) + 1)
        return mix((self.sums[at + size] - self.sums[at]) * down[at])

    def strings(self, at: np.ndarray, size: np.ndarray) -> pa.Array:
        """The ``size`` code points from each position as strings."""
        first = self.byte_at[at]
        n = self.byte_at[at + size] - first
        flat = self.data[_spread(first, n)]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes()))


def differ(cp: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` code points from ``a`` and those from ``b`` differ; no size is 0."""
    other = cp[_spread(a, size)] != cp[_spread(b, size)]
    return np.logical_or.reduceat(other, np.concatenate([[0], np.cumsum(size)[:-1]])) if len(size) else np.empty(0, bool)


def chunks(column: pa.Array, least: int = LEAST) -> Iterator[tuple[int, Chunk]]:
    """Whole texts of a column, some megabytes at once, with the row of the first."""
    data, ends = text_buffer(column)
    row, byte = 0, 0
    while row < len(ends):
        upto = max(row + 1, int(np.searchsorted(ends, byte + CHUNK_BYTES, side="right")))
        yield row, Chunk(data[byte : ends[upto - 1]], ends[row:upto] - byte, least)
        row, byte = upto, int(ends[upto - 1])


def _lists(order: np.ndarray, bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values[order]))


def symbols(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``name, doc, more``: each symbol of a chunk once, with its first record and, if it has several, all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, chunk in chunks(batch.column(1), least):
                s = chunk.stretches()
                own = pd.DataFrame({"name": chunk.symbol[s].view(np.int64), "doc": ids[row + chunk.text[s]]}).drop_duplicates()
                several = own.duplicated("name", keep=False).to_numpy()
                lone = own[~several]
                yield pa.RecordBatch.from_arrays([pa.array(lone.name.to_numpy()), pa.array(lone.doc.to_numpy()), pa.nulls(len(lone), pa.list_(pa.int64()))], ["name", "doc", "more"])
                if several.any():
                    many = own[several].sort_values("name", kind="stable")
                    at = np.flatnonzero(~many.duplicated("name").to_numpy())
                    more = _lists(np.arange(len(many)), np.append(at, len(many)), many.doc.to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(many.name.to_numpy()[at]), pa.array(many.doc.to_numpy()[at]), more], ["name", "doc", "more"])

    return docs.mapInArrow(run, "name bigint, doc bigint, more array<bigint>")


SENT = "name bigint, doc bigint, other bigint, at int, more array<int>, n int, piece string"


def _rows(name: np.ndarray, doc: np.ndarray, other: np.ndarray, at: np.ndarray, more: pa.Array | None, n: np.ndarray, piece: pa.Array | None) -> pa.RecordBatch:
    more = pa.nulls(len(name), pa.list_(pa.int32())) if more is None else more
    piece = pa.nulls(len(name), pa.string()) if piece is None else piece
    return pa.RecordBatch.from_arrays([pa.array(name), pa.array(doc), pa.array(other), pa.array(at.astype(np.int32)), more, pa.array(n.astype(np.int32)), piece], ["name", "doc", "other", "at", "more", "n", "piece"])


def windows(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Windows of the texts (``doc, t``) whose symbol is in ``names``, as ``name, doc, other, at, more, n, piece``: n windows from position ``at``, and their text.

    A stretch that several records of a chunk hold is sent once, with one of them and another (``doc``, ``other``);
    for each of these records a row without text says that it is shared. A stretch that one record of a chunk holds
    several times is sent once, with its further positions (``more``). Stretches whose symbol is in ``hot`` are sent window by window.
    """

    def listed(lists: pa.Array, row: int, chunk: Chunk, s: np.ndarray) -> np.ndarray:
        part = lists.slice(row, len(chunk.ends))
        owner = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        wanted = mix(part.flatten().to_numpy(zero_copy_only=False).view(np.uint64) + owner.astype(np.uint64) * _B)
        return np.isin(mix(chunk.symbol[s] + chunk.text[s].astype(np.uint64) * _B), wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, chunk in chunks(batch.column(1), least):
                s = chunk.stretches()
                if not len(s):
                    continue
                n = np.diff(np.append(s, len(chunk.at)))
                held = listed(batch.column(2), row, chunk, s)
                s, n = s[held], n[held]
                if not len(s):
                    continue
                hot = listed(batch.column(3), row, chunk, s)
                name = chunk.symbol[s]
                if hot.any():  # each window for itself, under a name of its own
                    one = _spread(s[hot], n[hot])
                    fine = mix(chunk.hashes(chunk.at[one], least) ^ chunk.symbol[one])
                    s, n, name = np.concatenate([s[~hot], one]), np.concatenate([n[~hot], np.ones(len(one), n.dtype)]), np.concatenate([name[~hot], fine])
                start, size = chunk.at[s], n + least - 1
                doc = ids[row + chunk.text[s]]
                own = pd.DataFrame({"h": chunk.hashes(start, size), "n": n, "doc": doc})
                of = own.groupby(["h", "n"], sort=False).ngroup().to_numpy()  # numbered by their first row
                first = np.unique(of, return_index=True)[1][of]
                twin = np.flatnonzero(first != np.arange(len(of)))
                false = twin[differ(chunk.cp, start[twin], start[first[twin]], size[twin])]
                if len(false):  # equal hashes of different texts: each is on its own
                    of[false] = of.max() + 1 + np.arange(len(false))
                    of = np.unique(of, return_inverse=True)[1]
                group = own.groupby(of, sort=False).doc
                lo, hi = group.transform("min").to_numpy(), group.transform("max").to_numpy()
                sent = np.sort(np.unique(of, return_index=True)[1])
                again = lo == hi
                again[sent] = False
                again = np.flatnonzero(again)
                rank = np.empty(len(sent), np.int64)
                rank[of[sent]] = np.arange(len(sent))
                again = again[np.argsort(rank[of[again]], kind="stable")]
                each = np.bincount(rank[of[again]], minlength=len(sent))
                at = start - chunk.begins[chunk.text[s]]
                more = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32)), pa.array(at[again].astype(np.int32)), mask=pa.array(each == 0))
                other = np.where(hi != doc, hi, lo)
                yield _rows(name[sent].view(np.int64), doc[sent], other[sent], at[sent], more, n[sent], chunk.strings(start[sent], size[sent]))
                shared = np.flatnonzero(lo != hi)
                if len(shared):
                    yield _rows(mix(doc[shared].astype(np.uint64)).view(np.int64), doc[shared], doc[shared], at[shared], None, n[shared], None)

    return docs.mapInArrow(run, SENT)


def shared_in(rows: pa.RecordBatch, least: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces of text (rows as of :func:`windows`, whole groups): row, first window and number of windows of each stretch that two records hold."""
    data, ends = text_buffer(rows.column(6))
    cp = code_points(data)
    ends = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), ends)
    begin = np.concatenate([[0], ends[:-1]])
    n = ends - begin - least + 1
    row = np.repeat(np.arange(len(n)), n)
    at = _spread(begin, n)
    sums = prefix_sums(mix(cp.astype(np.uint64) + np.uint64(1 + salt)))
    _, down = Powers.upto(len(cp) + 1)
    name = rows.column(0).to_numpy().view(np.uint64)
    key = mix((sums[at + least] - sums[at]) * down[at]) ^ mix(name)[row]
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    leader = order[np.flatnonzero(new)][group]  # the first window with this hash
    # Verbatim: a window next to one that equals the window before its leader needs its last code point compared, others all.
    follows = np.zeros(len(at), bool)
    follows[1:] = (row[1:] == row[:-1]) & (leader[1:] == leader[:-1] + 1) & (row[leader[1:]] == row[leader[:-1]])
    step = cp[at + least - 1] != cp[at[leader] + least - 1]
    full = np.flatnonzero(~follows & (leader != np.arange(len(at))))
    wrong = bool(step.any()) or bool((name[row] != name[row[leader]]).any()) or bool(differ(cp, at[full], at[leader[full]], np.full(len(full), least)).any())
    if wrong:  # two texts with one hash: the texts themselves are the keys
        seen: dict[tuple, int] = {}
        group = np.array([seen.setdefault((name[r], cp[a : a + least].tobytes()), len(seen)) for r, a in zip(row.tolist(), at.tolist(), strict=True)], np.int64)
    doc, other = (rows.column(i).to_numpy() for i in (1, 2))
    lo, hi = np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).max), np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).min)
    np.minimum.at(lo, group, np.minimum(doc, other)[row])
    np.maximum.at(hi, group, np.maximum(doc, other)[row])
    shared = (lo < hi)[group]
    edge = np.ones(len(at), bool)
    edge[1:] = (shared[1:] != shared[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(edge)
    size = np.diff(np.append(first, len(at)))
    kept = shared[first]
    return row[first[kept]], at[first[kept]] - begin[row[first[kept]]], size[kept]


def _one_per_text(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Pieces that several records hold become one; their records are known to share them by now. What one record alone holds stays."""
    d = rows.to_pandas()
    group = d.groupby("piece", sort=False)
    lo, hi = np.minimum(group.doc.transform("min"), group.other.transform("min")), np.maximum(group.doc.transform("max"), group.other.transform("max"))
    kept = np.flatnonzero((lo == hi) & ~d.duplicated(["piece", "doc", "at"]) | (lo != hi) & ~d.duplicated("piece"))
    out = rows.take(pa.array(kept))
    return pa.RecordBatch.from_arrays([out.column(0), pa.array(lo.to_numpy()[kept]), pa.array(hi.to_numpy()[kept]), *out.columns[3:]], rows.schema.names)


def compared(sent: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc, start, n``: n windows from position ``start`` that stand in another record too, from rows of :func:`windows` sorted by ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.RecordBatch | None = None  # pieces of the last group, which may go on
        for batch in batches:
            if not len(batch):
                continue
            known = batch.column(6).is_null()
            told, rows = batch.filter(known), batch.filter(pc.invert(known))
            if len(told):
                yield pa.RecordBatch.from_arrays([told.column(1), told.column(3), told.column(5)], ["doc", "start", "n"])
            if not len(rows):
                continue
            if open_ is not None and open_.column(0)[0] == rows.column(0)[0]:
                rows = pa.Table.from_batches([open_, rows]).combine_chunks().to_batches()[0]
            row, first, size = shared_in(rows, least)
            doc, other, at = (rows.column(i).to_numpy() for i in (1, 2, 3))
            own = doc[row] == other[row]  # else the chunk itself has told it
            row, first, size = row[own], first[own], size[own]
            more = rows.column(4).take(pa.array(row)).fill_null([])
            again = np.repeat(np.arange(len(row)), more.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            start = np.concatenate([at[row] + first, more.flatten().to_numpy(zero_copy_only=False) + first[again]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([doc[row], doc[row[again]]])), pa.array(start.astype(np.int32)), pa.array(np.concatenate([size, size[again]]).astype(np.int32))], ["doc", "start", "n"])
            names = rows.column(0).to_numpy()
            open_ = _one_per_text(rows.slice(int(np.flatnonzero(names == names[-1])[0])))

    return sent.mapInArrow(run, "doc bigint, start int, n int")


def shared_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``doc, start, n``: where n windows of ``least`` code points start that stand in another record too. Ranges may overlap."""
    slim = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("t")).where(F.col("doc").isNotNull() & (F.length("t") >= least))
    by_name = Window.partitionBy("name")
    seen = symbols(slim, least).select("name", "doc", "more", F.min("doc").over(by_name).alias("lo"), F.max("doc").over(by_name).alias("hi"), F.count("*").over(by_name).alias("rows"))
    found = seen.where(F.col("more").isNotNull() | (F.col("lo") < F.col("hi")))
    found = found.select("name", (F.col("rows") > HOT).alias("many"), F.explode(F.coalesce("more", F.array("doc"))).alias("doc"))
    names = found.groupBy("doc").agg(F.collect_set("name").alias("names"), F.collect_set(F.when(F.col("many"), F.col("name"))).alias("hot"))
    sent = windows(slim.join(names, "doc").select("doc", "t", "names", "hot"), least)
    return compared(sent.repartition("name").sortWithinPartitions("name"), least)


def shared_chars(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``key, shared_chars``: code points of each record that lie in shared runs, for records that have any."""
    ranges = shared_windows(docs, key, text, least).groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("ranges"))  # no more than the text has windows
    upto = lambda r: r["start"] + r["n"] + (least - 1)
    new = lambda have, r: F.struct((have["n"] + F.greatest(F.lit(0), upto(r) - F.greatest(r["start"], have["upto"]))).alias("n"), F.greatest(have["upto"], upto(r)).alias("upto"))
    covered = F.aggregate("ranges", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), new)
    return ranges.select(F.col("doc").alias(key), covered["n"].cast("bigint").alias("shared_chars"))
