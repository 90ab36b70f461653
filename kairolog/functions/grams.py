"""Bigram index and its ranking.

Text without spaces is cut into windows of two characters; a window's tokens are its letters and digits in lower case without
Latin, Greek and Cyrillic accents. The score of a record is BM25 with k1 = 1.2 and b = 0.75 over the tokens of the query.
Statistics are those of the whole corpus, also when a filter restricts what is ranked.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Postings of a source under one gram, and how many bytes of text and records are counted at once; a record's place among them takes 21 bits.
LISTS, RUN_BYTES, RUN_RECORDS, PLACE = "gram string, src string, line_no array<int>, tf array<int>, len array<int>", 2_000_000, 100_000, 21
#: Occurrences of a gram in a run of records: how many, in how many records, and the steps from each record's place to the next as numbers of 16 bits, 0 where
#: a record has another. A run has as many records as there are places in a bitmap of Spark's. ``ids`` are unpacked so many at once.
PACKED, RUN_BITS, UNPACK = "gram string, run bigint, tf bigint, df bigint, ids binary", 15, 1_000_000


@lru_cache(maxsize=1)
def accents() -> tuple[str, str]:
    """Accented letters of the three alphabets and their base letters, by the rule that the first code point of the decomposition is one of them."""
    pairs = []
    for c in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        parts = unicodedata.normalize("NFD", chr(c))
        if len(parts) > 1 and unicodedata.normalize("NFD", chr(c).lower()) == parts and len(chr(c).lower()) == 1:
            pairs.append((chr(c), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), r"[\s\p{Z}]", "")  # most are plain blanks, which need no pattern


def bigrams(text: Column) -> Column:
    """Windows of two characters; a text of one character is its own window."""
    s = squeeze(text)
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))
    return F.when(F.length(s) >= 1, many).otherwise(F.array().cast("array<string>"))


def fold(text: Column) -> Column:
    """Without spaces, in lower case, without accents; the table of accents is consulted only where a text has any other than ASCII."""
    s = F.lower(squeeze(text))
    return F.when(F.octet_length(s) == F.length(s), s).otherwise(F.translate(s, *accents()))


def condensed(text: Column) -> Column:
    """The folded text with one space for each run of other characters than letters and digits. What BM25 needs can be read off it:
    a window of two characters has one token if either is a letter or digit, so there are as many tokens as characters here, less one."""
    return F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " ")


def token_count(c: Column) -> Column:
    return F.when(F.length(c) > 1, F.length(c) - 1).otherwise((F.length(F.trim(c)) == 1).cast("int"))


def _occurrences(c: Column, piece: str) -> Column:
    if piece[0] == piece[-1]:
        return F.regexp_count(c, F.lit(f"{piece[0]}(?={piece[0]})"))
    return ((F.length(c) - F.length(F.replace(c, F.lit(piece), F.lit("")))) / 2).cast("int")


def times(c: Column, gram: str) -> Column:
    """How often a token stands in a condensed text: a pair of characters, or one with a space at either side."""
    if len(gram) == 2:
        return _occurrences(c, gram)
    return F.when(c == gram, 1).otherwise(_occurrences(c, f" {gram}") + _occurrences(c, f"{gram} "))


def holds(c: Column, gram: str) -> Column:
    return c.contains(gram) if len(gram) == 2 else (c == gram) | c.contains(f" {gram}") | c.contains(f"{gram} ")


def tokens(text: Column) -> Column:
    """Tokens of all windows of a text, in no set order: letters and digits with what follows, and those after another character."""
    c = condensed(text)
    first = F.regexp_extract_all(c, F.lit(r"(?=[^ ].)(?=([^ ]{1,2}))"), F.lit(1))
    second = F.regexp_extract_all(c, F.lit(r"(?<= )([^ ])"), F.lit(1))
    return F.when(F.length(c) > 1, F.concat(first, second)).otherwise(F.regexp_extract_all(c, F.lit("([^ ])"), F.lit(1)))


def query_tokens(text: str) -> list[str]:
    """The same for a query, in the driver; repeated tokens are kept."""
    import re

    s = "".join(text.split())
    windows = [s[i : i + 2] for i in range(max(1, len(s) - 1))] if s else []
    fold = str.maketrans(*accents())
    return [t for w in windows for t in re.findall(r"[^\W_]+", w.lower().translate(fold))]


def postings(records: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``gram, keys, tf``: the inverted index. Counting within a record needs no exchange; a table of it belongs sorted by gram."""
    each = records.select(*keys, F.explode(tokens(F.col(text))).alias("gram"))
    return each.groupBy(*keys, "gram").agg(F.count("*").alias("tf"))


def write_index(records: DataFrame, path: str, keys: list[str], text: str = "text", files: int = 64) -> None:
    """Postings sorted by gram, so that a query reads the row groups of its grams, each with the length of its record, and one row about the whole corpus. A
    common gram is spread over several files."""
    length = token_count(condensed(F.col(text))).alias("len")
    measured = records.select(*keys, length, tokens(F.col(text)).alias("_t"))  # once for a record, not for each of its grams
    post = measured.select(*keys, "len", F.explode("_t").alias("gram")).groupBy(*keys, "len", "gram").agg(F.count("*").alias("tf"))
    post.repartitionByRange(files, "gram", F.xxhash64(*keys)).sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/postings")
    records.select(length).agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("mean")).write.mode("overwrite").parquet(f"{path}/corpus")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Stretches of the records, each as long as is counted at once, or one record if that is longer."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("c")), 0).to_numpy(zero_copy_only=False))
        row, byte = 0, 0
        while row < len(ends):
            fits = int(np.searchsorted(ends, byte + RUN_BYTES - size, side="right"))
            upto = max(row if held else row + 1, min(fits, row + RUN_RECORDS - sum(map(len, held))))
            if upto > row:
                held.append(batch.slice(row, upto - row))
                size, row, byte = size + int(ends[upto - 1]) - byte, upto, int(ends[upto - 1])
            if row < len(ends):
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _keys(texts: list[str], place: np.ndarray) -> np.ndarray:
    """Each occurrence of a token in condensed texts as gram and place of the text, in order. A pair of code points is a number, so one sort of these with the
    places counts all."""
    c = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)  # no line ends in condensed texts
    gap, blank = c == 10, c == 32
    at = np.append(place, 0)[np.cumsum(gap, dtype=np.int32) - 1]
    a, b = c[:-1], c[1:]
    key = np.where(blank[:-1], b, a).astype(np.int64)
    key <<= 21
    key |= np.where(blank[:-1] | blank[1:], np.uint32(0), b)
    key <<= PLACE
    key |= at[:-1]
    alone = np.flatnonzero(~gap[1:-1] & ~blank[1:-1] & gap[:-2] & gap[2:]) + 1
    key = np.concatenate([key[~(gap[:-1] | gap[1:])], c[alone].astype(np.int64) << 21 + PLACE | at[alone]])
    key.sort()
    return key


def _names(gram: np.ndarray) -> pa.Array:
    return pa.array([chr(g >> 21) + (chr(g & 0x1FFFFF) if g & 0x1FFFFF else "") for g in gram.tolist()], pa.string())


def _counted(run: pa.Table) -> pa.RecordBatch | None:
    """Posting lists of a run in order of their grams."""
    sources = run.column("src").combine_chunks().dictionary_encode()
    source, line = sources.indices.to_numpy(zero_copy_only=False), run.column("line_no").to_numpy()
    order = np.lexsort((line, source))
    texts = run.column("c").to_pylist()
    key = _keys([texts[i] or "" for i in order], np.arange(len(order)))
    if not len(key):
        return None
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    tf = np.diff(np.append(first, len(key)))
    gram, at = key[first] >> PLACE, order[key[first] & (1 << PLACE) - 1]
    other = np.append(True, gram[1:] != gram[:-1])
    start = np.flatnonzero(other | np.append(True, source[at][1:] != source[at][:-1]))
    names = _names(gram[other])
    length = pc.fill_null(run.column("len"), 0).to_numpy()
    bounds = pa.array(np.append(start, len(at)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (line[at], tf, length[at])]
    return pa.RecordBatch.from_arrays([names.take(pa.array((np.cumsum(other) - 1)[start])), sources.dictionary.take(pa.array(source[at[start]])), *lists], ["gram", "src", "line_no", "tf", "len"])


def posting_lists(measured: DataFrame) -> DataFrame:
    """The postings of records ``src, line_no, len, c``, of which each is there once and ``c`` is the condensed text: a row for a gram and what a task holds of a
    source, so records of a source belong together. Rows come in runs sorted by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches):
            if (out := _counted(part)) is not None:
                yield out

    return measured.select("src", "line_no", "len", "c").mapInArrow(run, LISTS)


def _packed(names: pa.Array, run: pa.Array, first: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Rows of occurrences: ``first`` says where among the places those of each row begin."""
    step = np.diff(place.astype(np.uint16), prepend=np.uint16(0))
    step[first] = place[first]
    again = step == 0
    again[first] = False
    tf = np.diff(np.append(first, len(place)))
    df = tf - np.add.reduceat(again, first, dtype=np.int64)
    ids = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(first, len(place)).astype(np.int32) * 2), pa.py_buffer(step)])
    return pa.RecordBatch.from_arrays([names, run, pa.array(tf), pa.array(df), ids], ["gram", "run", "tf", "df", "ids"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows at a time, with row and place of each occurrence in them."""
    ids = batch.column("ids").cast(pa.binary())
    ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64) // 2
    steps = np.frombuffer(ids.buffers()[2] or b"", np.uint16, ends[-1])
    row = 0
    while row < len(ids):
        upto = max(row + 1, int(np.searchsorted(ends, ends[row] + UNPACK, side="right")) - 1)
        total = np.cumsum(steps[ends[row] : ends[upto]], dtype=np.int64)
        n = np.diff(ends[row : upto + 1])
        before = np.append(0, total)[ends[row:upto] - ends[row]]
        yield batch.slice(row, upto - row), np.repeat(np.arange(upto - row), n), total - np.repeat(before, n)
        row = upto


def numbered(measured: DataFrame, segment: int) -> DataFrame:
    """Records with the ``run`` they belong to and their ``place`` in it, by where they are written. Segments share no runs."""
    i = F.col("_i")
    run = F.lit(segment << 54 - RUN_BITS).bitwiseOR(F.shiftright(i, RUN_BITS))
    return measured.withColumn("_i", F.monotonically_increasing_id()).withColumns({"run": run, "place": i.bitwiseAND((1 << RUN_BITS) - 1).cast("int")}).drop("_i")


def occurrences(measured: DataFrame) -> DataFrame:
    """``PACKED`` rows of records ``run, place, c``, of which each is there once and ``c`` is the condensed text. A gram has a row for each part of a run that is
    counted at once; rows come in parts sorted by gram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches):
            run, place, texts = part.column("run").to_numpy(), part.column("place").to_numpy(), part.column("c").to_pylist()
            bounds = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                key = _keys([t or "" for t in texts[lo:hi]], place[lo:hi])
                if len(key):
                    gram = key >> PLACE
                    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
                    yield _packed(_names(gram[first]), pa.array(np.full(len(first), run[lo])), first, key & (1 << PLACE) - 1)

    return measured.select("run", "place", "c").mapInArrow(count, PACKED)


def unpacked(rows: DataFrame) -> DataFrame:
    """``gram, run, place, tf`` of ``PACKED`` rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row, place in _unpacked(batch):
                first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0))
                at = pa.array(row[first])
                tf = np.diff(np.append(first, len(row)))
                yield pa.RecordBatch.from_arrays([part.column("gram").take(at), part.column("run").take(at), pa.array(place[first].astype(np.int32)), pa.array(tf)], ["gram", "run", "place", "tf"])

    return rows.select("gram", "run", "ids").mapInArrow(each, "gram string, run bigint, place int, tf bigint")


def living(rows: DataFrame, dead: DataFrame) -> DataFrame:
    """``PACKED`` rows without occurrences in the records ``run, place`` of ``dead``, which come as one bitmap a run."""
    bits = dead.groupBy("run").agg(F.bitmap_construct_agg(F.col("place").cast("bigint")).alias("ids"))
    both = rows.select("gram", "run", "ids").unionByName(bits.select(F.lit(None).cast("string").alias("gram"), "run", "ids"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lost, of = np.zeros(1 << RUN_BITS, bool), None
        for batch in batches:
            run = batch.column("run").to_numpy()
            bounds = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if lo < hi and of != run[lo]:
                    lost, of = np.zeros(1 << RUN_BITS, bool), run[lo]
                if lo < hi and not batch.column("gram")[lo].is_valid:  # sorts before the grams of its run
                    lost, lo = np.unpackbits(np.frombuffer(batch.column("ids")[lo].as_py(), np.uint8), bitorder="little").astype(bool), lo + 1
                for part, row, place in _unpacked(batch.slice(lo, hi - lo)) if lo < hi else ():
                    left = ~lost[place]
                    row, place = row[left], place[left]
                    if len(row):
                        first = np.flatnonzero(np.diff(row, prepend=-1) != 0)
                        at = pa.array(row[first])
                        yield _packed(part.column("gram").take(at), part.column("run").take(at), first, place)

    return both.repartition("run").sortWithinPartitions("run", "gram").mapInArrow(keep, PACKED)


def statistics(records: DataFrame, wanted: list[str], text: str = "text") -> DataFrame:
    """One row, computed with the query that uses it: ``n`` records, their ``mean`` length, and ``df`` of each distinct token in order."""
    held = [F.count_if(holds(F.col("c"), g)) for g in dict.fromkeys(wanted)]
    return records.select(condensed(F.col(text)).alias("c")).agg(F.count("*").alias("n"), F.coalesce(F.avg(token_count(F.col("c"))), F.lit(1.0)).alias("mean"), F.array(*held).alias("df"))


def bm25(records: DataFrame, groups: list[list[str]], stats: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
    """Records with a score. ``groups`` holds the tokens of each keyword: a record needs one of each group. A repeated token counts as often as it stands.
    ``stats`` is the row of :func:`statistics` for the same tokens in the same order."""
    flat = [t for g in groups for t in g]
    if not flat or not all(groups):
        return records.where(F.lit(False)).withColumn(out, F.lit(0.0))
    grams = list(dict.fromkeys(flat))
    # One expression, so that the text is condensed once for all tokens; a condition outside it would repeat that for each.
    counts = F.transform(F.array(condensed(F.col(text))), lambda c: F.struct(F.array(*[times(c, g) for g in grams]).alias("tf"), token_count(c).alias("n")))
    has = lambda f: reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (F.get(f["tf"], grams.index(t)) > 0 for t in dict.fromkeys(g))) for g in groups))
    kept = records.select("*", F.explode(F.filter(counts, has)).alias("_f"))
    kept = kept.crossJoin(F.broadcast(stats.select(F.col("n").alias("_n"), F.col("mean").alias("_mean"), F.col("df").alias("_df"))))  # one row

    def part(i: int, g: str) -> Column:
        df = F.get("_df", i)
        idf = F.ln((F.col("_n") - df + 0.5) / (df + 0.5))
        return F.array(float(flat.count(g)) * F.when(idf > 0, idf).otherwise(IDF_FLOOR) * (K1 + 1), F.get(F.col("_f.tf"), i).cast("double"))

    kept = kept.withColumns({"_tf": F.array(*[part(i, g) for i, g in enumerate(grams)]), "_norm": F.lit(K1 * (1 - B)) + F.lit(K1 * B) / F.col("_mean") * F.col("_f.n")}).drop("_f", "_n", "_mean", "_df")
    total = F.aggregate("_tf", F.lit(0.0), lambda s, x: s + x[0] * x[1] / (x[1] + F.col("_norm")))
    return kept.withColumn(out, total).select(*records.columns, out)


def bm25_postings(postings: DataFrame, corpus: DataFrame, groups: list[list[str]], keys: list[str]) -> DataFrame:
    """``keys, score`` of the records that hold a token of each group, from postings ``keys, gram, tf, len`` and the row ``n, mean``: postings of other grams are not read."""
    flat = [t for g in groups for t in g]
    wanted = postings.where(F.col("gram").isin(list(dict.fromkeys(flat)))) if flat and all(groups) else postings.where(F.lit(False))
    df = F.broadcast(wanted.groupBy("gram").agg(F.count("*").alias("df")))  # a row for each token of the query
    stats = F.broadcast(corpus.select("n", "mean"))  # one row
    weight = F.create_map(*[F.lit(x) for g in dict.fromkeys(flat) for x in (g, float(flat.count(g)))] or [F.lit(""), F.lit(0.0)])
    member = F.create_map(*[F.lit(x) for g in dict.fromkeys(flat) for x in (g, sum(1 << i for i, q in enumerate(groups) if g in q))] or [F.lit(""), F.lit(0)])
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    term = weight[F.col("gram")] * F.when(idf <= 0, IDF_FLOOR).otherwise(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    hits = wanted.join(df, "gram").join(stats)
    return hits.groupBy(*keys).agg(F.sum(term).alias("score"), F.bit_or(member[F.col("gram")]).alias("_m")).where(F.col("_m") == (1 << len(groups)) - 1).drop("_m")


def bm25_indexed(path: str, spark: SparkSession, groups: list[list[str]], keys: list[str]) -> DataFrame:
    """The same from an index of :func:`write_index`."""
    return bm25_postings(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/corpus"), groups, keys)
