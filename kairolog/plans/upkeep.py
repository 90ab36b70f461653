"""Indexes of words and of meaning that follow the records, source by source.

Each pass that finds a change writes one segment: the new lines of sources that are new, grew, were rewritten or are damaged. Of a source that was rewritten,
is damaged or gone, rows of earlier segments no longer count; its name is noted with the number of the segment from which its rows do. Vectors look at
neighbours, so those of a source that grew are written anew as well. Segments are few, as the smallest neighbours are merged, and so are files, whatever the
number of sources. Records are numbered within their segment, and the occurrences of a gram are packed numbers of records, a row for a gram and some thousand
records; a record's source, line and length stand with its number in ``lengths``. What is known of the sources, with the name of all that belongs to it, is
published last, so a pass that dies leaves what readers see and is simply done again.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairolog.functions import grams, semantic
from kairolog.operators.manifest import Versions, compare, damaged, row_digest
from kairolog.session import cut

KEY = ["src", "line_no"]
#: Segments at most, sources whose earlier rows don't count before all is merged, and changed sources up to which their names go to all tasks.
SEGMENTS, DEAD, FEW = 8, 100_000, 200_000
KINDS = {"postings": grams.PACKED, "lengths": "line_no int, len int, src string, run bigint, place int", "vectors": "line_no int, embedding array<float>, src string"}


class Segment(NamedTuple):
    number: int
    folder: str
    records: int


class State(NamedTuple):
    """What the published version ``name`` consists of; ``dead`` is the number of names noted."""

    name: str
    number: int
    segments: list[Segment]
    dead: int


class Indexes:
    """Postings, vectors (if there is an embedder) and the manifest of both, in one folder."""

    def __init__(self, spark: SparkSession, root: str, embedder: semantic.Embedder | None = None):
        self.spark, self.root, self.embedder = spark, root.rstrip("/"), embedder
        self.manifest = Versions(spark, f"{self.root}/manifest")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _files(self, name: str) -> tuple[object, object]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _state(self) -> State:
        """The published state; folders of another layout count as none and are built anew."""
        name = self.manifest.current() or ""
        if not re.match(r"\d{8}p-", name):
            return State("", 0, [], 0)
        row = self.spark.read.parquet(self._path(f"state/{name}")).first()
        return State(name, int(name[:8]), [Segment(*s) for s in row.segments], row.dead)

    def _dead(self, kind: str, state: State, s: Segment) -> DataFrame | None:
        """``src`` of the sources whose rows in a segment no longer count."""
        if not state.dead or s is state.segments[-1]:
            return None
        dead = self.spark.read.parquet(self._path(f"dead/{state.name}")).where(F.col("before") > s.number)
        dead = (dead if kind == "vectors" else dead.where("not grown")).select("src")
        return F.broadcast(dead) if state.dead <= DEAD else dead  # names are few, else all is merged

    def _stored(self, kind: str, s: Segment) -> DataFrame:
        return self.spark.read.schema(KINDS[kind]).parquet(self._path(f"{kind}/{s.folder}"))

    def _rows(self, kind: str, state: State, segments: list[Segment]) -> DataFrame:
        """Rows of some segments, without those, or occurrences, that no longer count."""
        parts = []
        for s in segments:
            fs, path = self._files(f"{kind}/{s.folder}")
            if not fs.exists(path):  # vectors, where there was no embedder
                continue
            rows, dead = self._stored(kind, s), self._dead(kind, state, s)
            if dead is not None and kind == "postings":
                rows = grams.living(rows, self._stored("lengths", s).join(dead, "src", "left_semi"))
            elif dead is not None:
                rows = rows.join(dead, "src", "left_anti").select(*rows.columns)
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], KINDS[kind])

    def _read(self, kind: str) -> DataFrame:
        state = self._state()
        return self._rows(kind, state, state.segments)

    def _write(self, rows: DataFrame, kind: str, folder: str) -> None:
        out = rows.write.mode("overwrite")
        if kind == "postings":  # in pages of few rows, as a query wants few grams of each run
            out = out.option("compression", "zstd").option("parquet.page.row.count.limit", "32")
        out.parquet(self._path(f"{kind}/{folder}"))

    def postings(self, wanted: list[str] | None = None) -> DataFrame:
        """``gram, line_no, tf, len, src``: a term of a record, how often, and the record's length in terms; of all terms or of those wanted."""
        state = self._state()
        parts = [self._stored("postings", s) for s in state.segments] or [self.spark.createDataFrame([], KINDS["postings"])]
        packed = reduce(DataFrame.unionByName, parts)
        each = grams.unpacked(packed if wanted is None else packed.where(F.col("gram").isin(wanted)))
        live = self._rows("lengths", state, state.segments)  # those that no longer count find no record here
        return each.join(live.hint("shuffle_hash"), ["run", "place"]).select("gram", "line_no", "tf", "len", "src")

    def terms(self) -> DataFrame:
        """``gram, tf, df`` of every term, how often and in how many records it stands, summed run by run."""
        return self._read("postings").groupBy("gram").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))

    def lengths(self) -> DataFrame:
        """``src, line_no, len`` of every indexed record."""
        return self._read("lengths").select("line_no", "len", "src")

    def vectors(self) -> DataFrame:
        return self._read("vectors")

    def _known(self) -> DataFrame:
        known = self.manifest.read() if self._state().name else None
        return known if known is not None else self.spark.createDataFrame([], "src string, nlines bigint, sig bigint, last int")

    def changes(self, records: DataFrame) -> DataFrame:
        """``src, status, nlines, sig, from_line, last, repeated`` of every source: a damaged one counts as rewritten."""
        digests = records.select(*KEY, row_digest(F.col("line_no"), "ts_raw", "type", "text").alias("digest")).repartition("src")  # all that follows is by source
        known = self._known().withColumn("end", F.col("last") + 1).hint("shuffle_hash")
        found = compare(digests.groupBy(*KEY, "digest").agg(F.count("*").alias("copies")), known)
        bad = damaged(self.lengths().select(*KEY).repartition("src"), known.select("src", F.col("end").alias("nlines")).hint("shuffle_hash"))
        return found.join(bad.withColumn("_bad", F.lit(True)), "src", "left").withColumn("status", F.when(F.col("_bad") & (F.col("status") != "gone"), "rewritten").otherwise(F.col("status"))).drop("_bad")

    def _merged(self, state: State, folder: str) -> list[Segment]:
        """Segments to go on with: two small neighbours become one where there are too many, all where too many names are noted."""
        old = state.segments
        if state.dead > DEAD:
            at, upto = 0, len(old)
        elif len(old) >= SEGMENTS:
            at = min(range(len(old) - 1), key=lambda i: old[i].records + old[i + 1].records)
            upto = at + 2
        else:
            return old
        for kind in KINDS:
            rows = self._rows(kind, state, old[at:upto])
            self._write(rows.sortWithinPartitions("gram") if kind == "postings" else rows, kind, folder)
        number = self.spark.read.parquet(self._path(f"lengths/{folder}")).count()
        return [*old[:at], Segment(old[upto - 1].number, folder, number), *old[upto:]]

    def _changed(self, rows: DataFrame, changes: DataFrame, some: int, repeated: bool) -> DataFrame:
        """Rows of sources that changed, each line once, with ``status`` and ``from_line``."""
        add = changes.where("status in ('new', 'appended', 'rewritten')").select("src", "status", "from_line")
        of = rows.join(F.broadcast(add) if some <= FEW else add, "src")
        return of.dropDuplicates(KEY) if repeated else of

    def tick(self, records: DataFrame, version: str) -> dict[str, int]:
        """Brings the indexes to the present records and says how many sources changed how."""
        state = self._state()
        changes = cut(self.changes(records))
        found = changes.groupBy("status").agg(F.count("*").alias("n"), F.bool_or("repeated").alias("repeated")).collect()
        counts = {r.status: r.n for r in found}
        if not set(counts) - {"unchanged"}:
            return counts
        number = state.number + 1
        name, folder, some = f"{number:08d}p-{version}", f"{number:08d}", sum(n for status, n in counts.items() if status not in ("unchanged", "gone"))
        segments = self._merged(state, f"{folder}-merged")
        repeated = any(r.repeated for r in found)  # else no texts have to be exchanged
        fresh = self._changed(records.select(*KEY, "text"), changes, some, repeated).where("status <> 'appended' or line_no >= from_line")
        condensed = grams.numbered(fresh.select(*KEY, grams.condensed(F.col("text")).alias("c")), number)
        condensed.select(*KEY, grams.token_count(F.col("c")).cast("int").alias("len"), "run", "place", "c").write.mode("overwrite").parquet(self._path(f"measured/{folder}"))  # once for both
        measured = self.spark.read.parquet(self._path(f"measured/{folder}"))
        self._write(grams.occurrences(measured), "postings", folder)
        self._write(measured.select("line_no", "len", "src", "run", "place"), "lengths", folder)
        if self.embedder is not None:
            context = semantic.context_window(self._changed(records, changes, some, repeated))
            self._write(context.select("line_no", semantic.embed_column(F.col("context"), self.embedder).alias("embedding"), "src"), "vectors", folder)
        dead = changes.where(F.col("status").isin("gone", "rewritten", *["appended"] * (self.embedder is not None))).select("src", F.lit(number).alias("before"), (F.col("status") == "appended").alias("grown"))
        if state.dead:
            dead = dead.unionByName(self.spark.read.parquet(self._path(f"dead/{state.name}"))).groupBy("src", "grown").agg(F.max("before").alias("before"))
        dead.where(F.col("before") > (segments[0].number if segments else number)).write.mode("overwrite").parquet(self._path(f"dead/{name}"))
        noted = self.spark.read.parquet(self._path(f"dead/{name}")).count()
        segments = [*segments, Segment(number, folder, measured.count())]
        self.spark.createDataFrame([(segments, noted)], "segments array<struct<number: int, folder: string, records: bigint>>, dead bigint").write.mode("overwrite").parquet(self._path(f"state/{name}"))
        self.manifest.publish(changes.where("status <> 'gone'").select("src", "nlines", "sig", "last"), name)
        self._drop({s.folder for s in (*state.segments, *segments)}, {state.name, name})
        return counts

    def _drop(self, folders: set[str], names: set[str]) -> None:
        """Removes what neither this version nor the one before, which may still be read, consists of."""
        for kind, kept in [*((k, folders) for k in KINDS), ("measured", set()), ("dead", names), ("state", names)]:
            fs, path = self._files(kind)
            for f in fs.listStatus(path) if fs.exists(path) else []:
                if f.getPath().getName() not in kept:
                    fs.delete(f.getPath(), True)

    def totals(self) -> DataFrame:
        """One row: ``records, sources, terms``."""
        return self.lengths().agg(F.count("*").alias("records"), F.count_distinct("src").alias("sources"), F.coalesce(F.sum("len"), F.lit(0)).alias("terms"))

    def bm25(self, groups: list[list[str]]) -> DataFrame:
        """``src, line_no, score`` of the records that hold a token of each group."""
        corpus = self.lengths().agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("mean"))
        return grams.bm25_postings(self.postings([t for g in groups for t in g]), corpus, groups, KEY)
