"""Changes between two states of sources, and indexes that follow them.

A manifest has a row for each source: its number of lines and one signature of the lines before a given line, which both indexes share. A source is unchanged,
appended to, rewritten, gone or new; only lines that need it are indexed again. Signatures combine the digests of single lines by
addition, weighted by line number, so they are aggregated with map-side combine and no source has to be held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PRIME = 4_294_967_291


def line_digest(line_no: Column, line: Column) -> Column:
    """A digest of a line at its place, below a prime of 32 bits, so that sums stay exact."""
    return F.pmod(F.conv(F.substring(F.sha1(F.concat_ws("\u0000", line_no.cast("string"), F.coalesce(line, F.lit("")))), 1, 15), 16, 10).cast("bigint"), F.lit(_PRIME))


def row_digest(line_no: Column, *values: str) -> Column:
    """The same of columns, nulls told from empty texts, without writing them as one line; not for signatures that others know."""
    parts = [x for v in values for x in (F.col(v).isNull(), F.col(v))]
    return F.pmod(F.xxhash64(line_no, *parts), F.lit(_PRIME))


def snapshot(lines: DataFrame) -> DataFrame:
    """``src, nlines, sig`` of lines ``src, line_no, line``; lines repeated count once."""
    once = lines.select("src", "line_no", "line").distinct()
    return once.groupBy("src").agg(F.count_distinct("line_no").alias("nlines"), F.sum(line_digest(F.col("line_no"), F.col("line"))).alias("sig"))


def classify(lines: DataFrame, manifest: DataFrame) -> DataFrame:
    """``src, status, nlines, sig, from_line``: what happened to each source since ``manifest``, and the first line to index."""
    once = lines.select("src", "line_no", "line").distinct()
    digests = once.select("src", "line_no", line_digest(F.col("line_no"), F.col("line")).alias("digest"))
    return compare(digests, manifest.select("src", "nlines", "sig", F.col("nlines").alias("end"))).drop("last", "repeated")


def compare(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """The same, the ``last`` line of each source, and whether one of its lines is ``repeated``, from the digest of each line, there once, and the number of its
    ``copies``, if known. ``end`` is the line after those the manifest knows: more than their number where lines are left out."""
    old = manifest.select("src", F.col("nlines").alias("old_n"), F.col("sig").alias("old_sig"), "end")
    once = digests.join(old.select("src", "end"), "src", "left")
    now = once.groupBy("src").agg(F.count_distinct("line_no").alias("nlines"), F.sum("digest").alias("sig"), F.sum(F.when(F.col("line_no") < F.col("end"), F.col("digest"))).alias("prefix"), F.max("line_no").alias("last"), F.sum("copies" if "copies" in digests.columns else F.lit(1)).alias("copies"))
    both = now.join(old, "src", "full_outer")
    same = F.coalesce(F.col("prefix"), F.lit(0)) == F.col("old_sig")
    status = F.when(F.col("nlines").isNull(), "gone").when(F.col("old_n").isNull(), "new").when((F.col("nlines") == F.col("old_n")) & same, "unchanged").when((F.col("nlines") > F.col("old_n")) & same, "appended").otherwise("rewritten")
    from_line = F.when(status == "appended", F.col("end")).when(status == "unchanged", F.col("nlines")).otherwise(F.lit(0)).cast("bigint")
    return both.select("src", status.alias("status"), "nlines", "sig", from_line.alias("from_line"), "last", (F.col("copies") > F.col("nlines")).alias("repeated"))


def damaged(index: DataFrame, manifest: DataFrame) -> DataFrame:
    """``src`` of sources whose indexed lines can't be right: a line beyond those known, or one there twice."""
    held = index.groupBy("src", "line_no").agg(F.count("*").alias("n")).join(manifest.select("src", "nlines"), "src", "left")
    return held.where((F.col("n") > 1) | F.col("nlines").isNull() | (F.col("line_no") >= F.col("nlines"))).select("src").distinct()


def apply_changes(index: DataFrame, lines: DataFrame, changes: DataFrame, keep_before: int = 0) -> DataFrame:
    """The index after ``changes``: rows of sources that are gone or rewritten are dropped, new lines added. ``index`` has ``src, line_no, line``.

    ``keep_before`` lines before an appended part are taken anew as well, where what is derived from a line looks at later ones.
    """
    start = F.greatest(F.col("from_line") - F.when(F.col("status") == "appended", keep_before).otherwise(0), F.lit(0))
    todo = changes.where("status <> 'gone'").select("src", start.alias("_from"))
    kept = index.join(todo, "src").where("line_no < _from").select("src", "line_no", "line")
    added = lines.join(todo, "src").where("line_no >= _from").select("src", "line_no", "line").distinct()
    return kept.unionByName(added)


class Versions:
    """Versions of a table in a folder; a small file names the one readers use, and is replaced whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self) -> tuple[object, object]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def current(self) -> str | None:
        fs, path = self._pointer()
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        name = self.current()
        return self.spark.read.parquet(f"{self.root}/{name}") if name else None

    def publish(self, table: DataFrame, name: str) -> None:
        """Writes a version, then points readers to it; a run that dies before leaves the old one in place."""
        table.write.mode("overwrite").parquet(f"{self.root}/{name}")
        fs, path = self._pointer()
        new = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT.{name}")
        stream = fs.create(new, True)
        stream.write(bytearray(name.encode()))
        stream.close()
        fs_api = self.spark._jvm.org.apache.hadoop.fs
        rename = getattr(fs_api, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        fs_api.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(new, path, how)
