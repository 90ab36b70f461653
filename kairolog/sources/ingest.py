"""Conversion of raw logs to day files: all of them, or what was added since.

A day file is a folder of JSON lines for one local day, ordered by time as written. Every row keeps its ``origin``, the raw file and the place in
it, so a row that is written again after a failure replaces itself. New rows that belong to an earlier day are merged into that day; days without new
rows are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kairolog.config import Config
from kairolog.session import cut
from kairolog.sources.records import FIELDS, PARSERS, local_day, with_ts

STORED = "ts string, actor string, role string, type string, text string, model string, session string, origin string"


@dataclass(frozen=True)
class Counts:
    """Records written, lines without a record (blank and broken ones too), days written."""

    total: int
    skipped: int
    days: int


def day_rows(records: DataFrame, tz: str) -> DataFrame:
    """Records as rows of day files, with ``day``."""
    kept = [F.col("ts_raw").alias("ts"), "actor", "role", "type", "text", "model", "session"]
    place = F.concat_ws(":", "src", F.lpad(F.col("line_no").cast("string"), 12, "0"), "type", F.substring(F.sha1(F.coalesce("text", F.lit("")).cast("binary")), 1, 8))
    return records.select(*kept, place.alias("origin"), local_day(F.col("ts"), F.col("ts_raw"), tz).alias("day"))


def _write(rows: DataFrame, folder: str) -> None:
    spread = rows.repartition("day").sortWithinPartitions("day", "ts", "origin")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("day").json(folder)


def convert_all(lines: DataFrame, config: Config, data_dir: str) -> Counts:
    """Day files of all raw lines ``src_file, line_no, line``, in one pass. Days that come out replace what was there."""
    seen, made = Observation(), Observation()
    records = PARSERS[config.ingest_format](lines.observe(seen, F.count("*").alias("n")), config)
    rows = cut(day_rows(records.observe(made, F.count("*").alias("n")), config.timezone))
    _write(rows, f"{data_dir}/main")
    days = rows.agg(F.count_distinct("day")).first()[0]
    with_record = rows.agg(F.count_distinct(F.regexp_extract("origin", r"^(.*:\d{12}):", 1))).first()[0]
    return Counts(made.get["n"], seen.get["n"] - with_record, days)


def convert_more(lines: DataFrame, config: Config, data_dir: str) -> Counts:
    """Day files brought up to date with new raw lines. In order or late, each row goes into its own day; rows that are there already are replaced."""
    seen = Observation()
    records = PARSERS[config.ingest_format](lines.observe(seen, F.count("*").alias("n")), config)
    new = cut(day_rows(records, config.timezone).distinct())
    merged = cut(merge(stored(lines.sparkSession, data_dir), new))  # what is read here is overwritten next
    _write(merged, f"{data_dir}/main")
    with_record, total = new.agg(F.count_distinct(F.regexp_extract("origin", r"^(.*:\d{12}):", 1)), F.count("*")).first()
    return Counts(total, seen.get["n"] - with_record, new.agg(F.count_distinct("day")).first()[0])


def merge(held: DataFrame | None, new: DataFrame) -> DataFrame:
    """Whole rows of the days that ``new`` has any of: those held before, without the ones that come again, and the new ones."""
    if held is None:
        return new
    touched = new.select("day").distinct()
    kept = held.join(touched, "day", "left_semi").join(new.select("origin"), "origin", "left_anti")
    return kept.select(*new.columns).unionByName(new)


def stored(spark: SparkSession, data_dir: str) -> DataFrame | None:
    """Rows of the day files with ``day``, or nothing if there are none yet."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{data_dir}/main")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"{STORED}, day string").option("mode", "DROPMALFORMED").json(f"{data_dir}/main")


def write_corpus(records: DataFrame, data_dir: str) -> None:
    """Records as files ``main/<day>`` or ``corpus/<folder>/<file>``, after their ``src``. Folders other than ``main`` are corpora."""
    place = F.when(F.col("src").startswith("main/"), F.col("src")).otherwise(F.concat(F.lit("corpus/"), F.regexp_replace("src", "^corpus/", "")))
    rows = records.select(F.col("ts_raw").alias("ts"), "actor", "role", "type", "text", "model", "session", "line_no", place.alias("file"))
    rows.repartition("file").sortWithinPartitions("file", "line_no").write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("file").json(f"{data_dir}/lines")


def read_corpus(spark: SparkSession, data_dir: str) -> DataFrame:
    """Records of day files and of corpora, ``src`` telling which file."""
    rows = spark.read.schema("ts string, actor string, role string, type string, text string, model string, session string, line_no int, file string").option("mode", "DROPMALFORMED").json(f"{data_dir}/lines")
    return with_ts(rows.select(F.col("ts").alias("ts_raw"), "actor", "role", "type", "text", "model", "session", F.col("file").alias("src"), "line_no")).select(*FIELDS)


def fingerprint(lines: DataFrame) -> DataFrame:
    """One row: ``files, lines, print`` of raw lines; it changes with any line, and is summed with map-side combine."""
    each = lines.groupBy("src_file").agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("src_file", "line_no", "line"), F.lit(1 << 40))).alias("p"))
    return each.agg(F.count("*").alias("files"), F.sum("n").alias("lines"), F.sum("p").alias("print"))


def active_lines(spark: SparkSession, pattern: str, now_iso: str, hours: int = 48) -> DataFrame:
    """Lines of transcripts changed within ``hours`` before ``now_iso`` (UTC); older files are not opened."""
    since = spark.sql(f"SELECT date_format(timestamp'{now_iso}' - interval {int(hours)} hours, \"yyyy-MM-dd'T'HH:mm:ss\") AS t").first()[0]
    rows = spark.read.option("modifiedAfter", since).text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("src_file"), "value")
    return rows.select("src_file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def origin_times(log: DataFrame, tz: str, tag: str = "app") -> DataFrame:
    """``ts`` (UTC, no zone) of the entries ``time, tag`` of an origin log that carry ``tag``; times there are local. Unreadable ones are skipped."""
    local = F.try_to_timestamp("time").cast("timestamp_ntz")
    return log.where(F.lower(F.trim("tag")) == tag).select(F.convert_timezone(F.lit(tz), F.lit("UTC"), local).alias("ts")).where("ts is not null").distinct()
