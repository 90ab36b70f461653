"""Indexes that follow the logs: one tick on demand, or one every ten minutes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kairolog.config import Config
from kairolog.operators.manifest import Versions, apply_changes, classify, snapshot
from kairolog.functions.semantic import Embedder
from kairolog.plans.upkeep import Indexes
from kairolog.session import cut
from kairolog.sources import growing, ingest
from kairolog.sources.records import FIELDS, with_ts


def tick(spark: SparkSession, lines: DataFrame, root: str, version: str) -> dict[str, int]:
    """Brings the index in ``root`` to the present lines ``src, line_no, line`` and says how many sources changed how."""
    index, manifest = Versions(spark, f"{root}/index"), Versions(spark, f"{root}/manifest")
    held = index.read()
    held = held if held is not None else spark.createDataFrame([], "src string, line_no int, line string")
    known = manifest.read()
    known = known if known is not None else spark.createDataFrame([], "src string, nlines bigint, sig bigint")
    changes = classify(lines, known)
    counts = {r.status: r.n for r in changes.groupBy("status").agg(F.count("*").alias("n")).collect()}
    if set(counts) - {"unchanged"}:
        index.publish(apply_changes(held, lines, changes), version)
        manifest.publish(snapshot(lines), version)
    return counts


def pipeline(spark: SparkSession, lines: DataFrame, config: Config, data_dir: str, root: str, version: str, embedder: Embedder | None = None, force: bool = False) -> tuple[bool, str]:
    """One pass from raw lines ``src_file, line_no, line`` to indexes: nothing if no line changed since the last pass, else day files and then the indexes of words
    and of meaning are brought up to date. The stamp is written last, so a pass that dies is done again."""
    stamp = Versions(spark, f"{root}/stamp")
    now, old = ingest.fingerprint(lines).first(), stamp.read()
    if not force and old is not None and tuple(old.first()) == tuple(now):
        return False, "nothing changed"
    made = ingest.convert_all(lines, config, data_dir) if force or old is None else ingest.convert_more(lines, config, data_dir)
    records = cut(records_of(spark, data_dir))
    counts = Indexes(spark, f"{root}/indexes", embedder).tick(records, version)
    stamp.publish(spark.createDataFrame([tuple(now)], "files bigint, lines bigint, print bigint"), version)
    return True, f"{made.total} records of {made.days} days, {made.skipped} lines skipped; sources: " + ", ".join(f"{n} {status}" for status, n in sorted(counts.items()))


def records_of(spark: SparkSession, data_dir: str) -> DataFrame:
    """Records of the day files, numbered within each day by time as written and origin."""
    rows = ingest.stored(spark, data_dir).select(F.col("ts").alias("ts_raw"), "actor", "role", "type", "text", "model", "session", F.concat(F.lit("main/"), F.col("day")).alias("src"), "origin")
    place = F.row_number().over(Window.partitionBy("src").orderBy("ts_raw", "origin")) - 1
    return with_ts(rows.withColumn("line_no", place.cast("int")).drop("origin")).select(*FIELDS)


def follow(spark: SparkSession, pattern: str, checkpoint: str, each: Callable[[DataFrame, int], None], config: Config, once: bool = False) -> StreamingQuery:
    """Streams new lines of growing files to ``each``; with ``once`` what is there now, else every ``daemon_interval`` seconds."""
    growing.register(spark)
    rows = spark.readStream.format("growing_lines").load(pattern)
    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{config.daemon_interval} seconds")).start()
