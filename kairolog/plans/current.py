"""What is being talked about now, from active transcripts to a few lines.

User rows of the live branches of all active sessions and topic markers go on one timeline. It is narrowed to the last hours, or to the last few events if
nothing is that fresh, cut into topic blocks, reduced to the first row of each block, markers and rows of heat, folded by half hours, and given
headlines and marks: ``◆`` another branch, ``▲`` sent from the app, ``!`` heat within a block, ``*done `` a topic that is done.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairolog.config import Config, corrections, word_list
from kairolog.functions import vocabulary as v
from kairolog.functions.textprep import any_of, corrected, has_heat
from kairolog.operators import state
from kairolog.sources import records as r

SOURCE_CHARS = 30


def transcript_nodes(lines: DataFrame) -> DataFrame:
    """``tree, line_no, id, parent, ts, role, text`` of transcript lines ``src_file, line_no, line``: each file is a tree of its own."""
    j = F.from_json("line", "type string, timestamp string, uuid string, parentUuid string, message string").alias("j")
    step = lines.select("src_file", "line_no", j).select("src_file", "line_no", "j.*").where(F.col("type").isin("user", "assistant"))
    raw = F.get_json_object("message", "$.content")
    body = r.clean(F.when(F.ltrim(raw).startswith("["), r.text_of(raw)).otherwise(F.coalesce(raw, F.lit(""))))
    named = step.select(F.col("src_file").alias("tree"), "line_no", F.col("uuid").alias("id"), F.col("parentUuid").alias("parent"), F.col("timestamp").alias("_raw"), F.when(F.col("type") == "user", "user").otherwise("ai").alias("role"), body.alias("text"))
    return r.with_ts(named, "_raw").drop("_raw").where("ts is not null")


def user_rows(nodes: DataFrame, window_minutes: int = 15) -> DataFrame:
    """``ts, text, mark`` of what the user said on live branches. Rows without id stay."""
    alive = state.live_branches(nodes.where("id is not null"), window_minutes)
    loose = nodes.where("id is null").withColumns({"alive": F.lit(False), "newest": F.lit(False)})
    return state.user_events(alive.unionByName(loose.select(*alive.columns))).where("text <> ''").select("ts", "text", "mark")


def timeline(rows: DataFrame, markers: DataFrame, now: datetime, hours: int = 4, least: int = 3) -> DataFrame:
    """``ts, text, mark, marker`` of rows and topic markers (``ts, topic, done``) of the last ``hours``, or of the ``least`` last if there is none."""
    topics = markers.where("topic <> ''").select("ts", F.col("topic").alias("text"), F.when(F.col("done"), "*done ").otherwise("").alias("mark"), F.lit(True).alias("marker"))
    both = rows.select("ts", "text", "mark", F.lit(False).alias("marker")).unionByName(topics).where(F.col("ts") <= F.lit(now).cast("timestamp_ntz"))
    fresh = F.col("ts") >= F.lit(now - timedelta(hours=hours)).cast("timestamp_ntz")
    any_fresh = both.where(fresh).limit(1).agg(F.count("*") > 0).scalar()
    since = both.orderBy(F.col("ts").desc()).limit(least).agg(F.min("ts")).scalar()
    return both.where(F.when(any_fresh, fresh).otherwise(F.col("ts") >= since))


def index_rows(events: DataFrame, now: datetime, heat: Sequence[str] = v.HEAT_WORDS, topic_words: Sequence[str] = v.TOPIC_WORDS, origins: DataFrame | None = None, fixes: dict[str, str] | None = None) -> DataFrame:
    """``ts, mark, headline`` of the rows of a timeline that are shown."""
    blocks = state.topic_blocks(events.withColumn("_all", F.lit(0)), "_all", "ts")
    hot = has_heat(F.col("text"), heat)
    heads = state.block_heads(blocks, "_all", "ts", F.col("marker") | hot)
    inner = F.row_number().over(state.Window.partitionBy("block").orderBy("ts", "marker", "text")) > 1
    marked = heads.withColumn("mark", F.concat("mark", F.when(hot & ~F.col("marker") & inner, "!").otherwise("")))
    shown = state.fold(marked.select("ts", "text", "mark", "marker", "exempt"), "ts", now)
    if origins is not None:
        near = state.near_origin(shown.where("not marker"), origins, "ts").select("ts", "text").withColumn("_app", F.lit(True)).distinct()
        shown = shown.join(near, ["ts", "text"], "left").withColumn("mark", F.concat(F.when(F.col("_app") & ~F.col("marker"), "▲").otherwise(""), "mark")).drop("_app")
    source = corrected(F.substring("text", 1, SOURCE_CHARS), fixes or {})
    return shown.select("ts", "mark", F.when(F.col("marker"), F.col("text")).otherwise(state.headline(source, topic_words=topic_words)).alias("headline"))


def today_lines(lines: DataFrame, markers: DataFrame, config: Config, now: datetime, origins: DataFrame | None = None, cap: int = 40) -> list[str]:
    """Lines to read from active transcripts. Whatever fails, no line is better than a wrong one."""
    try:
        words = config.topic_words or tuple(word_list(config, "topic_words.json", v.TOPIC_WORDS))
        rows = index_rows(timeline(user_rows(transcript_nodes(lines)), markers, now), now, word_list(config, "heat_words.json", v.HEAT_WORDS), words, origins, corrections(config))
        return state.index_lines(rows, "ts", config.timezone, cap)
    except Exception:
        return []


def topic_markers(spark: SparkSession, path: str) -> DataFrame:
    """``ts, topic, done`` of a file of JSON lines of topics and of words of topics that are done."""
    raw = spark.read.schema("ts string, topic string, match string").option("mode", "DROPMALFORMED").json(path)
    parsed = r.with_ts(raw, "ts") if "ts_raw" in raw.columns else r.with_ts(raw.withColumnRenamed("ts", "_raw"), "_raw").drop("_raw")
    done = parsed.where("match <> ''").select("match").distinct()
    topics = parsed.where("topic <> ''").select("ts", "topic")
    is_done = topics.join(F.broadcast(done), F.col("topic").contains(F.col("match")), "left_semi").distinct().withColumn("done", F.lit(True))  # words a person has typed
    return topics.join(is_done, ["ts", "topic"], "left").withColumn("done", F.coalesce("done", F.lit(False)))
