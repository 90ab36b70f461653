"""Stretches of activity, split at inactivity gaps (problem 6).

Merging interval state: each event opens an interval of the gap's length, overlapping intervals of a key merge. Spark's
``session_window`` keeps that state, in a batch as in a stream, where a watermark bounds it and late events still
merge two sessions into one.

Skew: a key may hold a third of all rows. In a batch, events are first reduced by key and cell of one gap's length, by plain
partial aggregation: events of one cell are never more than a gap apart, so a cell never splits. What is left
per key is bounded by the time it spans divided by the gap, however many rows it has.

Defined results: null keys and null or unreadable times do not count; events exactly one gap apart belong together;
repeated rows count as ``distinct_on`` says; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairolog.operators.timestamps import with_instant

GAP_MINUTES = 30


def clean_actor(actor: Column) -> Column:
    return F.lower(F.regexp_replace(actor, r"^[\s\u00a0\u3000]+|[\s\u00a0\u3000]+$", ""))


def sessionize(events: DataFrame, key: str, at_us: str, gap_us: int) -> DataFrame:
    """``key, start_us, end_us, duration_us, n_rows`` of each stretch of ``key``; ``at_us`` holds instants in microseconds."""
    cell = F.floor(F.col(at_us) / gap_us)
    cells = events.where(F.col(key).isNotNull() & F.col(at_us).isNotNull()).groupBy(key, cell.alias("_cell")).agg(F.min(at_us).alias("_lo"), F.max(at_us).alias("_hi"), F.count("*").alias("_n"))
    ends = F.explode(F.array(F.struct(F.col("_lo").alias("us"), F.col("_n").alias("n")), F.struct(F.col("_hi").alias("us"), F.lit(0).cast("bigint").alias("n"))))
    opened = cells.select(key, ends.alias("_e")).select(key, "_e.us", "_e.n", F.timestamp_micros("_e.us").alias("_at"))
    # intervals that touch are merged, so events exactly one gap apart meet
    merged = opened.groupBy(key, F.session_window("_at", f"{gap_us // 1_000_000} seconds {gap_us % 1_000_000} microseconds").alias("_w"))
    out = merged.agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.sum("n").alias("n_rows"))
    return out.select(key, "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_rows")


def delivered_once(rows: DataFrame, row_key: str) -> DataFrame:
    """Rows that differ in nothing but ``row_key`` count once. Long texts are compared by their 128 bits of two hashes, not moved."""
    others = [c for c in rows.columns if c != row_key]
    kinds = dict(rows.dtypes)
    keys = [f for c in others for f in ([F.xxhash64(c).alias(f"_x_{c}"), F.md5(F.col(c)).alias(f"_m_{c}")] if c == "text" and kinds[c] == "string" else [F.col(c)])]
    return rows.select(*keys).distinct()


def actor_sessions(meta: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """Stretches of activity of each actor over all sessions of ``meta``."""
    once = delivered_once(meta.select("rowid", "ts", "actor", "text", "session", "src_day", "line_no").where("actor is not null and ts is not null"), "rowid")
    at = with_instant(once.select("ts", clean_actor(F.col("actor")).alias("actor")), "ts")
    return sessionize(at, "actor", "utc_us", gap_minutes * 60_000_000)


def session_stream(events: DataFrame, key: str, at: str, gap: str, watermark: str) -> DataFrame:
    """The same for a stream: sessions come out once the watermark has passed their end; events late by less still merge. As in a batch,
    events exactly one gap apart belong together."""
    state = events.withWatermark(at, watermark).groupBy(key, F.session_window(at, gap).alias("w"))
    return state.agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n_rows")).select(key, "start", "end", "n_rows")
