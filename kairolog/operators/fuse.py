"""Fusion of ranked lists: reciprocal ranks, distance gates, recency, a cut relative to the best."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairolog.functions.textprep import has_heat, is_echo

K = 60
RELATIVE_CUT = 0.35
HALF_LIFE_DAYS, FLOOR, HEAT_FLOOR = 30.0, 0.5, 0.9
ECHO_MINUTES, ECHO_HOURS = 15, 48


def without_echo(rows: DataFrame, query: str, now: datetime) -> DataFrame:
    """Without rows of the last minutes and without those of the last two days that quote the query."""
    at = F.lit(now).cast("timestamp_ntz")
    fresh = F.col("ts") > at - F.expr(f"interval {ECHO_MINUTES} minutes")
    quoted = (F.col("ts") > at - F.expr(f"interval {ECHO_HOURS} hours")) & is_echo(F.col("text"), query)
    return rows.where(~F.coalesce(fresh | quoted, F.lit(False)))


def fuse(exact: DataFrame, near: DataFrame, now: datetime, limit: int, near_cut: float = 0.51, far_cut: float | None = 0.60, recency: bool = True) -> DataFrame:
    """Fused rows with ``score`` and ``confirm``. ``exact`` and ``near`` are short lists with ``rank``, near also with ``distance``.

    Rows are the same if time and the first 40 characters are. If even the nearest is beyond ``far_cut`` nothing is
    returned (None switches that off); between the cuts ``confirm`` is set.
    """
    part = lambda df, d: df.select("ts", "actor", "text", "src", "line_no", "rank", d.alias("distance"))
    both = part(exact, F.lit(None).cast("double")).unionByName(part(near, F.col("distance").cast("double")))
    both = both.withColumns({"_key": F.substring("text", 1, 40), "_best": F.min("distance").over(Window.partitionBy(F.lit(0)))})  # two short lists
    first = F.min(F.struct("rank", "src", "line_no", "actor", "text")).alias("r")
    merged = both.groupBy("ts", "_key", "_best").agg(F.sum(1.0 / (K + F.col("rank"))).alias("rrf"), F.min("distance").alias("distance"), first)
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000.0)
    weight = FLOOR + (1 - FLOOR) * F.pow(F.lit(0.5), age / HALF_LIFE_DAYS)
    weight = F.when(has_heat(F.col("r.text")), F.greatest(weight, F.lit(HEAT_FLOOR))).otherwise(weight) if recency else F.lit(1.0)
    scored = merged.select("ts", "r.actor", "r.text", "r.src", "r.line_no", "distance", "_best", (F.col("rrf") * F.coalesce(weight, F.lit(FLOOR))).alias("score"))
    kept = scored.withColumn("_top", F.max("score").over(Window.partitionBy(F.lit(0)))).where(F.col("score") >= RELATIVE_CUT * F.col("_top"))
    if far_cut is not None:
        kept = kept.where(~F.coalesce(F.col("_best") > far_cut, F.lit(False)))
    kept = kept.withColumn("confirm", F.coalesce(F.col("_best") > near_cut, F.lit(False)))
    return kept.orderBy(F.col("score").desc(), "ts", "src", "line_no").limit(limit).drop("_best", "_top")


def rank(rows: DataFrame, *order: object) -> DataFrame:
    """``rank`` from 1 of a list that is already short."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
