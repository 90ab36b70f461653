"""Search over records: ranges of time, words, ranking, context. Each function returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairolog.functions import grams
from kairolog.functions.grammar import QueryPlan
from kairolog.functions.textprep import all_keywords, is_meta, is_negative
from kairolog.sources.records import with_ts

KEY = ["src", "line_no"]
#: With fewer matches than this, a level of search gives way to the next.
ENOUGH = 2


def local(ts: Column, tz: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def between(ts: Column, span: tuple[datetime, datetime]) -> Column:
    """Half-open range; both bounds are literals, so they reach the scan."""
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in span)
    return (ts >= lo) & (ts < hi)


def in_hours(ts: Column, hours: tuple[int, int], tz: str) -> Column:
    h = F.hour(local(ts, tz))
    return (h >= hours[0]) & (h < hours[1])


def searchable(records: DataFrame, actor: str | None = None, docs: bool = True) -> DataFrame:
    """Without meta rows (rows without type are no match either), of one actor if named, without documents if not wanted."""
    out = records.where("type <> 'meta'" if docs else "type not in ('meta', 'doc')")
    return out.where(F.col("actor") == actor) if actor else out


def in_time(records: DataFrame, plan: QueryPlan) -> DataFrame:
    if plan.utc:
        records = records.where(between(F.col("ts"), plan.utc))
    return records.where(in_hours(F.col("ts"), plan.hours, plan.tz)) if plan.hours else records


def latest_day_with_hours(records: DataFrame, hours: tuple[int, int], tz: str) -> DataFrame:
    """One row: the last local day that has a record in these hours."""
    return records.where(in_hours(F.col("ts"), hours, tz)).agg(F.max(local(F.col("ts"), tz).cast("date")).alias("day"))


def time_scope(records: DataFrame, plan: QueryPlan, actor: str | None = None) -> DataFrame:
    """Records in the range of a plan. Hours without a day mean the last day that has any."""
    rows = searchable(records, actor, docs=False)
    if plan.hours and plan.days is None:
        day = latest_day_with_hours(rows, plan.hours, plan.tz).scalar()
        return in_time(rows, plan).where(local(F.col("ts"), plan.tz).cast("date") == day)
    return in_time(rows, plan)


def search_time(records: DataFrame, plan: QueryPlan, actor: str | None = None) -> DataFrame:
    """Records in range with ``level``: L1 those with all keywords, or, if fewer than two are, L2 the whole range; L0 without keywords.

    The number of matches is a scalar subquery that stops at two.
    """
    scope = time_scope(records, plan, actor)
    if not plan.keywords:
        return scope.withColumn("level", F.lit("L0"))
    hit = F.coalesce(all_keywords(F.col("text"), plan.keywords), F.lit(False))
    enough = scope.where(hit).limit(ENOUGH).agg(F.count("*") >= ENOUGH).scalar()
    return scope.where(hit | ~enough).withColumn("level", F.when(enough, "L1").otherwise("L2"))


def fetch_day(records: DataFrame, plan: QueryPlan, limit: int = 40, actor: str | None = None) -> DataFrame:
    """The latest ``limit`` records of a range."""
    return in_time(searchable(records, actor), plan).orderBy(F.col("ts").desc(), F.col("src").desc(), F.col("line_no").desc()).limit(limit)


def day_counts(rows: DataFrame, tz: str) -> DataFrame:
    return rows.groupBy(F.date_format(local(F.col("ts"), tz), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def type_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce(F.nullif("type", F.lit("")), F.lit("text")).alias("type")).agg(F.count("*").alias("n"))


def range_totals(records: DataFrame, plan: QueryPlan, actor: str | None = None) -> DataFrame:
    """One row: records in range, those with all keywords, characters."""
    scope = time_scope(records, plan, actor)
    return scope.agg(F.count("*").alias("total"), F.count_if(F.coalesce(all_keywords(F.col("text"), plan.keywords), F.lit(False))).alias("kw_total"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


class WordIndex(Protocol):
    """What scores records by a written index: ``src, line_no, score`` of those that hold a token of each group."""

    def bm25(self, groups: list[list[str]]) -> DataFrame: ...


def ranked(records: DataFrame, groups: list[list[str]], plan: QueryPlan, limit: int, actor: str | None = None, index: WordIndex | None = None) -> DataFrame:
    """Best ``limit`` records by score, negative answers last. The range filters before the cut; statistics are of all records. With an ``index`` no text is
    read but that of records it finds."""
    kept = in_time(searchable(records, actor), plan)
    scored = kept.join(index.bm25(groups), KEY) if index else grams.bm25(kept, groups, grams.statistics(records, [t for g in groups for t in g]))
    low = is_negative(F.col("text"))
    return scored.withColumn("negative", low).orderBy("negative", F.col("score").desc(), *KEY).limit(limit)


def newest(records: DataFrame, plan: QueryPlan, limit: int, actor: str | None = None) -> DataFrame:
    rows = in_time(searchable(records, actor), plan).withColumns({"score": F.lit(0.0), "negative": is_negative(F.col("text"))})
    return rows.where("ts is not null").orderBy("negative", F.col("ts").desc(), *KEY).limit(limit)


def search(records: DataFrame, plan: QueryPlan, limit: int = 5, actor: str | None = None, untimed: DataFrame | None = None, index: WordIndex | None = None) -> DataFrame:
    """The cascade with ``stage``: all keywords; any bigram of the query; the newest. The first stage that finds anything answers.

    ``untimed`` may be the same records without their time read, for stages that no time narrows; the time of what they find is read then.
    """
    words = records if untimed is None or plan.utc or plan.hours else untimed
    every = [[t for w in g for t in grams.query_tokens(w)] for g in plan.keywords]
    loose = [t for g in plan.keywords for w in g[:1] for t in grams.query_tokens(w)]
    stages = []
    if len(plan.keywords) >= 2 and all(every):
        stages.append(ranked(words, every, plan, limit, actor, index))
    if loose:
        stages.append(ranked(words, [loose], plan, limit, actor, index))
    stages.append(newest(records, plan, limit, actor))
    for i, found in enumerate(stages[:-1]):
        rows = found.collect()  # at most `limit`; a stage runs once, and later ones not at all if it finds anything
        if rows:
            few = records.sparkSession.createDataFrame(rows, found.schema)
            return (few if words is records else with_ts(few.drop("ts")).select(*found.columns)).withColumn("stage", F.lit(len(stages) - i))
    return stages[-1].withColumn("stage", F.lit(1))


def bases(records: DataFrame) -> DataFrame:
    """``src, base, size``: where each source begins in the order of all records. A row for each source, no text is read."""
    size = records.groupBy("src").agg(F.count("*").alias("size"))
    return size.select("src", F.coalesce(F.sum("size").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), "size")


def with_context(records: DataFrame, hits: DataFrame, around: int, cell: int = 1_000) -> DataFrame:
    """Hits and their neighbours within ``around`` places of the same session, with ``is_hit``.

    Places are counted over all sources, but only the sources of hits are ranked to find theirs, and only the sources that hold a wanted place
    to fetch it. Which source holds a place is an equi-join by cells of ``cell`` places.
    """
    base = bases(records)
    rank = F.row_number().over(Window.partitionBy("src").orderBy("line_no"))
    named = hits.select(*KEY).distinct()
    own = records.select(*KEY, "session").join(named.select("src").distinct(), "src", "left_semi").withColumn("_r", rank)
    at = own.join(named, KEY).join(base, "src").select(F.col("session").alias("_s"), (F.col("base") + F.col("_r") - 1).alias("_at"))
    wanted = at.select("_s", "_at", F.explode(F.sequence(F.col("_at") - around, F.col("_at") + around)).alias("pos")).groupBy("pos", "_s").agg(F.max(F.col("pos") == F.col("_at")).alias("is_hit"))
    spread = base.select("src", "base", "size", F.explode(F.sequence(F.floor(F.col("base") / cell), F.floor((F.col("base") + F.col("size") - 1) / cell))).alias("_cell"))
    placed = wanted.withColumn("_cell", F.floor(F.col("pos") / cell)).join(spread, "_cell").where((F.col("pos") >= F.col("base")) & (F.col("pos") < F.col("base") + F.col("size"))).select("src", (F.col("pos") - F.col("base") + 1).alias("_r"), "_s", "is_hit")
    near = records.join(placed.select("src").distinct(), "src", "left_semi").withColumn("_r", rank).join(placed, ["src", "_r"]).where(F.col("session").eqNullSafe(F.col("_s")))
    return near.select(*records.columns, "is_hit")


def dedupe(rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The first row of each (time, actor, text, type) in the given order."""
    first = F.row_number().over(Window.partitionBy("ts", "actor", "text", F.coalesce("type", F.lit("text"))).orderBy(*order))
    return rows.withColumn("_first", first).where("_first = 1").drop("_first")


def compaction_ranges(records: DataFrame) -> DataFrame:
    """``session, n, start, end``: stretches between compactions of each session; n = 1 is the last, ``start`` the one before or the first record."""
    marks = records.where((F.col("type") == "meta") & is_meta(F.col("text")) & F.col("ts").isNotNull()).select("session", "ts").distinct()
    first = records.where("ts is not null").groupBy("session").agg(F.min("ts").alias("_first"))
    order = Window.partitionBy("session").orderBy(F.col("ts").desc())
    out = marks.join(first, "session").select("session", F.row_number().over(order).alias("n"), F.coalesce(F.lead("ts").over(order), "_first").alias("start"), F.col("ts").alias("end"))
    return out


def last_session(records: DataFrame) -> DataFrame:
    """One row: the session of the newest record that has one."""
    return records.where(F.coalesce(F.trim("session"), F.lit("")) != "").agg(F.max_by("session", F.struct("ts", "src", "line_no")).alias("session"))


def live_tail(fresh: DataFrame, words: Sequence[str], shown: DataFrame | None = None, limit: int = 3) -> DataFrame:
    """Records not yet indexed that hold a third of the query's words or more, by number of words, then newest."""
    words = list(dict.fromkeys(w.lower() for w in words))[:12]
    n = reduce(lambda a, w: a + F.lower("text").contains(w).cast("int"), words, F.lit(0))
    found = fresh.where((F.length("text") >= 10) & ~is_meta(F.col("text"))).withColumn("n_match", n).where(F.col("n_match") >= max(1, len(words) // 3))
    if shown is not None:
        same = {"_t": F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("")), "_x": F.substring("text", 1, 40)}
        keys = shown.withColumns(same).select("_t", "_x").distinct()
        found = found.withColumns(same).join(keys, ["_t", "_x"], "left_anti").drop("_t", "_x")
    return found.orderBy(F.col("n_match").desc(), F.col("ts").desc(), *KEY).limit(limit)
