"""From a question to rows: one plan, one route, one result that says how it was found.

Rows are given as they were written, in order of time. What was widened or could not be read is said in the result, never
shown as if nothing had been found.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from datetime import UTC, date, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairolog.config import Config, corrections, load, read_json, vocabulary
from kairolog.functions.grammar import QueryPlan, parse
from kairolog.functions.semantic import Embedder, knn
from kairolog.functions.textprep import query_variants
from kairolog.operators import fuse as fusion
from kairolog.operators import search as s

DISPLAY_CHARS, TAIL_CHARS = 300, 200


@dataclass
class RecallResult:
    """``rows`` in order of time; ``mode`` names the levels that answered, ``notes`` what a reader should know, ``errors`` what failed."""

    plan: QueryPlan
    rows: DataFrame | None
    mode: str
    totals: dict[str, int] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


@dataclass
class Corpus:
    """What is searched: records, and vectors of them if there are any; rows not yet indexed, if any; an index of words, if there is one."""

    records: DataFrame
    vectors: DataFrame | None = None
    fresh: DataFrame | None = None
    embedder: Embedder | None = None
    index: s.WordIndex | None = None


def nearest(corpus: Corpus, text: str, k: int) -> DataFrame | None:
    """The ``k`` records whose vectors are nearest, with ``distance`` and ``rank``."""
    if corpus.vectors is None or corpus.embedder is None:
        return None
    e = corpus.embedder
    vector = e.encode([e.q_prefix + text[:2000]])[0].tolist()
    keyed = corpus.vectors.withColumn("_k", F.struct(*s.KEY))
    hits = knn(keyed, vector, k, "_k").select("_k.*", "distance")
    return fusion.rank(corpus.records.join(F.broadcast(hits), s.KEY), "distance", *s.KEY)  # k rows


def recall(corpus: Corpus, text: str, config: Config, now: datetime, limit: int = 6, actor: str | None = None, around: int = 0, exact_only: bool = False, recency: bool = True, tail: bool = True) -> RecallResult:
    """The router. A date means search in time, with neighbours by meaning if next to nothing is there; else words and meaning are fused."""
    today = now.replace(tzinfo=UTC).astimezone(ZoneInfo(config.timezone)).date()
    plan = parse(text, today, config.timezone, corrections(config), words_of=vocabulary(config))
    result = RecallResult(plan, None, "", notes=list(config.warnings))
    if plan.widened:
        result.notes.append("asked for an occurrence: all dates searched")
    try:
        if plan.days or plan.hours:
            _in_time(corpus, result, limit, actor, around, exact_only)
        else:
            _by_words(corpus, result, config, now, limit, actor, around, exact_only, recency)
        if tail and corpus.fresh is not None and plan.keywords:
            more = s.live_tail(corpus.fresh, [w for g in plan.keywords for w in g], result.rows)
            result.rows = result.rows.unionByName(more.drop("n_match"), allowMissingColumns=True)
    except Exception as e:  # said in the result, so that it never looks like no hits
        result.errors.append(f"{type(e).__name__}: {str(e).splitlines()[0][:200]}")
    return result


def _in_time(corpus: Corpus, result: RecallResult, limit: int, actor: str | None, around: int, exact_only: bool) -> None:
    plan = result.plan
    rows = s.search_time(corpus.records, plan, actor)
    totals = s.range_totals(corpus.records, plan, actor).first()
    result.totals = totals.asDict()
    level = "L0" if not plan.keywords else "L1" if totals.kw_total >= s.ENOUGH else "L2"
    result.mode = level
    if level == "L2":
        result.notes.append(f"{totals.kw_total} with all words: the whole range is shown")
    if plan.hours and plan.days is None:
        result.notes.append("no day named: the last day with rows at these hours")
    if around:
        rows = s.with_context(corpus.records, rows, around).drop("is_hit")
    if totals.total < s.ENOUGH and not exact_only:
        near = nearest(corpus, plan.text, limit)
        if near is not None:
            rows = rows.drop("level").unionByName(near.drop("distance", "rank"), allowMissingColumns=True)
            result.mode += "+L3"
            result.notes.append("next to nothing in the range: rows of like meaning from any time added")
    result.rows = s.dedupe(rows, ["src", "line_no"])


def _by_words(corpus: Corpus, result: RecallResult, config: Config, now: datetime, limit: int, actor: str | None, around: int, exact_only: bool, recency: bool) -> None:
    plan, fan = result.plan, max(limit, 8)
    hits = s.search(corpus.records, plan, max(fan, 4) if around else fan, actor, index=corpus.index)
    result.mode = "words"
    near = None if actor or exact_only else nearest(corpus, plan.text, fan)
    if near is not None:
        best = near.agg(F.min("distance")).first()[0]
        if best is None or best > corpus.embedder.near:
            synonyms = read_json(f"{config.data_dir}/query_synonyms.json")
            for variant in query_variants(plan.text, synonyms if isinstance(synonyms, dict) else {}):
                more = s.search(corpus.records, replace(parse(variant, plan.today, plan.tz), days=None, hours=None), fan, actor)
                hits = s.dedupe(hits.unionByName(more, allowMissingColumns=True), ["stage", "src", "line_no"])
        exact = fusion.without_echo(fusion.rank(hits, F.col("negative"), F.col("score").desc(), *s.KEY), plan.text, now)
        result.rows = fusion.fuse(exact, fusion.without_echo(near, plan.text, now), now, 2 * limit, corpus.embedder.near, corpus.embedder.far, recency)
        result.mode = "words+meaning"
        return
    if around:
        hits = s.with_context(corpus.records, hits, around)
    result.rows = s.dedupe(hits, ["src", "line_no"])


def tag(row: object, config: Config) -> str:
    kind = row["type"] if "type" in row.__fields__ else None
    who = row["actor"] or ("user" if "role" in row.__fields__ and row["role"] == "user" else config.ai_name)
    return f"{who}/{kind}" if kind in ("action", "doc", "thinking") else who


def format_lines(result: RecallResult, config: Config, now: datetime, full: bool = False) -> list[str]:
    """Lines to read: now, what was searched, each row in order of time, and whatever a reader must know."""
    return list(lines_of(result, config, now, full))


def lines_of(result: RecallResult, config: Config, now: datetime, full: bool = False) -> Iterator[str]:
    """The lines of :func:`format_lines` one by one: rows come to the driver a partition at a time, however many there are."""
    zone = ZoneInfo(config.timezone)
    local = lambda t: t.replace(tzinfo=UTC).astimezone(zone).strftime("%Y-%m-%d %H:%M") if t else "---- -- --:--"
    yield f"[NOW] {local(now)}"
    if result.errors:
        yield from (f"search failed: {e}" for e in result.errors)
        return
    plan = result.plan
    if plan.days:
        shown = result.rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
        first, last = plan.days
        head = f"{first}" if first == last else f"{first} to {last}"
        yield f"{head}{' %d-%dh' % plan.hours if plan.hours else ''}: {result.totals.get('total', shown.n)} rows, {result.totals.get('kw_total', 0)} with all words, {shown.chars} characters shown"
        if first > plan.today:
            yield "this range lies in the future"
    yield from (f"({n})" for n in result.notes)
    days: dict[str, int] = {}
    for r in result.rows.orderBy(F.col("ts").asc_nulls_first(), *s.KEY).toLocalIterator(prefetchPartitions=True):
        text = " ".join((r.text or "").split("\n"))
        sure = "[maybe] " if "confirm" in r.__fields__ and r["confirm"] else ""
        when = local(r.ts)
        days[when[:10]] = days.get(when[:10], 0) + 1
        yield f"[{when}] {sure}{tag(r, config)}: {text if full or len(text) <= DISPLAY_CHARS else text[:DISPLAY_CHARS] + '…'}"
    if len(days) > 1:
        yield "days: " + ", ".join(f"{d} ({n})" for d, n in sorted(days.items()))
    if not days:
        yield "no rows"


def compacted(records: DataFrame, session: str, n: int) -> DataFrame:
    """Rows of the n-th stretch before a compaction of a session, of all sessions in that time."""
    span = s.compaction_ranges(records.where(F.col("session") == session)).where(F.col("n") == n).select(F.struct("start", "end").alias("r"))
    one = span.scalar()
    return s.searchable(records, docs=False).where((F.col("ts") >= one["start"]) & (F.col("ts") <= one["end"]))


def main(args: Sequence[str] | None = None) -> int:
    """``python -m kairolog.plans.recall QUERY --records PATH``"""
    from kairolog.session import local_session

    p = argparse.ArgumentParser(description="Recalls what was said, by time and words.")
    p.add_argument("query", nargs="*")
    p.add_argument("--records", required=True, help="Parquet table of records")
    p.add_argument("--user", action="store_true")
    p.add_argument("--ai", action="store_true")
    p.add_argument("--around", type=int, nargs="?", const=1, default=0)
    p.add_argument("--full", action="store_true")
    p.add_argument("--all-time", action="store_true", help="no weight for recency")
    p.add_argument("--compact", type=int, default=0)
    p.add_argument("--session")
    p.add_argument("--today", type=date.fromisoformat)
    a = p.parse_args(args)
    config, spark = load(), local_session()
    records = spark.read.parquet(a.records)
    now = datetime.combine(a.today, datetime.max.time().replace(microsecond=0)) if a.today else datetime.now(UTC).replace(tzinfo=None)
    if a.compact:
        session = a.session or s.last_session(records).first()[0]
        result = RecallResult(parse("", now.date(), config.timezone), compacted(records, session, a.compact), "compact")
    else:
        actor = config.user_name if a.user else config.ai_name if a.ai else None
        result = recall(Corpus(records), " ".join(a.query), config, now, actor=actor, around=a.around, recency=not a.all_time)
    for line in lines_of(result, config, now, a.full):
        print(line)
    return 1 if result.errors else 0


if __name__ == "__main__":
    sys.exit(main())
