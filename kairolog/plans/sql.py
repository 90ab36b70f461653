"""For users of SQL: the time grammar as a table function, the tests of texts as plain functions.

    SELECT * FROM time_query('yesterday evening about the budget', '2026-09-24', 'Asia/Tokyo')
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kairolog.functions.grammar import parse

FIELDS = "first_day string, last_day string, utc_from timestamp_ntz, utc_to timestamp_ntz, hour_from int, hour_to int, keywords array<string>"


@F.udtf(returnType=FIELDS)
class TimeQuery:
    """One row: what a query text asks for, as `kairolog.functions.grammar.parse` reads it."""

    def eval(self, text: str, today: str, tz: str) -> Iterator[tuple]:
        plan = parse(text or "", date.fromisoformat(today), tz)
        first, last = plan.days or (None, None)
        lo, hi = plan.utc or (None, None)
        a, b = plan.hours or (None, None)
        yield str(first) if first else None, str(last) if last else None, lo, hi, a, b, [g[0] for g in plan.keywords]


def register(spark: SparkSession) -> None:
    """Makes ``time_query`` known to SQL."""
    spark.udtf.register("time_query", TimeQuery)
