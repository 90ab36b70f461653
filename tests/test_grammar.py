"""Time phrases and keywords."""

from datetime import date, datetime

import pytest

from kairolog.functions import textprep
from kairolog.functions.grammar import parse, read_days, read_hours

TODAY = date(2026, 9, 24)


def days(text, today=TODAY):
    return read_days(text, today)


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("yesterday", "2026-09-23"), ("yesterday's notes", "2026-09-23"), ("the day before yesterday", "2026-09-22"), ("today", "2026-09-24"), ("tonight", "2026-09-24"), ("this morning", "2026-09-24"),
        ("last night", "2026-09-23"), ("3 days ago", "2026-09-21"), ("a day ago", "2026-09-23"), ("two days ago", "2026-09-22"), ("July 19", "2026-07-19"), ("jul. 19th", "2026-07-19"), ("19th of July", "2026-07-19"),
        ("2026-09-02 budget", "2026-09-02"), ("2026/9/2", "2026-09-02"), ("9/2", "2026-09-02"), ("昨日の予算", "2026-09-23"), ("3日前", "2026-09-21"), ("おととい", "2026-09-22"), ("7月19日", "2026-07-19"), ("2025年7月19日", "2025-07-19"), ("今朝", "2026-09-24"),
    ],
)
def test_single_days(text, day):
    assert days(text) == (date.fromisoformat(day),) * 2


@pytest.mark.parametrize(
    ("text", "first", "last"),
    [
        ("last week", "2026-09-17", "2026-09-23"), ("2 weeks ago", "2026-09-07", "2026-09-13"), ("last month", "2026-08-01", "2026-08-31"), ("a month ago", "2026-08-01", "2026-08-31"), ("the month before last", "2026-07-01", "2026-07-31"),
        ("in July", "2026-07-01", "2026-07-31"), ("in October", "2025-10-01", "2025-10-31"), ("last year", "2025-01-01", "2025-12-31"), ("year before last", "2024-01-01", "2024-12-31"), ("12 months ago", "2025-09-01", "2025-09-30"),
        ("10月", "2025-10-01", "2025-10-31"), ("2025年7月", "2025-07-01", "2025-07-31"), ("2年前", "2024-01-01", "2024-12-31"), ("先々月", "2026-07-01", "2026-07-31"), ("3ヶ月前", "2026-06-01", "2026-06-30"), ("1週間前", "2026-09-14", "2026-09-20"),
    ],
)
def test_ranges(text, first, last):
    assert days(text) == (date.fromisoformat(first), date.fromisoformat(last))


@pytest.mark.parametrize("text", ["may I ask", "march on", "good morning", "the budget", "", "9999 years ago", "99/99", "2026-02-30"])
def test_no_date(text):
    assert days(text) is None


@pytest.mark.parametrize(
    ("text", "hours"),
    [("in the morning", (5, 11)), ("early morning", (4, 7)), ("evening", (17, 21)), ("late at night", (22, 24)), ("at 3pm", (15, 16)), ("around 3 p.m.", (14, 17)), ("12 am", (0, 1)), ("9:30 am", (9, 10)), ("午後3時", (3, 4)), ("3時頃", (2, 5)), ("夕方", (16, 19)), ("3時間", None), ("good night", None), ("overnight", None), ("夕食", None), ("夜勤の朝", (5, 11)), ("13 pm", None)],
)
def test_hours(text, hours):
    assert read_hours(text) == hours


def test_plan_of_a_whole_query():
    p = parse("what did we say yesterday evening about the budget", TODAY, "America/New_York")
    assert (p.days, p.hours, p.keywords) == ((date(2026, 9, 23),) * 2, (17, 21), (("budget",),))
    assert p.utc == (datetime(2026, 9, 23, 4), datetime(2026, 9, 24, 4))


def test_occurrence_widens():
    p = parse("the first time we talked about the budget last week", TODAY)
    assert p.days is None and p.widened and p.keywords == (("budget",),)


def test_tokyo_starts_at_three_in_the_afternoon():
    assert parse("昨日の予算", TODAY, "Asia/Tokyo").utc[0] == datetime(2026, 9, 22, 15)


def test_compounds_survive_masking():
    assert parse("昨日の夜、夕食の話", TODAY).keywords == (("夕食",),)


def test_corrections_form_groups():
    assert parse("budjet plan", TODAY, corrections={"budjet": "budget"}).keywords == (("budjet", "budget"), ("plan",))


def test_strip_and_keywords():
    assert textprep.strip_query("えっと、予算だっけ？") == "、予算"
    assert textprep.strip_query("まあ") == "まあ"
    assert textprep.keywords("日に 眠い サーバー budget-2 the a") == ["眠い", "サーバー", "budget-2"]
    assert len(textprep.keywords("aa bb cc dd ee ff gg")) == 5
    assert textprep.echo_windows("short") == [] and textprep.echo_windows("abcdefghijkl") == ["abcdefghijkl"]
    assert textprep.echo_windows("x" * 15 + "y" * 16)[-1] == "x" * 4 + "y" * 16
