"""Instants of mixed notations, against the standard library."""

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kairolog.operators import timestamps as t

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def us(when: datetime) -> int:
    return (when - EPOCH) // timedelta(microseconds=1)


def instants(spark, rows):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, ts string, zone string")
    return [r.utc_us for r in t.with_instant(df, "ts", df.zone).orderBy("i").collect()]


CASES = [
    ("2026-05-10T19:24:38Z", None, "2026-05-10T19:24:38+00:00"), ("2025-12-10T15:50:15+05:30", None, "2025-12-10T15:50:15+05:30"), ("2026-09-15t17:20:27z", None, "2026-09-15T17:20:27+00:00"), ("2026-09-15T14:24:25−03:00", None, "2026-09-15T14:24:25-03:00"),
    ("1788920886664", None, "2026-09-09T02:28:06.664+00:00"), ("1762066587", None, "2025-11-02T06:56:27+00:00"), ("20251231T001934+0900", None, "2025-12-31T00:19:34+09:00"), ("2026-01-02T07:03:14+09:00[Asia/Tokyo]", None, "2026-01-02T07:03:14+09:00"),
    ("2026-06-16 08:01:36 CEST", None, "2026-06-16T08:01:36+02:00"), ("2026年4月24日 午前9時50分57秒", "Asia/Tokyo", "2026-04-24T09:50:57+09:00"), ("2025年12月2日 午後0時36分21秒", None, "2025-12-02T12:36:21+00:00"), ("Feb 4, 2026 12:28:46 AM", None, "2026-02-04T00:28:46+00:00"),
    ("Wed, 04 Mar 2026 23:35:13 +0100", None, "2026-03-04T23:35:13+01:00"), ("21 December 2025 01:16:26 UTC+5:45", None, "2025-12-21T01:16:26+05:45"), ("2026-03-08 01:45:00,657", "america/new_york", "2026-03-08T01:45:00.657-05:00"), ("2025-11-14T18:06:53.419778453+00:00", None, "2025-11-14T18:06:53.419778+00:00"),
    ("\t2026-08-25T05:08:20 \n", " US/Pacific ", "2026-08-25T05:08:20-07:00"), ("2026-08-25 05:08", "Moon/Base_1", "2026-08-25T05:08:00+00:00"), ("2026-08-25 05:08", "  ", "2026-08-25T05:08:00+00:00"), ("2026-08-25T05:08:20[Europe/Berlin]", None, "2026-08-25T05:08:20+02:00"),
]


def test_notations(spark):
    assert instants(spark, [(a, z) for a, z, _ in CASES]) == [us(datetime.fromisoformat(e)) for *_, e in CASES]


@pytest.mark.parametrize("text", [None, "", "  ", "soon", "yesterday 9pm", "11:42", "2026-05-14", "2026-13-05 11:00:00", "2026-02-30T10:00:00Z", "2026-04-11T25:61:00Z", "2026-01-01 13:00 PM", "2026-01-01 10:00:00 XYZ", "x" * 100_000])
def test_no_instant(spark, text):
    assert instants(spark, [(text, "Asia/Tokyo")]) == [None]


def test_plain_numbers_of_any_length(spark):
    rows = [("86400", 86_400_000_000), ("0", 0), ("7", 7_000_000), ("-5", -5_000_000), ("-1.5", -1_500_000), ("86400.25", 86_400_250_000), ("1726000000123.5", 1_726_000_000_123_500), ("1726000000.1234567", 1_726_000_000_123_456), ("1726000000123456.9", 1_726_000_000_123_456), ("1726000000123456789.5", 1_726_000_000_123_456), ("1726000000123", 1_726_000_000_123_000), ("1726000000123456999", 1_726_000_000_123_456), ("-100000000000001001", -100_000_000_000_002), ("9223372036854775807", 9_223_372_036_854_775), ("-1726000000", -1_726_000_000_000_000), ("9" * 25, None), ("1.", None), (".5", None), ("12:", None)]
    assert instants(spark, [(a, "Asia/Tokyo") for a, _ in rows]) == [e for _, e in rows]


def test_clock_changes(spark):
    rows = [("2026-03-29 02:30:00", "Europe/Berlin"), ("2025-10-26 02:30:00", "Europe/Berlin"), ("2026-10-04 02:15:00", "Australia/Lord_Howe"), ("2026-04-05 01:45:00", "Australia/Lord_Howe")]
    expected = [datetime.fromisoformat(s).replace(tzinfo=ZoneInfo(z), fold=0) for s, z in rows]
    assert instants(spark, rows) == [us(e.astimezone(UTC)) for e in expected]


def test_other_columns_are_kept(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:00", 1, "x", 2, 3)], "ts string, _zone_id int, `a.b` string, utc_us int, _n int")
    out = t.with_instant(df, "ts")
    assert out.columns == ["ts", "_zone_id", "a.b", "_n", "utc_us"] and out.first()[1:4] == (1, "x", 3)
    assert t.with_instant(df.limit(0), "ts").count() == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.datetimes(datetime(1980, 1, 1), datetime(2035, 1, 1)), st.sampled_from(["UTC", "Europe/Berlin", "America/Sao_Paulo", "Asia/Kathmandu", "Australia/Lord_Howe"])), min_size=1, max_size=30))
def test_wall_clocks_as_the_standard_library(spark, rows):
    got = instants(spark, [(w.isoformat(sep=" "), z) for w, z in rows])
    assert got == [us(w.replace(tzinfo=ZoneInfo(z), fold=0).astimezone(UTC)) for w, z in rows]


def test_zone_is_estimated_from_neighbours(spark):
    zone, rows = ZoneInfo("America/New_York"), []
    for i in range(40):
        at = datetime(2026, 3, 7, 12, tzinfo=UTC) + timedelta(minutes=37 * i)
        rows.append((1, "f", i, at.astimezone(zone).replace(tzinfo=None).isoformat(sep=" ") if i % 2 else at.isoformat()))
    df = t.with_parts(spark.createDataFrame(rows, "cfg int, file string, line int, ts string"), "ts")
    df = df.selectExpr("cfg", "file", "line", "case when known_us is null then wall end as wall", "known_us")
    best = t.estimate_zones(df, "cfg", "wall", "known_us", "file", "line", ["UTC", "America/Phoenix", "America/Chicago", "America/New_York", "Europe/Berlin"]).collect()
    assert [(r.cfg, r.zone, r.n, r.violations) for r in best] == [(1, "America/New_York", 20, 0)]


def test_any_region_can_be_estimated(spark):
    all_ = t.regions(("UTC", "Europe/Berlin", "Asia/Tokyo"))
    assert all_[:3] == ["UTC", "Europe/Berlin", "Asia/Tokyo"] and not {"Europe/Paris", "Asia/Seoul"} & set(all_)
    rows = []
    for cfg, zone in enumerate(["America/Halifax", "Asia/Tehran"]):
        for i in range(240):
            at = datetime(2026, 3, 7, 12, tzinfo=UTC) + timedelta(minutes=10 * i)
            rows.append((cfg, str(cfg), i, at.astimezone(ZoneInfo(zone)).replace(tzinfo=None).isoformat(sep=" ") if i % 2 else at.isoformat()))
    df = t.with_parts(spark.createDataFrame(rows, "cfg int, file string, line int, ts string"), "ts")
    df = df.selectExpr("cfg", "file", "line", "case when known_us is null then wall end as wall", "known_us")
    best = {r.cfg: r for r in t.estimate_zones(df, "cfg", "wall", "known_us", "file", "line", all_).collect()}
    at = lambda z, m: datetime(2026, m, 8, 12, tzinfo=UTC).astimezone(ZoneInfo(z)).utcoffset()
    assert [best[i].violations for i in (0, 1)] == [0, 0]
    assert at(best[0].zone, 3) == at("America/Halifax", 3) and at(best[1].zone, 3) == at("Asia/Tehran", 3)


def test_a_missing_zone_is_estimated_and_used(spark):
    """A configuration without zone whose logs contradict UTC gets the zone they speak for; one that agrees with UTC stays there."""
    rows, truth = [], {}
    for cfg, zone in ((1, "America/New_York"), (2, "UTC"), (3, "Asia/Tokyo"), (4, "America/New_York")):
        for i in range(80):
            at = datetime(2026, 3, 7, 12, tzinfo=UTC) + timedelta(minutes=37 * i)
            rows.append((100 * cfg + i, f"f{cfg}", i, at.astimezone(ZoneInfo(zone)).replace(tzinfo=None).isoformat(sep=" ") if i % 2 else at.isoformat(), cfg if cfg < 4 else None))
            truth[100 * cfg + i] = int(at.timestamp()) * 1_000_000
    log = spark.createDataFrame(rows, "log_id long, src_file string, line_no int, ts string, cfg_id int")
    configs = spark.createDataFrame([(1, None), (2, " "), (3, "asia/tokyo ")], "cfg_id int, timezone string")
    got = {r.log_id: r.utc_us for r in t.log_instants(log, configs).collect()}
    assert all(got[k] == truth[k] for k in truth if k < 400)
    assert [got[400 + i] == truth[400 + i] for i in (0, 1)] == [True, False]  # without configuration: UTC


def test_long_sequences_are_aligned_in_blocks(spark):
    zone, rows = ZoneInfo("Asia/Tokyo"), []
    for i in range(200):
        at = datetime(2026, 3, 7, 12, tzinfo=UTC) + timedelta(minutes=7 * i)
        rows.append((1, "f", i, None if i % 9 == 0 else at.astimezone(zone).replace(tzinfo=None), int(at.timestamp()) * 1_000_000 if i % 9 == 0 else None))
    df = spark.createDataFrame([*rows, (1, None, 3, datetime(2026, 1, 1), None)], "cfg int, file string, line int, wall timestamp_ntz, known_us long")
    some = [tuple(r) for b in (1, 4, 4096) for r in t.estimate_zones(df, "cfg", "wall", "known_us", "file", "line", ["UTC", "Asia/Tokyo", "Europe/Berlin"], block=b).collect()]
    assert len(set(some)) == 1 and some[0][:4] == (1, "Asia/Tokyo", 177, 0) and some[0][4] > 150
