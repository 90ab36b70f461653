"""Sessions, the ledger, manifests: against plain versions, and their odd cases."""

import hashlib
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from kairolog.operators import ledger, manifest, sessions

META = "rowid long, ts string, actor string, text string, session string, src_day string, line_no int"


def test_sessions_against_a_plain_version(spark):
    random.seed(3)
    rows = [(i, random.choice("abc") if random.random() < 0.9 else None, random.choice([None, *[random.randrange(0, 400) * 60_000_000] * 9])) for i in range(600)]
    got = {tuple(r) for r in sessions.sessionize(spark.createDataFrame(rows, "i int, k string, us long"), "k", "us", 1_800_000_000).select("k", "start_us", "end_us", "duration_us", "n_rows").collect()}
    expected = set()
    for k in "abc":
        times, run = sorted(u for _, x, u in rows if x == k and u is not None), []
        for t in [*times, 1 << 60]:
            if run and t - run[-1] > 1_800_000_000:
                expected.add((k, run[0], run[-1], run[-1] - run[0], len(run)))
                run = []
            run.append(t)
    assert got == expected


def test_sessions_exactly_one_gap_apart_belong_together(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1_800_000_000), ("a", 3_600_000_001)], "k string, us long")
    assert sorted((r.start_us, r.n_rows) for r in sessions.sessionize(df, "k", "us", 1_800_000_000).collect()) == [(0, 2), (3_600_000_001, 1)]
    assert sessions.sessionize(df.limit(0), "k", "us", 1_800_000_000).count() == 0


def test_actor_sessions_count_repeats_once_and_skip_what_cannot_be_read(spark):
    rows = [(1, "2026-01-01T00:00:00", " Ann ", "x", "s", "d", 0), (2, "2026-01-01T00:00:00", " Ann ", "x", "s", "d", 0), (3, "2026-01-01T01:10:00+01:00", "ANN", "y", None, "d", 1), (4, None, "ann", "z", "s", "d", 2), (5, "n/a", "ann", "z", "s", "d", 3), (6, "2026-01-01T00:00:00", None, "z", "s", "d", 4), (7, "2026-01-01T00:00:01Z", "ann", None, None, None, None)]
    got = sessions.actor_sessions(spark.createDataFrame(rows, META)).collect()
    assert [(r.actor, r.duration_us, r.n_rows) for r in got] == [("ann", 600_000_000, 3)]


def _sig(texts):
    return hashlib.sha1("".join(texts).encode()).hexdigest()[:16]


def test_remaining_lines(spark):
    files = {f"main/{c}": [f"{c}{i}é" for i in range(6)] for c in "abcdefg"}
    files["home/a"] = ["x", None, "z"]
    lines = [(d, i, t) for d, ts in files.items() for i, t in enumerate(ts)] + [("main/a", 2, "a2é")]
    meta = spark.createDataFrame(lines, "src_day string, line_no int, text string")
    runs = spark.createDataFrame([(1, "ok", datetime(2026, 1, 1)), (2, "failed", datetime(2026, 1, 2)), (3, " OK ", datetime(2026, 1, 3)), (4, "ok", None), (5, None, datetime(2026, 1, 5))], "run_id int, status string, finished_at timestamp_ntz")
    a, b, c, d, e, f = (files[f"main/{x}"] for x in "abcdef")
    days = [("main/a", 2, _sig(a[:2]), 1), ("main/a", 4, _sig(a[:4]), 3), ("main/a", 4, _sig(a[:4]), 3), ("main/a", 6, _sig(a), 4), ("main/b", 3, "0" * 16, 3), ("main/c", 9, _sig(c), 3), ("main/d", 3, None, 3), ("main/e", 6, _sig(e), 3), ("main/f", 2, _sig(f[:2]), 2), ("gone/x", 2, "y", 3), ("home/a", 2, _sig(["x", ""]), 1)]
    srcs = [("main/a", 5, _sig([a[4]]), 3), ("main/b", 0, "", 3), ("corpus/home/a", 2, _sig([""]), 3)]
    schema = "string, {} int, sig string, run_id int"
    got = ledger.remaining_lines(meta, spark.createDataFrame(days, "day " + schema.format("done_lines")), spark.createDataFrame(srcs, "src " + schema.format("nlines")), runs)
    start = {(r.side, r.src_day): (r.lo, r.n) for r in got.groupBy("side", "src_day").agg(F.min("line_no").alias("lo"), F.count("*").alias("n")).collect()}
    assert got.count() == got.distinct().count()
    assert start.get(("day", "main/a")) == (4, 2) and start.get(("src", "main/a")) == (5, 1)
    assert start.get(("day", "home/a")) == (2, 1) and start.get(("src", "home/a")) == (2, 1)
    assert ("day", "main/e") not in start and all(start[("day", f"main/{x}")] == (0, 6) for x in "bcdfg")
    empty = ledger.remaining_lines(meta.limit(0), spark.createDataFrame(days, "day " + schema.format("done_lines")), spark.createDataFrame(srcs, "src " + schema.format("nlines")), runs)
    assert empty.count() == 0


def test_ledger_leases_expire_and_stale_writers_are_rejected(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/book", lease_seconds=600)
    at = lambda minutes: F.lit(datetime(2026, 1, 1) + timedelta(minutes=minutes)).cast("timestamp")
    states = lambda m: {r.item: r.state for r in book.state(at(m)).collect()}
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item string")
    book.add(items, at(0))
    book.add(items, at(0))
    assert states(0) == dict.fromkeys("abc", "pending")
    assert {r.item for r in book.lease(1, at(1), most=2).collect()} == {"a", "b"}
    assert states(5) == {"a": "leased", "b": "leased", "c": "pending"}
    book.complete(items.where("item = 'a'"), 1, at(6))
    assert states(20) == {"a": "done", "b": "pending", "c": "pending"}
    assert {r.item for r in book.lease(2, at(20)).collect()} == {"b", "c"}
    book.complete(items.where("item = 'b'"), 1, at(21))  # the writer of token 1 was given up
    assert states(22) == {"a": "done", "b": "leased", "c": "leased"}
    for _ in range(2):  # a retry changes nothing
        book.complete(items.where("item <> 'a'"), 2, at(23))
    assert states(99) == dict.fromkeys("abc", "done")
    paths = {r.item: r.detail for r in book.state(at(99)).collect()}
    assert paths["b"].endswith("/2") and paths["a"].endswith("/1") and book.lease(3, at(99)).count() == 0


def test_incremental_index_is_a_full_build(spark):
    random.seed(5)
    schema = "src string, line_no int, line string"
    for _ in range(4):
        before = {f"s{i}": [str(random.random()) for _ in range(random.randrange(1, 6))] for i in range(6)}
        after = {}
        for s, ls in before.items():
            what = random.choice(["same", "append", "truncate", "edit", "gone"])
            after[s] = {"same": ls, "append": [*ls, "new"], "truncate": ls[:-1], "edit": ["edited", *ls[1:]], "gone": []}[what]
        after["s9"] = ["fresh"]
        frame = lambda d: spark.createDataFrame([(s, i, x) for s, ls in d.items() for i, x in enumerate(ls)], schema)
        old, new = frame(before), frame(after)
        changes = manifest.classify(new, manifest.snapshot(old))
        status = {r.src: r.status for r in changes.collect()}
        assert status["s9"] == "new" and set(status) == set(before) | {"s9"}
        out = manifest.apply_changes(old, new, changes, random.choice([0, 1]))
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, new.collect()))


def test_damaged_and_versions(spark, tmp_path):
    lines = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "src string, line_no int, line string")
    index = spark.createDataFrame([("a", 0), ("a", 0), ("b", 0), ("c", 0)], "src string, line_no int")
    assert {r.src for r in manifest.damaged(index, manifest.snapshot(lines)).collect()} == {"a", "c"}
    v = manifest.Versions(spark, f"file://{tmp_path}/v")
    assert v.read() is None
    v.publish(lines, "one")
    v.publish(lines.where("src = 'b'"), "two")
    assert v.current() == "two" and v.read().count() == 1


def test_ledger_refuses_stale_tokens_and_survives_compaction(spark, tmp_path):
    import pytest

    book = ledger.Ledger(spark, f"file://{tmp_path}/book", lease_seconds=600)
    at = lambda minutes: F.lit(datetime(2026, 1, 1) + timedelta(minutes=minutes)).cast("timestamp")
    view = lambda m: sorted(tuple(r) for r in book.state(at(m)).select("item", "state", "token").collect())
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,)], "item string")
    book.add(items, at(0))
    assert {r.item for r in book.lease(5, at(1)).collect()} == {"a", "b", "c"}
    for token in (4, 5):
        with pytest.raises(ledger.StaleToken):
            book.lease(token, at(2))
    assert book.lease(6, at(3)).count() == 0  # nothing is pending
    book.complete(items.where("item = 'a'"), 5, at(4))
    book.fail(items.where("item = 'b'"), 5, at(4))
    assert view(5) == [("a", "done", 5), ("b", "pending", 0), ("c", "leased", 5)]
    before = book.events().count()
    book.compact("one")
    assert view(5) == [("a", "done", 5), ("b", "pending", 0), ("c", "leased", 5)] and book.events().count() <= before and not book._files()
    assert {r.item for r in book.lease(7, at(20)).collect()} == {"b", "c"}  # the lease of c ran out
    book.complete(items, 5, at(21))  # a stale writer
    book.complete(items.where("item = 'c'"), 7, at(22))
    book.compact("two")
    assert view(23) == [("a", "done", 5), ("b", "leased", 7), ("c", "done", 7)]
    assert book.events().count() == 8  # three items added, three leases and two completions that count
    done = [r.detail for r in book.state(at(23)).where("item = 'c'").collect()]
    assert done[0].startswith(f"file://{tmp_path}/book/data/") and done[0].endswith("/7")


def test_progress_of_failed_runs_does_not_count(spark):
    lines = spark.createDataFrame([("main/x", i, f"t{i}") for i in range(8)], "src_day string, line_no int, text string")
    days = spark.createDataFrame([("main/x", 3, _sig(["t0", "t1", "t2"]), 1), ("main/x", 5, _sig([f"t{i}" for i in range(5)]), 2), ("main/x", 3, _sig(["t0", "t1", "t2"]), 1), ("main/x", 7, "x", None)], "day string, done_lines int, sig string, run_id int")
    runs = spark.createDataFrame([(1, datetime(2026, 1, 1), datetime(2026, 1, 9), "ok"), (2, datetime(2026, 1, 2), None, None)], "run_id int, started_at timestamp_ntz, finished_at timestamp_ntz, status string")
    srcs = spark.createDataFrame([], "src string, nlines int, sig string, run_id int")
    got = ledger.remaining_lines(lines, days, srcs, runs)
    assert sorted((r.side, r.line_no) for r in got.collect()) == [*(("day", i) for i in range(3, 8)), *(("src", i) for i in range(8))]


def test_stream_and_batch_join_events_exactly_one_gap_apart(spark, tmp_path):
    rows = [("a", datetime(2026, 1, 1, 0)), ("a", datetime(2026, 1, 1, 2)), ("a", datetime(2026, 1, 1, 4, 0, 1)), ("b", datetime(2026, 1, 1))]
    spark.createDataFrame(rows, "k string, at timestamp").write.parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema("k string, at timestamp").parquet(f"file://{tmp_path}/in")
    out = f"file://{tmp_path}/out"
    run = sessions.session_stream(source, "k", "at", "2 hours", "1 hour").writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r.k, r.n_rows) for r in spark.read.parquet(out).collect()) == [("a", 1), ("a", 2), ("b", 1)]
