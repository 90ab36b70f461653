"""Sources, search, state, streams and recall on small fixtures."""

import json
import sqlite3
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairolog.config import Config, corrections, load
from kairolog.functions import grams, semantic
from kairolog.functions.grammar import parse
from kairolog.operators import fuse, search, sessions, state
from kairolog.plans import recall as r
from kairolog.session import cut
from kairolog.sources import growing, records
from kairolog.streaming import blocks, daemon

TALK = [
    ("2026-09-01T09:00:00+00:00", "user", "Good morning, where is the invoice for the printing order?"), ("2026-09-01T09:01:00+00:00", "assistant", "The budget has it."), ("2026-09-01T09:02:00+00:00", "user", "ok"),
    ("2026-09-02T10:00:00+00:00", "user", "The budget is too small"), ("2026-09-02T10:05:00+00:00", "assistant", "A budget of 300 then"), ("2026-09-02T23:30:00+00:00", "user", "Decided: the budget is 400"),
    ("2026-09-03T08:00:00+00:00", "user", "<local-command-caveat>x\ny</local-command-caveat> printing?"), ("2026-09-03T08:01:00+00:00", "system", "This session is being continued from another"), ("2026-09-03T08:02:00Z", "assistant", "printing is done"),
]
CONFIG = Config(user_name="Sam", ai_name="Nova", model_name="m", timezone="America/New_York")


@pytest.fixture(scope="module")
def talk(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    lines = [json.dumps({"ts": a, "role": b, "text": c}) for a, b, c in TALK]
    (folder / "chat-1.jsonl").write_text("\n".join([*lines[:4], "", "{broken", '{"ts": "2026-09-02T10:00:00Z", "text": "  "}', '{"role": "user", "text": "no time"}', *lines[4:]]) + "\n")
    return cut(records.parse_plain(records.read_lines(spark, str(folder)), CONFIG))


def test_plain_log(talk):
    rows = talk.orderBy("line_no").collect()
    assert len(rows) == 9 and [x.line_no for x in rows] == [0, 1, 2, 3, 8, 9, 10, 11, 12]
    assert rows[0].session == "chat-1" and rows[0].actor == "Sam" and rows[0].model is None and rows[1].model == "m"
    assert rows[6].text == "printing?" and rows[7].type == "meta" and rows[7].role == "ai" and rows[0].ts == datetime(2026, 9, 1, 9)


def test_transcript(spark):
    def line(kind, content, **more):
        return json.dumps({"type": kind, "timestamp": "2026-09-01T09:00:00Z", "message": {"role": "x", "content": content}} | more)

    blocks_ = [{"type": "text", "text": "one"}, {"type": "tool_use", "name": "Bash", "input": {"n": 1, "cmd": " ls \"x\" ", "z": "no"}}, {"type": "tool_result", "content": "r"}, {"type": "text", "text": "two"}, {"type": "tool_use", "name": "", "input": {"n": {"deep": 1}}}]
    lines = [line("user", " hi "), line("assistant", blocks_), line("progress", "no"), '{"type":"user","timestamp":"2026-09-01T09:00:00Z","message":"str"}', line("user", "<command-name>x"), line("assistant", []), json.dumps({"type": "user", "message": {"content": "no time"}}), "junk", line("user", blocks_)]
    df = spark.createDataFrame([("a/s1.jsonl", i, x) for i, x in enumerate(lines)], "src_file string, line_no int, line string")
    rows = [(x.line_no, x.type, x.text, x.actor) for x in records.parse_transcript(df, CONFIG).orderBy("line_no", F.col("type").desc(), "text").collect()]
    assert rows == [(0, "text", "hi", "Sam"), (1, "text", "one\ntwo", "Nova"), (1, "action", 'Bash: ls "x"', "Nova"), (1, "action", "tool: ", "Nova"), (4, "meta", "<command-name>x", "Sam"), (8, "text", "one\ntwo", "Sam")]


def test_day_files(spark, talk, tmp_path):
    records.write_days(talk, str(tmp_path), "America/New_York")
    back = records.read_days_back(spark, str(tmp_path))
    assert {(x.src, x.n) for x in back.groupBy("src").agg(F.count("*").alias("n")).collect()} == {("main/2026-09-01", 3), ("main/2026-09-02", 3), ("main/2026-09-03", 3)}
    assert {x.text for x in back.collect()} == {x.text for x in talk.collect()}


def ask(talk, text, **more):
    return r.recall(r.Corpus(talk), text, CONFIG, datetime(2026, 9, 3, 16), **more)


def test_recall_in_time(talk):
    found = ask(talk, "2026-09-02 budget")
    assert found.mode == "L1" and found.totals["kw_total"] == 3 and found.rows.count() == 3
    lines = r.format_lines(found, CONFIG, datetime(2026, 9, 3, 16))
    assert lines[0] == "[NOW] 2026-09-03 12:00" and "[2026-09-02 06:00] Sam: The budget is too small" in lines and not any("printing" in x for x in lines)
    widened = ask(talk, "2026-09-01 invoice")
    assert widened.mode == "L2" and widened.rows.count() == 3 and "whole range" in widened.notes[0]
    assert ask(talk, "yesterday").rows.count() == 3 and ask(talk, "yesterday", actor="Sam").rows.count() == 2
    assert r.format_lines(ask(talk, "2030-01-01 budget"), CONFIG, datetime(2026, 9, 3, 16))[-1] == "no rows"
    assert ask(talk, "early morning").rows.count() == 2  # the last day with rows at these hours


def test_recall_by_words_and_errors(talk):
    found = ask(talk, "printing invoice")
    assert "invoice" in found.rows.first().text and not found.errors
    broken = r.recall(r.Corpus(talk.drop("text")), "printing", CONFIG, datetime(2026, 9, 3))
    assert broken.errors and r.format_lines(broken, CONFIG, datetime(2026, 9, 3))[1].startswith("search failed")


def test_recall_with_meaning_and_tail(spark, talk):
    e = semantic.HashedNgrams()
    e.near, e.far = 1.3, 1.5
    vectors = talk.select("src", "line_no", semantic.embed_column(F.col("text"), e).alias("embedding"))
    fresh = talk.limit(1).withColumns({"text": F.lit("a new line about the printing budget"), "ts_raw": F.lit("2026-09-03T15:00:00Z")})
    found = r.recall(r.Corpus(talk, vectors, fresh, e), "printing budget", CONFIG, datetime(2026, 9, 10))
    rows = found.rows.collect()
    assert found.mode == "words+meaning" and not found.errors and any(x.text.startswith("a new line") for x in rows) and len(rows) > 1


def test_bm25_is_that_of_sqlite(spark):
    texts = ["heating bill paid", "the bill, the bill!", "t. -- x", "Überweisung für die Heizung", "予算の話をした", "bill", "a", "--", "ill will", "tattoo attest"]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(b, tokenize='unicode61')")
    for i, x in enumerate(texts):
        s = "".join(x.split())
        db.execute("insert into f(rowid, b) values (?, ?)", (i, " ".join(s[k : k + 2] for k in range(len(s) - 1)) if len(s) > 1 else s))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for q in ("the bill", "atta", "für", "予算", "x"):
        s = "".join(q.split())
        match = " OR ".join(f'"{s[k : k + 2]}"' for k in range(max(1, len(s) - 1)))
        want = {i: -v for i, v in db.execute("select rowid, rank from f where f match ?", (match,))}
        toks = grams.query_tokens(q)
        got = {x.i: x.score for x in grams.bm25(df, [toks], grams.statistics(df, toks)).collect()}
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want), q


def test_search_orders_and_context(talk):
    p = parse("budget", date(2026, 9, 3))
    hits = search.search(talk, p, 2)
    assert hits.count() == 2
    near = search.with_context(talk, talk.where("line_no = 3"), 1).orderBy("line_no").collect()
    assert [(x.line_no, x.is_hit) for x in near] == [(2, False), (3, True), (8, False)]
    assert search.search(talk, parse("zzqq xxyy", date(2026, 9, 3)), 3).first().stage == 1
    assert search.dedupe(talk.unionByName(talk), ["line_no"]).count() == 9
    assert search.compaction_ranges(talk).collect()[0][1:] == (1, datetime(2026, 9, 1, 9), datetime(2026, 9, 3, 8, 1))


def test_blocks_fold_and_headline(spark):
    at = lambda m: datetime(2026, 1, 1) + timedelta(minutes=m)
    df = spark.createDataFrame([("s", at(m), "x") for m in (0, 2, 6, 10, 14, 16, 30, 34)], "k string, ts timestamp_ntz, text string")
    assert [x.block for x in state.topic_blocks(df, "k", "ts").orderBy("ts").collect()] == [1, 1, 1, 1, 1, 2, 3, 3]
    heads = state.block_heads(state.topic_blocks(df, "k", "ts"), "k", "ts", F.lit(False))
    assert heads.count() == 3 and state.fold(heads, "ts", at(200), key=["k"]).count() == 2
    text = lambda s: spark.createDataFrame([(s,)], "t string").select(state.headline(F.col("t"))).first()[0]
    assert text("well, so where is the file") == "where is the file" and text("some things remain") == "some things remain"
    assert text("Good day to you! The deploy of the backup index broke").startswith("…The deploy of the backup")


def test_live_branches(spark):
    at = lambda m: datetime(2026, 1, 1) + timedelta(minutes=m)
    nodes = [("t", "a", None, at(0)), ("t", "b", "a", at(1)), ("t", "dead", "a", at(2)), ("t", "c", "b", at(40)), ("t", "d", "c", at(50)), ("t", "side", "b", at(41))]
    out = {x.id: (x.alive, x.newest) for x in state.live_branches(spark.createDataFrame(nodes, "tree string, id string, parent string, ts timestamp_ntz")).collect()}
    assert out == {"a": (True, True), "b": (True, True), "c": (True, True), "d": (True, True), "side": (True, False), "dead": (False, False)}


def test_topics_and_origin(spark, tmp_path):
    path = str(tmp_path / "d" / "topics.jsonl")
    assert state.add_topic(path, " one ", datetime(2026, 1, 1)) and not state.add_topic(path, "one", datetime(2026, 1, 1)) and state.add_topic(path, "x" * 90, datetime(2026, 1, 1))
    at = lambda s: datetime(2026, 1, 1) + timedelta(seconds=s)
    rows = spark.createDataFrame([(at(0),), (at(17),), (at(100),)], "ts timestamp_ntz")
    assert state.near_origin(rows, spark.createDataFrame([(at(8),), (at(26),)], "ts timestamp_ntz"), "ts").count() == 1
    done = spark.createDataFrame([("buy milk",), ("call Ann",)], "topic string")
    assert [x.topic for x in state.without_done(done, ["milk"]).collect()] == ["call Ann"]


def test_fusion(spark):
    schema = "ts timestamp_ntz, actor string, text string, src string, line_no int, rank int, distance double"
    at = datetime(2026, 1, 1)
    exact = spark.createDataFrame([(at, "a", "both", "s", 0, 1, None), (at, "a", "exact", "s", 1, 2, None)], schema)
    near = spark.createDataFrame([(at, "a", "both", "s", 0, 2, 0.55), (at, "a", "near", "s", 2, 1, 0.52)], schema)
    rows = fuse.fuse(exact, near, at, 10).collect()
    assert [x.text for x in rows][0] == "both" and all(x.confirm for x in rows) and rows[0].distance == 0.55
    far = near.withColumn("distance", F.lit(0.9))
    assert fuse.fuse(exact, far, at, 10).count() == 0 and fuse.fuse(exact, far, at, 10, far_cut=None).count() == 3


def test_knn_and_embedder(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, embedding array<float>")
    want = {q: np.lexsort((np.arange(60), np.round(np.linalg.norm(v.astype(np.float32) - v.astype(np.float32)[q], axis=1), 6)))[:4].tolist() for q in range(0, 60, 7)}
    got = semantic.knn_many(df, df.where("id % 7 = 0").withColumnRenamed("id", "q"), 4, "id", "q", block=3).orderBy("q", "distance").collect()
    assert {q: sorted(x.id for x in got if x.q == q) for q in want} == {q: sorted(w) for q, w in want.items()}
    e = semantic.HashedNgrams().encode(["the heating bill", "the heating bills", "予算", ""])
    assert np.linalg.norm(e[0] - e[1]) < np.linalg.norm(e[0] - e[2]) and np.isclose(np.linalg.norm(e[0]), 1) and not e[3].any()


def test_growing_files(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_bytes(b"one\ntwo\nhal")
    assert growing.whole_size(str(f)) == 8
    seen: list[tuple[str, bool]] = []

    def run():
        daemon.follow(spark, str(tmp_path / "*.jsonl"), str(tmp_path / "state"), lambda df, i: seen.extend((x.line, x.rewritten) for x in df.collect()), Config(), once=True).awaitTermination(60)

    run()
    assert sorted(seen) == [("one", False), ("two", False)]
    f.write_bytes(b"one\ntwo\nhalf\n")
    run()
    assert sorted(seen)[:1] == [("half", False)] and len(seen) == 3
    f.write_bytes(b"new\n")
    run()
    assert seen[-1] == ("new", True) and len(seen) == 4


def test_daemon_tick(spark, tmp_path):
    lines = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "src string, line_no int, line string")
    assert daemon.tick(spark, lines, f"file://{tmp_path}", "v1") == {"new": 1}
    more = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 0, "q")], "src string, line_no int, line string")
    assert daemon.tick(spark, more, f"file://{tmp_path}", "v2") == {"appended": 1, "new": 1}
    assert daemon.tick(spark, more, f"file://{tmp_path}", "v3") == {"unchanged": 2}


def test_streams(spark, tmp_path):
    base = datetime(2026, 1, 1)
    rows = [("s", base + timedelta(minutes=m)) for m in (0, 2, 6, 10, 14, 16, 30, 34)]
    spark.createDataFrame(rows, "session string, ts timestamp").withColumn("us", F.unix_micros("ts")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("session string, ts timestamp, us bigint").parquet(str(tmp_path / "in"))
    out: list = []
    q = blocks.block_stream(source.select("session", "us")).writeStream.foreachBatch(lambda df, i: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert [x.block for x in sorted(out, key=lambda x: x.us)] == [1, 1, 1, 1, 1, 2, 3, 3]
    got: list = []
    q = sessions.session_stream(source, "session", "ts", "10 minutes", "1 hour").writeStream.outputMode("complete").foreachBatch(lambda df, i: got.__setitem__(slice(None), df.collect())).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted(x.n_rows for x in got) == [2, 6]


def test_config(tmp_path):
    assert load(str(tmp_path / "none.json")) == Config()
    (tmp_path / "c.json").write_text(json.dumps({"_note": 1, "user_name": "Sam", "timezone": "Moon/Base", "topic_words": ["a"], "other": 1}))
    c = load(str(tmp_path / "c.json"))
    assert c.user_name == "Sam" and c.timezone == "UTC" and c.warnings and c.topic_words == ("a",)
    (tmp_path / "w.json").write_text(json.dumps({"corrections": {"a": "b", "c": 1}}))
    assert corrections(Config(asr_corrections=str(tmp_path / "w.json"))) == {"a": "b"}


def test_time_query_in_sql(spark):
    from kairolog.plans import sql

    sql.register(spark)
    row = spark.sql("select * from time_query('yesterday evening about the budget', '2026-09-24', 'Asia/Tokyo')").first()
    assert (row.first_day, row.last_day, row.hour_from, row.hour_to, row.keywords) == ("2026-09-23", "2026-09-23", 17, 21, ["budget"])
    assert row.utc_from == datetime(2026, 9, 22, 15)
    assert spark.sql("select first_day, keywords from time_query('', '2026-09-24', 'UTC')").first() == (None, [])
