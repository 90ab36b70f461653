"""Conversion, indexes that follow, current topics, nearest neighbours by lists."""

import json
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from kairolog import config as cfg
from kairolog.functions import semantic
from kairolog.functions.grammar import parse
from kairolog.plans import current
from kairolog.sources import ingest
from kairolog.streaming import daemon

CONFIG = cfg.Config(user_name="Sam", ai_name="Nova", timezone="Asia/Tokyo")
LINES = "src_file string, line_no int, line string"


def say(src, i, ts, role, text):
    return (src, i, json.dumps({"ts": ts, "role": role, "text": text}))


def test_conversion_in_parts_equals_conversion_at_once(spark, tmp_path):
    first = [say("raw/a.jsonl", 0, "2026-03-01T10:00:00Z", "user", "one"), say("raw/a.jsonl", 1, "2026-03-01T16:00:00Z", "assistant", "two"), ("raw/a.jsonl", 2, ""), ("raw/a.jsonl", 3, "{broken")]
    late = [say("raw/b.jsonl", 0, "2026-03-01T09:00:00Z", "user", "late"), say("raw/a.jsonl", 4, "2026-03-05T09:00:00Z", "user", "new"), say("raw/a.jsonl", 1, "2026-03-01T16:00:00Z", "assistant", "two")]
    frame = lambda rows: spark.createDataFrame(rows, LINES)
    parts, whole = f"file://{tmp_path}/parts", f"file://{tmp_path}/whole"
    assert ingest.convert_all(frame(first), CONFIG, parts) == ingest.Counts(2, 2, 2)
    made = ingest.convert_more(frame(late), CONFIG, parts)
    assert (made.total, made.skipped, made.days) == (3, 0, 3)
    assert ingest.convert_more(frame(late), CONFIG, parts) == made  # a pass that is done again changes nothing
    ingest.convert_all(frame(first + late[:2]), CONFIG, whole)
    rows = lambda d: sorted(tuple(r) for r in ingest.stored(spark, d).select("day", "ts", "actor", "text").collect())
    assert rows(parts) == rows(whole) and [r[0] for r in rows(parts)] == ["2026-03-01", "2026-03-01", "2026-03-02", "2026-03-05"]


def test_pipeline_follows_the_logs(spark, tmp_path):
    root, data = f"file://{tmp_path}/root", f"file://{tmp_path}/data"
    e = semantic.HashedNgrams()
    rows = [say("raw/a.jsonl", i, f"2026-03-0{1 + i % 3}T10:00:{i:02d}Z", "user" if i % 2 else "assistant", f"the budget of week {i}") for i in range(9)]
    frame = lambda rows: spark.createDataFrame(rows, LINES)
    done, said = daemon.pipeline(spark, frame(rows), CONFIG, data, root, "v1", e)
    assert done and said == "9 records of 3 days, 0 lines skipped; sources: 3 new"
    assert daemon.pipeline(spark, frame(rows), CONFIG, data, root, "v2", e) == (False, "nothing changed")
    rows += [say("raw/b.jsonl", 0, "2026-03-01T09:00:00Z", "user", "the garden")]
    done, said = daemon.pipeline(spark, frame(rows), CONFIG, data, root, "v3", e)
    assert done and said.endswith("sources: 1 rewritten, 2 unchanged")
    index = daemon.Indexes(spark, f"{root}/indexes", e)
    assert tuple(index.totals().first())[:2] == (10, 3) and index.vectors().count() == 10
    full = daemon.Indexes(spark, f"file://{tmp_path}/full", e)
    full.tick(daemon.records_of(spark, data), "v")
    for name in ("postings", "lengths"):
        assert sorted(map(tuple, getattr(index, name)().collect())) == sorted(map(tuple, getattr(full, name)().collect()))
    assert {r.line_no for r in index.bm25([["ga", "ar"]]).collect()} == {0}


def test_words_of_the_users_own(tmp_path):
    (tmp_path / "rag_filters.json").write_text(json.dumps({"stopwords": {"include": ["foo", 3], "exclude": ["テスト"]}, "protected_names": {"include": ["Blue Heron"]}, "fillers": "no list"}))
    own = cfg.vocabulary(cfg.Config(data_dir=str(tmp_path)))
    assert "foo" in own.stopwords and "テスト" not in own.stopwords and own.fillers == cfg.Vocabulary().fillers
    plan = parse("the Blue Heron foo notes", datetime(2026, 1, 1).date(), words_of=own)
    assert [g[0] for g in plan.keywords] == ["Blue Heron", "notes"]
    assert cfg.vocabulary(cfg.Config(data_dir="/nowhere")) == cfg.Vocabulary()


def node(src, i, uuid, parent, ts, kind, text):
    return (src, i, json.dumps({"type": kind, "timestamp": ts, "uuid": uuid, "parentUuid": parent, "message": {"role": kind, "content": text}}))


def test_current_topics_from_transcripts(spark):
    t = "2026-03-01T10:{:02d}:00Z".format
    lines = [
        node("a", 0, "1", None, t(0), "user", "um, plan the budget. Then the schedule of the index"), node("a", 1, "2", "1", t(1), "assistant", "yes"), node("a", 2, "3", "2", t(2), "user", "that is critical for the backup"),
        node("a", 3, "x", "1", t(3), "user", "a branch that was left long ago"), node("a", 4, "4", "3", t(40), "user", "<command-name>x"), node("b", 0, "9", None, t(41), "user", "from the app, where is the memory"), ("b", 1, "{broken"),
    ]
    markers = spark.createDataFrame([(datetime(2026, 3, 1, 10, 20), "garden", True), (datetime(2026, 2, 1), "old", False)], "ts timestamp_ntz, topic string, done boolean")
    origins = ingest.origin_times(spark.createDataFrame([("2026-03-01T19:41:03", "App "), ("2026-03-01T19:00:00", "web"), ("soon", "app")], "time string, tag string"), "Asia/Tokyo")
    out = current.today_lines(spark.createDataFrame(lines, LINES), markers, CONFIG, datetime(2026, 3, 1, 11), origins)
    assert out == ["19:00 plan the budget. Then the", "19:02 !that is critical for the ", "19:20 *done garden", "19:41 ▲from the app, where is th"]
    assert current.today_lines(spark.createDataFrame([], LINES), markers, CONFIG, datetime(2026, 3, 9)) == ["09:00 old", "19:20 *done garden"]


def test_lists_give_the_nearest(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(20, 16))
    x = centre[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 16)) * 0.3
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9999, None)], "id long, embedding array<double>").repartition(4)
    q = df.where("id % 100 = 0").withColumnRenamed("id", "q")
    pick = lambda f: {(r.q, r.id) for r in f.collect()}
    d = np.linalg.norm(x[::100][:, None] - x[None], axis=2)
    exact = {(100 * i, int(j)) for i, row in enumerate(d) for j in np.argsort(row, kind="stable")[:5]}
    assert pick(semantic.knn_many(df, q, 5, "id", "q")) == exact
    centres = semantic.centroids(df, 20)
    for per_task in (50, 20_000):
        found = pick(semantic.knn_lists(df, q, 5, "id", "q", centres, 4, per_task=per_task))
        assert len(found & exact) >= 0.9 * len(exact)
    assert semantic.knn_many(df.limit(0), q.limit(0), 5, "id", "q").count() == 0


def test_a_batch_of_texts_is_encoded_as_each_is():
    e = semantic.HashedNgrams()
    texts = ["the heating bill", "", "x", "予算の話", "The Heating bill"]
    whole = e.encode(texts)
    assert np.allclose(whole, np.concatenate([e.encode([t]) for t in texts])) and np.allclose(whole[0], whole[4]) and e.encode([]).shape == (0, 384)


def test_search_by_index_equals_search_by_scan(spark, tmp_path):
    from kairolog.operators import search
    from kairolog.plans.recall import Corpus, format_lines, recall
    from kairolog.plans.upkeep import Indexes
    from kairolog.sources.records import FIELDS, with_ts

    texts = ["the budget for Friday", "Friday again", "a budget", "nothing at all", "budget Friday budget", "meta budget Friday"]
    rows = [(f"2026-03-0{1 + i}T10:00:00Z", "Sam", "user", "meta" if i == 5 else "text", t, None, "s", f"main/{i % 2}", i) for i, t in enumerate(texts)]
    records = with_ts(spark.createDataFrame(rows, "ts_raw string, actor string, role string, type string, text string, model string, session string, src string, line_no int")).select(*FIELDS)
    index = Indexes(spark, f"file://{tmp_path}/index")
    index.tick(records, "v")
    today = datetime(2026, 3, 9)
    for q in ("budget Friday", "budget", "what did we say on 2026-03-01 about budget", "zebra"):
        p = parse(q, today.date())
        pick = lambda f: [(r.src, r.line_no, round(r.score, 9), r.stage) for r in f.collect()]
        assert pick(search.search(records, p, 4)) == pick(search.search(records, p, 4, index=index))
    config = cfg.Config(user_name="Sam")
    both = [format_lines(recall(Corpus(records, index=i), "budget Friday", config, today), config, today) for i in (None, index)]
    assert both[0] == both[1] and len(both[0]) > 2 and index.bm25([]).count() == 0


def _records(spark, rows):
    from kairolog.sources.records import FIELDS, with_ts

    schema = "ts_raw string, actor string, role string, type string, text string, model string, session string, src string, line_no int"
    return with_ts(spark.createDataFrame([("2026-03-01T10:00:00Z", "Sam", "user", "text", t, None, "s", src, i) for src, i, t in rows], schema)).select(*FIELDS)


def _states():
    """Records of six passes: sources grow (with a hole in their lines), change, shrink, go, and come back."""
    one = [(f"main/{k}", i, f"the Budget of {k} and {i}, Écho 𝔘x") for k in range(12) for i in (0, 1, 3)]
    two = [*[r for r in one if r[0] != "main/2"], *[(f"main/{k}", i, f"later {i} budget") for k in (0, 1, 5) for i in (4, 6)], ("new", 0, "x"), ("new", 1, " ?! "), ("new", 2, None), ("new", 3, "予算の話")]
    three = [(s, i, "Friday now" if (s, i) == ("main/0", 1) else t) for s, i, t in two if (s, i) != ("main/5", 6)]
    four = [*three, ("main/2", 0, "back again"), ("main/1", 5, "late in a hole")]
    return [one, two, three, four, [*four, ("main/1", 7, "budget Friday")], [r for r in four if r[0] == "main/1"]]


def _files(folder):
    return sum(1 for _ in folder.rglob("*.parquet") if _.is_file())


def test_ranking_by_an_index_that_followed_equals_that_of_a_full_build(spark, tmp_path, monkeypatch):
    from kairolog.plans import upkeep

    monkeypatch.setattr(upkeep, "SEGMENTS", 2)  # so that segments are merged
    e = semantic.HashedNgrams()
    index, groups = upkeep.Indexes(spark, f"file://{tmp_path}/index", e), [["bu", "ud"], ["la", "fr"]]
    for k, rows in enumerate(_states()):
        index.tick(_records(spark, rows), "v")
        if k not in (3, 5):
            continue
        full = upkeep.Indexes(spark, f"file://{tmp_path}/full{k}", e)
        full.tick(_records(spark, rows), "v")
        for pick in (lambda x: x.postings(), lambda x: x.lengths(), lambda x: x.vectors(), lambda x: x.bm25(groups).withColumn("score", F.round("score", 9))):
            a, b = (sorted(map(str, pick(x).collect())) for x in (index, full))
            assert a == b, k
        assert len(index._state().segments) == 2
    assert _files(tmp_path / "index" / "postings") <= 24


def test_a_source_that_grew_gets_only_its_new_lines(spark, tmp_path):
    from kairolog.plans.upkeep import Indexes

    one, two, *_ = _states()
    index = Indexes(spark, f"file://{tmp_path}/index")
    assert index.tick(_records(spark, one), "v") == {"new": 12}
    assert index.tick(_records(spark, one), "v") == {"unchanged": 12}  # line 2 is left out everywhere
    assert index.tick(_records(spark, two), "v") == {"gone": 1, "new": 1, "appended": 3, "unchanged": 8}
    assert [s.records for s in index._state().segments] == [36, 10]


def test_totals_need_few_files_whatever_the_number_of_sources(spark, tmp_path):
    from kairolog.plans.upkeep import Indexes

    rows = [(f"main/{k}", i, f"the budget of {k}") for k in range(300) for i in range(2)]
    index = Indexes(spark, f"file://{tmp_path}/index")
    index.tick(_records(spark, rows), "v1")
    index.tick(_records(spark, [("main/0", 0, "other"), *rows[1:-2]]), "v2")
    terms = sum(len(f"thebudgetof{k}") + 2 for k in range(299)) * 2  # four words, three blanks between: as many tokens as characters less one
    assert tuple(index.totals().first())[:2] == (598, 299) and _files(tmp_path / "index" / "lengths") <= 16


def test_posting_lists_equal_the_postings_of_each_record(spark, monkeypatch):
    from kairolog.functions import grams

    texts = ["the Budget, the budget", "a", "", None, " ?!", "é", "x y", "予算の話", "aaa aaa", "Ünï-cødé\n\tb", "b" * 500, "?a", "a?"]
    rows = spark.createDataFrame([(f"s{i % 3}", i, t) for i, t in enumerate(texts * 4)], "src string, line_no int, text string").repartition(2)
    c = grams.condensed(F.col("text"))
    want = sorted(map(tuple, grams.postings(rows, ["src", "line_no"]).select("gram", "src", "line_no", "tf").collect()))
    parts = rows.select("src", "line_no", grams.token_count(c).cast("int").alias("len"), c.alias("c")).toArrow().to_batches(5)
    for size, most in ((grams.RUN_BYTES, grams.RUN_RECORDS), (40, 100), (10_000, 3)):
        monkeypatch.setattr(grams, "RUN_BYTES", size), monkeypatch.setattr(grams, "RUN_RECORDS", most)
        out = [x.to_pylist() for r in grams._runs(iter(parts)) if (x := grams._counted(r))]
        found = [(x["gram"], x["src"], i, n) for run in out for x in run for i, n in zip(x["line_no"], x["tf"], strict=True)]
        assert sorted(found) == want and all([x["gram"] for x in run] == sorted(x["gram"] for x in run) for run in out)
    (one,) = grams.posting_lists(spark.createDataFrame([("s", 7, 2, "𝔘𝔘𝔘")], "src string, line_no int, len int, c string")).collect()
    assert tuple(one) == ("𝔘𝔘", "s", [7], [2], [2])  # characters beyond 16 bits are one


def test_terms_of_an_index_are_those_of_its_postings(spark, tmp_path):
    from kairolog.plans.upkeep import Indexes

    index = Indexes(spark, f"file://{tmp_path}/index")
    for rows in _states()[:3]:
        index.tick(_records(spark, rows), "v")
    each = index.postings().groupBy("gram").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
    assert sorted(map(tuple, index.terms().collect())) == sorted(map(tuple, each.collect()))
    assert _files(tmp_path / "index" / "postings") <= 24


def test_records_are_numbered_within_their_segment(spark):
    from kairolog.functions import grams

    found = grams.numbered(spark.range(70_000, numPartitions=2), 3).collect()
    assert len({(r.run, r.place) for r in found}) == 70_000 and {r.run >> 39 for r in found} == {3} and max(r.place for r in found) == (1 << 15) - 1 and len({r.run for r in found}) == 4


def test_changes_are_found_with_lines_exchanged_by_source_only(spark, tmp_path):
    import re

    from kairolog.plans.upkeep import Indexes

    one, two, *_ = _states()
    index = Indexes(spark, f"file://{tmp_path}/index")
    index.tick(_records(spark, one), "v")
    plan = index.changes(_records(spark, two))._jdf.queryExecution().executedPlan().toString()
    by = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert by and all(re.fullmatch(r"src#\d+", b) for b in by)


def test_repeated_lines_count_once(spark, tmp_path):
    from kairolog.plans.upkeep import Indexes

    one, two, *_ = _states()
    index = Indexes(spark, f"file://{tmp_path}/index")
    assert index.tick(_records(spark, one + one[:4]), "v1") == {"new": 12}
    assert index.totals().first().records == 36
    again = _records(spark, two + two[-5:] + [("new", 0, "x")])
    assert {r.src for r in index.changes(again).where("repeated").collect()} >= {"new"}
    assert index.tick(again, "v2") == {"gone": 1, "new": 1, "appended": 3, "unchanged": 8}
    assert index.totals().first().records == 36 - 3 + 10
    fields = _records(spark, [("a", 0, None)]).select("line_no", "ts_raw", "type", "text")
    from kairolog.operators.manifest import row_digest

    swapped = fields.withColumns({"type": F.col("text"), "text": F.col("type")})
    assert len({r[0] for f in (fields, swapped) for r in f.select(row_digest(F.col("line_no"), "ts_raw", "type", "text")).collect()}) == 2


def test_an_index_has_rows_for_grams_not_for_sources(spark, tmp_path):
    from kairolog.plans.upkeep import Indexes

    rows = [(f"main/{k}", i, f"the budget of {k}, the budget") for k in range(300) for i in range(2)]
    index = Indexes(spark, f"file://{tmp_path}/index")
    index.tick(_records(spark, rows), "v1")
    index.tick(_records(spark, [("main/0", 0, "other"), *rows[1:-2]]), "v2")
    terms = index.terms().count()
    assert terms > 100 and spark.read.parquet(f"{tmp_path}/index/postings/*").count() < 12 * terms  # a row for a gram and a file of records
    each = index.postings().groupBy("gram").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
    assert sorted(map(tuple, index.terms().collect())) == sorted(map(tuple, each.collect()))
    assert {(r.src, r.line_no, r.tf, r.len) for r in index.postings(["ot", "f9"]).collect() if r.src in ("main/0", "main/9")} == {("main/0", 0, 1, 4), ("main/9", 0, 1, 21), ("main/9", 1, 1, 21)}


def test_packed_occurrences_are_the_postings_of_each_record(spark, monkeypatch):
    from kairolog.functions import grams

    texts = ["the Budget, the budget", "a", "", None, " ?!", "é", "x y", "予算の話", "aaa aaa", "b" * 500, "?a", "a? a?"]
    places = [0, 1, 2, 7, 8, 255, 256, 300, 32_766, 32_767, 900, 40]
    rows = spark.createDataFrame([(run, p, t) for run in (5, 1 << 39, (7 << 39) + 3) for p, t in zip(places, texts, strict=True)], "run long, place int, text string").repartition(2)
    dead = rows.where("run = 5 and place in (0, 7, 300, 32767) or run > 5 and place in (1, 32766)").select("run", "place")
    packed = grams.occurrences(rows.select("run", "place", grams.condensed(F.col("text")).alias("c"))).cache()
    some = lambda f: sorted(map(tuple, f.select("gram", "run", "place", "tf").collect()))
    for have, want in ((packed, rows), (grams.living(packed, dead), rows.join(dead, ["run", "place"], "left_anti")), (grams.living(packed, dead.limit(0)), rows), (grams.living(packed, rows), rows.limit(0))):
        want = some(grams.postings(want, ["run", "place"]))
        assert some(grams.unpacked(have)) == want
        assert tuple(have.agg(F.coalesce(F.sum("tf"), F.lit(0)), F.coalesce(F.sum("df"), F.lit(0))).first()) == (sum(x[3] for x in want), len(want))
    (one,) = grams.unpacked(grams.occurrences(spark.createDataFrame([(4, 9, "𝔘𝔘𝔘")], "run long, place int, c string"))).collect()
    assert tuple(one) == ("𝔘𝔘", 4, 9, 2)  # characters beyond 16 bits are one
    (batch,) = packed.coalesce(1).select("gram", "run", "ids").toArrow().combine_chunks().to_batches()
    whole = [(int(r), int(p)) for _, row, place in grams._unpacked(batch) for r, p in zip(row, place, strict=True)]
    monkeypatch.setattr(grams, "UNPACK", 3)
    at, parts = 0, []
    for part, row, place in grams._unpacked(batch):
        parts, at = parts + [(int(r) + at, int(p)) for r, p in zip(row, place, strict=True)], at + len(part)
    assert at == len(batch) and parts == whole
    rest = [(int(r) + 5, int(p)) for _, row, place in grams._unpacked(batch.slice(5)) for r, p in zip(row[:1], place[:1], strict=True)][:1]
    assert rest[0] in whole  # a slice of a batch begins at its own rows
