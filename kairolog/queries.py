"""Queries of the core operators over the driver's tables, and the SQL each must agree with.

Instants come out as microseconds, scores and distances rounded to six digits. ``today`` and ``now`` are pinned.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairolog.config import Config
from kairolog.functions import grams, semantic, textprep
from kairolog.functions import vocabulary as v
from kairolog.functions.grammar import QueryPlan, parse
from kairolog.operators import fuse, ledger, manifest, search, sessions, state, timestamps
from kairolog.plans import current, sql
from kairolog.plans.recall import Corpus, compacted, format_lines, recall
from kairolog.plans.upkeep import Indexes
from kairolog.session import cut, scratch, table
from kairolog.sources import ingest
from kairolog.sources import records as r

TZ, TODAY, NOW = "America/New_York", date(2024, 1, 15), datetime(2024, 1, 31)
META_NOW = datetime(2026, 9, 24)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    return r.from_events(table(spark, d, "events"))


def messages(spark: SparkSession, d: str, timed: bool = True) -> DataFrame:
    return r.from_meta(table(spark, d, "meta"), timed)


def stored(spark: SparkSession, d: str, timed: bool = True) -> DataFrame:
    """Messages as a written table of records, for queries that pass over them several times."""
    return cut(messages(spark, d, timed))


def us(c: str | Column) -> Column:
    return timestamps.ntz_micros(F.col(c) if isinstance(c, str) else c)


def plan(text: str) -> QueryPlan:
    return parse(text, TODAY, TZ)


# --------------------------------------------------------------- SQL shared by several oracles

REC = """rec AS (SELECT event_id AS line_no, ts, epoch_us(ts) AS ts_us, CASE WHEN user_id % 2 = 0 THEN 'user' ELSE 'ai' END AS actor,
  CASE event_type WHEN 'purchase' THEN 'text' WHEN 'click' THEN 'action' WHEN 'view' THEN 'thinking' WHEN 'signup' THEN 'doc' WHEN 'error' THEN 'meta' END AS type,
  event_type || ' ' || props AS text, CAST(user_id AS VARCHAR) AS session, 'main/' || strftime(ts, '%Y-%m-%d') AS src,
  (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS lts FROM events)"""

MREC = r"""mone AS (SELECT src_day AS src, line_no, arg_min(text, rowid) AS text, arg_min(coalesce(ts, ''), rowid) AS raw, arg_min(coalesce(actor, chr(1)), rowid) AS a, arg_min(coalesce(session, chr(1)), rowid) AS s,
  arg_min(text IS NULL, rowid) AS nt FROM meta GROUP BY src_day, line_no),
mrec AS (SELECT src, line_no, text, nullif(a, chr(1)) AS actor, nullif(s, chr(1)) AS session, epoch_us(CASE WHEN regexp_matches(raw, '^\d{4}-\d\d-\d\dT\d\d:\d\d') THEN CASE WHEN regexp_matches(raw, '(Z|[+-]\d\d:\d\d)$') THEN try_cast(raw AS TIMESTAMPTZ) ELSE try_cast(raw || 'Z' AS TIMESTAMPTZ) END END) AS ts_us,
  CASE WHEN starts_with(text, 'This session is being continued') OR contains(text, '<command-name>') OR contains(text, '<local-command-stdout>') OR contains(text, '<task-notification>') THEN 'meta'
       WHEN regexp_matches(text, '^(Bash|Read|Write|Search): ') THEN 'action' ELSE 'text' END AS type FROM mone WHERE NOT nt AND regexp_matches(text, '[^\t-\r\x{85}\p{Z}]'))"""


def time_sql(where: str, words: list[str], columns: str = "line_no, ts_us, actor, type, text, session") -> str:
    hit = " AND ".join(f"contains(lower(text), '{w}')" for w in words)
    return f"""WITH {REC}, scope AS (SELECT *, {hit} AS hit FROM rec WHERE type NOT IN ('meta', 'doc') AND {where}), c AS (SELECT count(*) FILTER (WHERE hit) >= 2 AS enough FROM scope)
        SELECT {columns}, CASE WHEN enough THEN 'L1' ELSE 'L2' END AS level FROM scope, c WHERE hit OR NOT enough"""


DAY_15 = "ts >= TIMESTAMP '2024-01-15 05:00:00' AND ts < TIMESTAMP '2024-01-16 05:00:00'"


def shown() -> list:
    return ["line_no", us("ts").alias("ts_us"), "actor", "type", "text", "session"]


_ACCENTS = "'{}', '{}'".format(*grams.accents())
TOK = rf"""mtok AS (SELECT src, line_no, list_transform(range(1, greatest(length(z), 2)), lambda i: substr(z, i, 2)) AS w FROM (SELECT src, line_no, regexp_replace(text, '[\s\p{{Z}}]', '', 'g') AS z FROM mrec)),
mts AS (SELECT src, line_no, regexp_extract_all(translate(lower(array_to_string(w, ' ')), {_ACCENTS}), '[\p{{L}}\p{{N}}]+') AS t FROM mtok)"""


def bm25_sql(groups: list[list[str]], limit: int) -> str:
    flat = list(dict.fromkeys(t for g in groups for t in g))
    weights = ", ".join(f"('{t}', {sum(g.count(t) for g in groups)})" for t in flat)
    need = " AND ".join("list_has_any(t, [" + ", ".join(f"'{t}'" for t in g) + "])" for g in groups)
    return f"""WITH {MREC}, {TOK}, st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM mts), q AS (FROM (VALUES {weights}) q(g, wt)),
        df AS (SELECT g, wt, count(*) FILTER (WHERE list_contains(t, g)) AS df FROM mts, q GROUP BY g, wt),
        idf AS (SELECT g, wt, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM df, st),
        sc AS (SELECT m.src, m.line_no, sum(wt * idf * len(list_filter(t, lambda x: x = g)) * 2.2 / (len(list_filter(t, lambda x: x = g)) + 1.2 * (0.25 + 0.75 * len(t) / mean))) AS score
               FROM mts m JOIN mrec r USING (src, line_no), idf, st WHERE r.type <> 'meta' AND {need} GROUP BY ALL)
        SELECT src, line_no, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, src, line_no) AS k FROM sc) WHERE k <= {limit}"""


# --------------------------------------------------------------- training-data problems of the core


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.log_instants(table(spark, d, "sample_log"), table(spark, d, "config_example")).where("utc_us is not null").select("log_id", "utc_us").distinct()


@query(r"""
        WITH l AS (SELECT src_day, line_no, any_value(coalesce(text, '')) AS text FROM meta GROUP BY ALL),
        n AS (SELECT src_day, count(*) AS n FROM l GROUP BY ALL),
        good AS (SELECT run_id FROM index_runs WHERE lower(trim(status)) = 'ok' AND finished_at IS NOT NULL),
        c AS (SELECT 'day' AS side, day AS src_day, done_lines AS done, sig, run_id FROM day_progress
              UNION ALL SELECT 'src', CASE WHEN src LIKE 'corpus/%' THEN substr(src, 8) ELSE src END, nlines, sig, run_id FROM src_progress),
        b AS (SELECT side, src_day, max({'r': run_id, 'd': done, 's': coalesce(sig, '')}) AS m FROM c WHERE run_id IN (FROM good) GROUP BY ALL),
        k AS (SELECT side, src_day, m.d AS done, m.s AS sig FROM b JOIN n USING (src_day) WHERE m.d BETWEEN 1 AND n AND m.s <> ''),
        v AS (SELECT k.side, k.src_day, k.done FROM k JOIN l ON l.src_day = k.src_day AND (CASE k.side WHEN 'day' THEN l.line_no < k.done ELSE l.line_no = k.done - 1 END)
              GROUP BY k.side, k.src_day, k.done, k.sig HAVING substr(sha1(string_agg(l.text, '' ORDER BY l.line_no)), 1, 16) = k.sig)
        SELECT s.side, l.src_day, l.line_no FROM l CROSS JOIN (VALUES ('day'), ('src')) s(side) LEFT JOIN v ON v.side = s.side AND v.src_day = l.src_day WHERE l.line_no >= coalesce(v.done, 0)""")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return ledger.remaining_lines(table(spark, d, "meta"), table(spark, d, "day_progress"), table(spark, d, "src_progress"), table(spark, d, "index_runs"))


@query(r"""
        WITH d AS (SELECT DISTINCT ts, actor, text, session, src_day, line_no FROM meta WHERE actor IS NOT NULL),
        e AS (SELECT lower(regexp_replace(actor, '^\s+|\s+$', '', 'g')) AS actor, epoch_us(CASE WHEN regexp_matches(ts, '(Z|[+-]\d\d:\d\d)$') THEN try_cast(ts AS TIMESTAMPTZ) ELSE try_cast(ts || 'Z' AS TIMESTAMPTZ) END) AS t
              FROM d WHERE regexp_matches(ts, '^\d{4}-\d\d-\d\dT\d\d:\d\d')),
        g AS (SELECT actor, t, CASE WHEN t - lag(t) OVER w <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM e WHERE t IS NOT NULL WINDOW w AS (PARTITION BY actor ORDER BY t)),
        s AS (SELECT actor, t, sum(fresh) OVER (PARTITION BY actor ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT actor, min(t) AS start_us, max(t) AS end_us, count(*) AS n_rows FROM s GROUP BY actor, k""")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sessions.actor_sessions(table(spark, d, "meta")).select("actor", "start_us", "end_us", "n_rows")


@query()
def p1_estimated_zones(spark: SparkSession, d: str) -> DataFrame:
    """For each configuration the zone that its logs themselves speak for, from wall clocks between rows that name their zone."""
    log = timestamps.declared(table(spark, d, "sample_log"), table(spark, d, "config_example"))
    rows = timestamps.with_parts(log, "ts").select("cfg_id", "src_file", "line_no", F.when(F.col("known_us").isNull(), F.col("wall")).alias("wall"), "known_us")
    common = ("UTC", "Europe/Berlin", "Europe/London", "America/New_York", "America/Chicago", "America/Los_Angeles", "America/Phoenix", "America/Sao_Paulo", "America/St_Johns", "Asia/Tokyo", "Asia/Kolkata", "Asia/Kathmandu", "Australia/Sydney", "Australia/Lord_Howe", "Pacific/Auckland")
    return timestamps.estimate_zones(rows, "cfg_id", "wall", "known_us", "src_file", "line_no", timestamps.regions(common))


# --------------------------------------------------------------- sources


@query(f"WITH {REC} SELECT line_no, ts_us, actor, actor AS role, type, text, session, src, strftime(lts, '%Y-%m-%d') AS day FROM rec")
def normalize_records(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("line_no", us("ts").alias("ts_us"), "actor", "role", "type", "text", "session", "src", r.local_day(F.col("ts"), F.col("ts_raw"), TZ).alias("day"))


_TRIM = r"'^[\t-\r\x{85}\p{Z}]+|[\t-\r\x{85}\p{Z}]+$', '', 'g'"


@query(rf"""WITH m AS (SELECT s.*, c.user_name, c.ai_name, c.model_name, coalesce(role = 'user', false) AS u,
          regexp_replace(regexp_replace(text, '(?s)<local-command-caveat>.*?</local-command-caveat>', '', 'g'), {_TRIM}) AS body FROM sample_log s LEFT JOIN config_example c USING (cfg_id))
        SELECT regexp_extract(src_file, '([^/]*)\.[^./]*$', 1) AS session, line_no, ts AS ts_raw, CASE WHEN u THEN user_name ELSE ai_name END AS actor, CASE WHEN u THEN 'user' ELSE 'ai' END AS role,
          CASE WHEN starts_with(body, 'This session is being continued') OR contains(body, '<command-name>') OR contains(body, '<local-command-stdout>') OR contains(body, '<task-notification>') THEN 'meta' ELSE 'text' END AS type,
          body AS text, CASE WHEN NOT u THEN model_name END AS model FROM m WHERE ts <> '' AND body <> ''""")
def plain_log_records(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "config_example").select("cfg_id", "user_name", "ai_name", "model_name")
    rows = table(spark, d, "sample_log").join(c, "cfg_id", "left")
    return r.plain_messages(rows, F.col("user_name"), F.col("ai_name"), F.col("model_name")).select("session", "line_no", "ts_raw", "actor", "role", "type", "text", "model")


@query(f"""WITH {REC}, e AS (SELECT rec.*, event_type, json_extract_string(props, '$.k') AS k FROM rec JOIN events ON event_id = line_no)
        SELECT line_no, CASE actor WHEN 'user' THEN 'Sam' ELSE 'Nova' END AS actor, actor AS role, 'text' AS type, text || chr(10) || 'k is ' || k AS text, ts_us FROM e WHERE event_type <> 'signup'
        UNION ALL SELECT line_no, 'Nova', 'ai', 'action', event_type || ': file/' || k, ts_us FROM e WHERE actor = 'ai' AND event_type <> 'signup'""")
def transcript_records(spark: SparkSession, d: str) -> DataFrame:
    """Events written as lines of a transcript and parsed again: bodies of two blocks, and a tool call whose first string value is second."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    call = F.concat(F.lit('{"type":"tool_use","name":"'), "event_type", F.lit('","input":{"n":'), k, F.lit(',"path":" file/'), k, F.lit('","x":"y"}}'))
    blocks = F.concat(F.lit('[{"type":"text","text":'), F.get(F.array(F.to_json(F.struct(F.concat_ws(" ", "event_type", "props").alias("t")))), 0))
    text = F.regexp_extract(F.to_json(F.struct(F.concat_ws(" ", "event_type", "props").alias("t"))), r'^\{"t":(.*)\}$', 1)
    blocks = F.concat(F.lit('[{"type":"text","text":'), text, F.lit('},'), call, F.lit(',{"type":"tool_result","content":"no"},{"type":"text","text":"k is '), k, F.lit('"}]'))
    who = F.when(F.col("event_type") == "signup", "progress").when(F.col("user_id") % 2 == 0, "user").otherwise("assistant")
    line = F.concat(F.lit('{"type":"'), who, F.lit('","timestamp":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('","uuid":"u","parentUuid":null,"message":{"role":"x","content":'), blocks, F.lit("}}"))
    lines = e.select(F.concat(F.lit("raw/"), F.col("user_id").cast("string"), F.lit(".jsonl")).alias("src_file"), F.col("event_id").cast("int").alias("line_no"), line.alias("line"))
    return r.parse_transcript(lines, Config(user_name="Sam", ai_name="Nova")).select("line_no", "actor", "role", "type", "text", us("ts").alias("ts_us"))


@query(rf"WITH {MREC} SELECT strftime((make_timestamp(ts_us) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT session) AS sessions FROM mrec WHERE ts_us IS NOT NULL GROUP BY ALL")
def day_file_counts(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).where("ts is not null")
    return m.groupBy(r.local_day(F.col("ts"), F.col("ts_raw"), TZ).alias("day")).agg(F.count("*").alias("n"), F.count_distinct("session").alias("sessions"))


@query(f"WITH {REC} SELECT arg_max(session, ts_us) AS session FROM rec WHERE session <> ''")
def last_session(spark: SparkSession, d: str) -> DataFrame:
    return search.last_session(events(spark, d))


# --------------------------------------------------------------- search in time


@query(time_sql(DAY_15, ["purchase"]))
def time_search_l1(spark: SparkSession, d: str) -> DataFrame:
    return search.search_time(events(spark, d), plan("2024-01-15 purchase")).select(*shown(), "level")


@query(time_sql(DAY_15, ["purchase", "42", "zebra"]))
def time_search_l2(spark: SparkSession, d: str) -> DataFrame:
    return search.search_time(events(spark, d), plan("2024-01-15 purchase 42 zebra")).select(*shown(), "level")


@query(f"WITH {REC} SELECT line_no, ts_us, actor, type, text, session, 'L0' AS level FROM rec WHERE type NOT IN ('meta', 'doc') AND {DAY_15}")
def time_search_day(spark: SparkSession, d: str) -> DataFrame:
    return search.search_time(events(spark, d), plan("what did we say today")).select(*shown(), "level")


@query(f"WITH {REC} SELECT line_no, ts_us, actor, type, text, session FROM rec WHERE type NOT IN ('meta', 'doc') AND lts >= TIMESTAMP '2024-01-08' AND lts < TIMESTAMP '2024-01-15' AND hour(lts) BETWEEN 17 AND 20 AND actor = 'user'")
def time_search_hours(spark: SparkSession, d: str) -> DataFrame:
    return search.search_time(events(spark, d), plan("last week in the evening"), actor="user").select(*shown())


@query(f"WITH {REC}, h AS (SELECT * FROM rec WHERE type NOT IN ('meta', 'doc') AND hour(lts) BETWEEN 22 AND 23) SELECT line_no, ts_us, text FROM h WHERE CAST(lts AS DATE) = (SELECT max(CAST(lts AS DATE)) FROM h)")
def latest_day_with_hours(spark: SparkSession, d: str) -> DataFrame:
    return search.search_time(events(spark, d), plan("late at night")).select("line_no", us("ts").alias("ts_us"), "text")


@query(f"WITH {REC} SELECT line_no, ts_us, text FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, src DESC, line_no DESC) AS k FROM rec WHERE type <> 'meta' AND {DAY_15}) WHERE k <= 40")
def fetch_day_latest_n(spark: SparkSession, d: str) -> DataFrame:
    return search.fetch_day(events(spark, d), plan("today")).select("line_no", us("ts").alias("ts_us"), "text")


_JANUARY = "lts >= TIMESTAMP '2024-01-01' AND lts < TIMESTAMP '2024-02-01'"


@query(f"WITH {REC} SELECT strftime(lts, '%Y-%m-%d') AS day, count(*) AS n FROM rec WHERE type NOT IN ('meta', 'doc') AND {_JANUARY} GROUP BY ALL")
def day_counts(spark: SparkSession, d: str) -> DataFrame:
    return search.day_counts(search.time_scope(events(spark, d), plan("in January")), TZ)


@query(f"WITH {REC} SELECT type, count(*) AS n FROM rec WHERE type NOT IN ('meta', 'doc') AND {_JANUARY} GROUP BY ALL")
def type_counts(spark: SparkSession, d: str) -> DataFrame:
    return search.type_counts(search.time_scope(events(spark, d), plan("in January")))


@query(f"WITH {REC} SELECT count(*) AS total, count(*) FILTER (WHERE contains(text, 'purchase')) AS kw_total, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM rec WHERE type NOT IN ('meta', 'doc') AND {_JANUARY}")
def range_totals(spark: SparkSession, d: str) -> DataFrame:
    return search.range_totals(events(spark, d), plan("purchase in January"))


@query(f"WITH {REC} SELECT line_no, text FROM rec WHERE type <> 'meta' AND actor = 'ai'")
def actor_filter(spark: SparkSession, d: str) -> DataFrame:
    return search.searchable(events(spark, d), "ai").select("line_no", "text")


# --------------------------------------------------------------- words


@query(rf"WITH {MREC}, {TOK}, g AS (SELECT src, line_no, unnest(t) AS gram FROM mts) SELECT gram, count(*) AS tf, count(DISTINCT (src, line_no)) AS df FROM g GROUP BY gram")
def bigram_postings(spark: SparkSession, d: str) -> DataFrame:
    return grams.postings(messages(spark, d, False), search.KEY).groupBy("gram").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


_OR = [grams.query_tokens("heating bill")]
_AND = [grams.query_tokens("budget"), grams.query_tokens("Friday")]


def _scored(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.round("score", 9).desc(), *search.KEY).limit(50).select(*search.KEY, F.round("score", 6).alias("score"))


@query(bm25_sql(_OR, 50))
def bm25_or(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d, False)
    return _scored(grams.bm25(search.searchable(m), _OR, grams.statistics(m, _OR[0])))


@query(bm25_sql(_AND, 50))
def bm25_and(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d, False)
    return _scored(grams.bm25(search.searchable(m), _AND, grams.statistics(m, _AND[0] + _AND[1])))


@query(bm25_sql(_AND, 50).replace("r.type <> 'meta' AND ", ""))
def bm25_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same from a written index, of which only the row groups of the query's grams are read."""
    path = scratch(spark, "index")
    grams.write_index(messages(spark, d, False), path, search.KEY, files=8)
    return _scored(grams.bm25_indexed(path, spark, _AND, search.KEY))


@query(f"WITH {MREC} SELECT src, line_no, text FROM (SELECT *, row_number() OVER (ORDER BY ts_us DESC, src, line_no) AS k FROM mrec WHERE ts_us IS NOT NULL AND type <> 'meta') WHERE k <= 20")
def recent_fallback(spark: SparkSession, d: str) -> DataFrame:
    return search.search(messages(spark, d), plan(""), 20).select("src", "line_no", "text")


@query(bm25_sql(_AND, 8))
def search_cascade(spark: SparkSession, d: str) -> DataFrame:
    return search.search(messages(spark, d), plan("what did we say about the budget Friday"), 8, untimed=messages(spark, d, False)).select("src", "line_no", F.round("score", 6).alias("score"))


@query(f"""WITH {MREC}, p AS (SELECT *, row_number() OVER (ORDER BY src, line_no) AS pos FROM mrec), h AS (SELECT pos, session FROM (SELECT *, row_number() OVER (ORDER BY ts_us DESC, src, line_no) AS k FROM mrec WHERE ts_us IS NOT NULL AND type <> 'meta' AND contains(text, 'vector store')) t JOIN p USING (src, line_no, session) WHERE k <= 12)
        SELECT p.src, p.line_no, bool_or(p.pos = h.pos) AS is_hit FROM p JOIN h ON abs(p.pos - h.pos) <= 2 AND p.session IS NOT DISTINCT FROM h.session GROUP BY ALL""".replace("USING (src, line_no, session)", "USING (src, line_no)").replace("SELECT pos, session FROM (SELECT *,", "SELECT pos, p.session FROM (SELECT src, line_no,"))
def context_rows(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    hits = m.where(F.col("ts").isNotNull() & (F.col("type") != "meta") & F.col("text").contains("vector store")).orderBy(F.col("ts").desc(), *search.KEY).limit(12)
    return search.with_context(messages(spark, d, False), hits, 2).select("src", "line_no", "is_hit")


@query(r"""WITH m AS (SELECT src_day AS src, line_no, lower(text) AS low, text, list_filter(regexp_extract_all(text, '[ァ-ヶー]{2,}|[一-龥々]{2,}|[一-龥々][ぁ-ん]|[A-Za-z0-9][A-Za-z0-9_\-]+'), lambda w: NOT list_contains([%s], lower(w)) AND NOT regexp_full_match(w, '[一-龥々][%s]')) AS w FROM (SELECT src_day, line_no, text FROM meta GROUP BY ALL) WHERE text IS NOT NULL)
        SELECT src, line_no, array_to_string(list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 5), ' ') AS keywords, md5(text) AS h FROM m""" % (", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys([*v.STOPWORDS, *v.EN_STOPWORDS])), v.PARTICLES))
def message_keywords(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "meta").select(F.col("src_day").alias("src"), "line_no", "text").where("text is not null").distinct()
    return m.select("src", "line_no", F.array_join(textprep.column_keywords(F.col("text")), " ").alias("keywords"), F.md5(F.col("text").cast("binary")).alias("h"))


@query(r"SELECT rowid, " + " OR ".join(f"contains(lower(text), '{t.lower()}')" for t in v.TRIGGERS) + " AS recall, " + " OR ".join("contains(text, '" + w.replace("'", "''") + "')" for w in v.HEAT_WORDS) + " AS heat, " + " OR ".join(f"contains(text, '{t}')" for t in v.NEGATIVE_MARKERS) + " AS negative FROM meta WHERE text IS NOT NULL")
def message_signals(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "meta").where("text is not null").select("rowid", textprep.should_recall(t).alias("recall"), textprep.has_heat(t).alias("heat"), textprep.is_negative(t).alias("negative"))


_HEDGES = ["Nothing on", "nobody had touched"]


@query(f"WITH {MREC}, c AS (SELECT *, " + " OR ".join(f"contains(text, '{h}')" for h in _HEDGES) + " AS negative FROM mrec WHERE ts_us >= 1790000000000000) SELECT src, line_no, negative, k FROM (SELECT *, row_number() OVER (ORDER BY negative, ts_us DESC, src, line_no) AS k FROM c) WHERE k <= 200")
def negatives_last(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).where(us("ts") >= 1_790_000_000_000_000).withColumn("negative", textprep.is_negative(F.col("text"), _HEDGES))
    return fuse.rank(m.orderBy("negative", F.col("ts").desc(), *search.KEY).limit(200), "negative", F.col("ts").desc(), *search.KEY).select("src", "line_no", "negative", F.col("rank").alias("k"))


_ECHO = "What did I say about the backup plan around noon on Saturday"


@query(f"WITH {MREC} SELECT src, line_no FROM mrec WHERE ts_us IS NULL OR NOT (ts_us > epoch_us(TIMESTAMP '2026-09-23 23:45:00') OR (ts_us > epoch_us(TIMESTAMP '2026-09-22') AND (" + " OR ".join(f"contains(regexp_replace(text, '[\\t-\\r\\x{{85}}\\p{{Z}}]', '', 'g'), '{w}')" for w in textprep.echo_windows(_ECHO)) + ")))")
def echo_filter(spark: SparkSession, d: str) -> DataFrame:
    return fuse.without_echo(messages(spark, d), _ECHO, META_NOW).select("src", "line_no")


_TAIL = ["backup", "plan", "index", "rebuild", "Friday", "budget"]


@query(f"""WITH {MREC}, f AS (SELECT *, """ + " + ".join(f"contains(lower(text), '{w.lower()}')::INT" for w in _TAIL) + """ AS n_match FROM mrec WHERE ts_us >= epoch_us(TIMESTAMP '2026-09-20') AND length(text) >= 10 AND type <> 'meta')
        SELECT src, line_no, n_match FROM (SELECT *, row_number() OVER (ORDER BY n_match DESC, ts_us DESC, src, line_no) AS k FROM f WHERE n_match >= 2) WHERE k <= 30""")
def live_tail(spark: SparkSession, d: str) -> DataFrame:
    fresh = messages(spark, d).where(us("ts") >= 1_789_862_400_000_000)
    return search.live_tail(fresh, _TAIL, limit=30).select("src", "line_no", "n_match")


# --------------------------------------------------------------- meaning, fusion


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(dist, 6) AS distance FROM (SELECT vec_id, list_distance(embedding::DOUBLE[], e::DOUBLE[]) AS dist, row_number() OVER (ORDER BY list_distance(embedding::DOUBLE[], e::DOUBLE[]), vec_id) AS k FROM embeddings, q) WHERE k <= 10")
def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    vector = [float(x) for x in e.where("vec_id = 7").select("embedding").first()[0]]
    return semantic.knn(e, vector, 10, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query("""WITH p AS (SELECT a.vec_id AS q_id, b.vec_id AS vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
        SELECT q_id, vec_id, round(dist, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(dist, 9), vec_id) AS k FROM p) WHERE k <= 5""")
def knn_queries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    return semantic.knn_many(e, q, 5, "vec_id", "q_id").select("q_id", "vec_id", F.round("distance", 5).alias("distance"))


@query()
def knn_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the exact five nearest that the lists give, over the same queries."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    centres = semantic.centroids(e, 32)
    found = semantic.knn_lists(e, q, 5, "vec_id", "q_id", centres, 16)
    exact = semantic.knn_many(e, q, 5, "vec_id", "q_id").select("q_id", "vec_id")
    both = exact.join(found.select("q_id", "vec_id", F.lit(1).alias("hit")), ["q_id", "vec_id"], "left")
    return both.agg(F.count("*").alias("wanted"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 3).alias("recall"))


@query(f"""WITH {MREC}, k AS (SELECT *, type = 'text' AS t FROM mrec WHERE type <> 'meta')
        SELECT src, line_no, md5(CASE WHEN t THEN array_to_string(list_filter([substr(lag(text) OVER w, 1, 400), substr(text, 1, 1600), substr(lead(text) OVER w, 1, 400)], lambda x: x IS NOT NULL), chr(10)) ELSE text END) AS h FROM k WINDOW w AS (PARTITION BY src, t ORDER BY line_no)""")
def embed_context_window(spark: SparkSession, d: str) -> DataFrame:
    return semantic.context_window(messages(spark, d, False)).select("src", "line_no", F.md5(F.col("context").cast("binary")).alias("h"))


@query()
def embed_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Messages nearest to a question by hashed n-grams."""
    e = semantic.HashedNgrams()
    vectors = semantic.context_window(messages(spark, d, False)).select(F.struct(*search.KEY).alias("k"), semantic.embed_column(F.col("context"), e).alias("embedding"))
    vector = e.encode(["how much was the heating bill"])[0].tolist()
    return semantic.knn(vectors, vector, 20, "k").select("k.*", F.round("distance", 6).alias("distance"))


@query(f"""WITH {REC}, q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 3),
        n AS (SELECT vec_id, list_distance(embedding::DOUBLE[], e::DOUBLE[]) AS dist FROM embeddings, q), nr AS (SELECT *, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM n),
        near AS (SELECT rec.*, rank, dist FROM rec JOIN nr ON vec_id = line_no WHERE rank <= 20),
        ex AS (SELECT *, NULL::DOUBLE AS dist FROM (SELECT *, row_number() OVER (ORDER BY ts_us, line_no) AS rank FROM rec WHERE contains(text, 'purchase')) WHERE rank <= 20),
        u AS (SELECT ts_us, text, line_no, rank, dist FROM near UNION ALL SELECT ts_us, text, line_no, rank, dist FROM ex),
        f AS (SELECT ts_us, substr(text, 1, 40) AS k, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(dist) AS distance, min(line_no) AS line_no FROM u GROUP BY ALL),
        s AS (SELECT *, rrf * (0.5::DOUBLE + 0.5::DOUBLE * pow(0.5::DOUBLE, greatest(0, (epoch_us(TIMESTAMP '2024-01-31') - ts_us) / 86400000000.0::DOUBLE) / 30.0::DOUBLE)) AS score, min(distance) OVER () AS best FROM f)
        SELECT line_no, round(distance, 6) AS distance, round(score, 6) AS score, best > 0.51 AS confirm FROM (SELECT *, max(score) OVER () AS top FROM s) WHERE score >= 0.35::DOUBLE * top AND best <= 0.6""")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    e, rec = table(spark, d, "embeddings"), events(spark, d)
    vector = [float(x) for x in e.where("vec_id = 3").select("embedding").first()[0]]
    hits = fuse.rank(semantic.knn(e, vector, 20, "vec_id"), "distance", "vec_id")
    near = rec.join(F.broadcast(hits), F.col("line_no") == F.col("vec_id"))
    exact = fuse.rank(rec.where(F.col("text").contains("purchase")).orderBy("ts", "line_no").limit(20), "ts", "line_no")
    return fuse.fuse(exact, near, NOW, 60).select("line_no", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "confirm")


@query("SELECT min(rowid) AS rowid FROM meta GROUP BY ts, actor, text")
def dedupe_rows(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "meta").withColumn("type", F.lit(None).cast("string"))
    return search.dedupe(m, ["rowid"]).select("rowid")


@query(time_sql(DAY_15, ["purchase"], "line_no, text").replace(", CASE WHEN enough THEN 'L1' ELSE 'L2' END AS level", ""))
def recall_in_time(spark: SparkSession, d: str) -> DataFrame:
    """The router, from the question to rows."""
    result = recall(Corpus(events(spark, d)), "what did I purchase on 2024-01-15", Config(timezone=TZ), datetime(2024, 1, 15, 12))
    assert not result.errors, result.errors
    return result.rows.select("line_no", "text")


@query()
def recall_by_words(spark: SparkSession, d: str) -> DataFrame:
    """Words and meaning fused, in order of score."""
    m, e = stored(spark, d), semantic.HashedNgrams()
    vectors = cut(semantic.context_window(m).select(*search.KEY, semantic.embed_column(F.col("context"), e).alias("embedding")))
    result = recall(Corpus(m, vectors, None, e), "the heating bill and the garden plan", Config(), META_NOW)
    assert not result.errors, result.errors
    return result.rows.select("src", "line_no", F.round("score", 6).alias("score"), "confirm")


@query("FROM (VALUES ('yesterday evening about the budget', '2024-01-14', '2024-01-14', 17, 21, 'budget'), ('last week', '2024-01-08', '2024-01-14', -1, -1, ''), ('in October the invoice', '2023-10-01', '2023-10-31', -1, -1, 'invoice'), ('the first time last week we mentioned printing', '', '', -1, -1, 'printing'), ('3日前の予算', '2024-01-12', '2024-01-12', -1, -1, '予算'), ('2 weeks ago around 3 pm', '2023-12-29', '2024-01-04', 14, 17, ''), ('11月の夜', '2023-11-01', '2023-11-30', 18, 24, ''), ('good morning budget', '', '', -1, -1, 'good budget')) t(q, first_day, last_day, h1, h2, words)")
def parsed_queries(spark: SparkSession, d: str) -> DataFrame:
    texts = ["yesterday evening about the budget", "last week", "in October the invoice", "the first time last week we mentioned printing", "3日前の予算", "2 weeks ago around 3 pm", "11月の夜", "good morning budget"]
    plans = [plan(t) for t in texts]
    rows = [(p.text, *(map(str, p.days) if p.days else ("", "")), *(p.hours or (-1, -1)), " ".join(g[0] for g in p.keywords)) for p in plans]
    return spark.createDataFrame(rows, "q string, first_day string, last_day string, h1 int, h2 int, words string")


@query("FROM (VALUES ('2024-01-14', '2024-01-14', 17, 21, 'budget')) t(first_day, last_day, hour_from, hour_to, words)")
def sql_time_query(spark: SparkSession, d: str) -> DataFrame:
    sql.register(spark)
    return spark.sql("SELECT first_day, last_day, hour_from, hour_to, array_join(keywords, ' ') AS words FROM time_query('yesterday evening about the budget', '2024-01-15', 'America/New_York')")



#: Phrases for every rule of the grammar, with the days they mean on Monday, 2024-01-15, as SQL, and hours (-1: none).
PHRASES = [
    ("2023-09-02 budget", "DATE '2023-09-02'", "DATE '2023-09-02'", -1, -1), ("2023/9/2", "DATE '2023-09-02'", "DATE '2023-09-02'", -1, -1), ("7月19日の話", "DATE '2024-07-19'", "DATE '2024-07-19'", -1, -1), ("2022年7月19日", "DATE '2022-07-19'", "DATE '2022-07-19'", -1, -1),
    ("2022年7月", "DATE '2022-07-01'", "last_day(DATE '2022-07-01')", -1, -1), ("12月の夜", "DATE '2023-12-01'", "last_day(DATE '2023-12-01')", 18, 24), ("1月", "DATE '2024-01-01'", "last_day(DATE '2024-01-01')", -1, -1), ("3日前", "d - 3", "d - 3", -1, -1), ("2週間前", "d - 17", "d - 11", -1, -1),
    ("2年前", "DATE '2022-01-01'", "DATE '2022-12-31'", -1, -1), ("3ヶ月前", "DATE '2023-10-01'", "last_day(DATE '2023-10-01')", -1, -1), ("一昨日の朝", "d - 2", "d - 2", 5, 11), ("おととい", "d - 2", "d - 2", -1, -1), ("昨夜", "d - 1", "d - 1", 18, 24), ("今朝", "d", "d", 5, 11), ("昨日の夕食", "d - 1", "d - 1", -1, -1),
    ("今日", "d", "d", -1, -1), ("先週", "d - 7", "d - 1", -1, -1), ("先々月", "DATE '2023-11-01'", "last_day(DATE '2023-11-01')", -1, -1), ("先月", "DATE '2023-12-01'", "last_day(DATE '2023-12-01')", -1, -1), ("一昨年", "DATE '2022-01-01'", "DATE '2022-12-31'", -1, -1), ("去年", "DATE '2023-01-01'", "DATE '2023-12-31'", -1, -1),
    ("July 19th", "DATE '2024-07-19'", "DATE '2024-07-19'", -1, -1), ("jul. 19", "DATE '2024-07-19'", "DATE '2024-07-19'", -1, -1), ("19th of July", "DATE '2024-07-19'", "DATE '2024-07-19'", -1, -1), ("in March", "DATE '2023-03-01'", "last_day(DATE '2023-03-01')", -1, -1), ("during January", "DATE '2024-01-01'", "last_day(DATE '2024-01-01')", -1, -1),
    ("three days ago", "d - 3", "d - 3", -1, -1), ("a week ago", "d - 10", "d - 4", -1, -1), ("2 months ago", "DATE '2023-11-01'", "last_day(DATE '2023-11-01')", -1, -1), ("one year ago", "DATE '2023-01-01'", "DATE '2023-12-31'", -1, -1), ("the day before yesterday", "d - 2", "d - 2", -1, -1), ("yesterday's notes", "d - 1", "d - 1", -1, -1),
    ("last night", "d - 1", "d - 1", 18, 24), ("tonight", "d", "d", 18, 24), ("this afternoon", "d", "d", 12, 18), ("last week in the evening", "d - 7", "d - 1", 17, 21), ("the month before last", "DATE '2023-11-01'", "last_day(DATE '2023-11-01')", -1, -1), ("last month", "DATE '2023-12-01'", "last_day(DATE '2023-12-01')", -1, -1),
    ("year before last", "DATE '2022-01-01'", "DATE '2022-12-31'", -1, -1), ("last year", "DATE '2023-01-01'", "DATE '2023-12-31'", -1, -1), ("9/2", "DATE '2024-09-02'", "DATE '2024-09-02'", -1, -1), ("may I ask", "NULL", "NULL", -1, -1), ("2023-02-30", "NULL", "NULL", -1, -1), ("99/99", "NULL", "NULL", -1, -1),
    ("夜勤の朝", "NULL", "NULL", 5, 11), ("3時頃", "NULL", "NULL", 2, 5), ("15時", "NULL", "NULL", 15, 16), ("3時間", "NULL", "NULL", -1, -1), ("深夜", "NULL", "NULL", 0, 5), ("夕方", "NULL", "NULL", 16, 19), ("good night", "NULL", "NULL", -1, -1), ("overnight", "NULL", "NULL", -1, -1), ("goodnight", "NULL", "NULL", -1, -1), ("at 3pm", "NULL", "NULL", 15, 16),
    ("around 3 p.m.", "NULL", "NULL", 14, 17), ("9:30 am", "NULL", "NULL", 9, 10), ("12 am", "NULL", "NULL", 0, 1), ("13 pm", "NULL", "NULL", -1, -1), ("early morning", "NULL", "NULL", 4, 7), ("late at night", "NULL", "NULL", 22, 24), ("at noon", "NULL", "NULL", 11, 13),
]


@query("WITH t(q, a, b, h1, h2) AS (VALUES " + ", ".join(f"('{q.replace(chr(39), chr(39) * 2)}', {a.replace('d ', 'd0 ') if a != 'd' else 'd0'}, {b.replace('d ', 'd0 ') if b != 'd' else 'd0'}, {h1}, {h2})" for q, a, b, h1, h2 in PHRASES).replace("d0", "DATE '2024-01-15'") + ") SELECT q, strftime(CAST(a AS DATE), '%Y-%m-%d') AS first_day, strftime(CAST(b AS DATE), '%Y-%m-%d') AS last_day, h1, h2 FROM t")
def time_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Every rule of the grammar."""
    plans = [parse(q, TODAY, "UTC") for q, *_ in PHRASES]
    rows = [(p.text, *(map(str, p.days) if p.days else (None, None)), *(p.hours or (-1, -1))) for p in plans]
    return spark.createDataFrame(rows, "q string, first_day string, last_day string, h1 int, h2 int")


@query("FROM (VALUES ('budget', 'budget'), ('buget', 'buget, budget')) t(q, spellings) UNION ALL SELECT 'the bill', 'the invoice, the receipt'")
def spellings_and_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """A keyword with the right spelling beside the one that was heard, and a query with synonyms in place of a word."""
    rows = [(q, ", ".join(textprep.expand(q, {"buget": "budget"}))) for q in ("budget", "buget")]
    rows.append(("the bill", ", ".join(textprep.query_variants("the bill", {"bill": ["invoice", "receipt", "note"]}))))
    return spark.createDataFrame(rows, "q string, spellings string")


@query(rf"WITH {MREC}, f AS (SELECT *, " + " + ".join(f"contains(lower(text), '{w.lower()}')::INT" for w in _TAIL) + r""" AS n_match FROM mrec WHERE ts_us >= epoch_us(TIMESTAMP '2026-09-20') AND length(text) >= 10 AND type <> 'meta'),
        g AS (SELECT *, coalesce(strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M'), '') AS t, substr(text, 1, 40) AS x FROM f WHERE n_match >= 2), shown AS (SELECT t, x FROM g WHERE line_no % 2 = 0)
        SELECT src, line_no, n_match FROM (SELECT *, row_number() OVER (ORDER BY n_match DESC, ts_us DESC, src, line_no) AS k FROM g WHERE (t, x) NOT IN (SELECT (t, x) FROM shown)) WHERE k <= 30""")
def live_tail_unseen(spark: SparkSession, d: str) -> DataFrame:
    """What the tail adds to hits that are shown already."""
    fresh = messages(spark, d).where(us("ts") >= 1_789_862_400_000_000)
    shown = fresh.where("line_no % 2 = 0")
    n = sum((F.lower("text").contains(w.lower()).cast("int") for w in _TAIL), F.lit(0))
    return search.live_tail(fresh, _TAIL, shown.where((F.length("text") >= 10) & (n >= 2) & (F.col("type") != "meta")), 30).select("src", "line_no", "n_match")


@query(f"""WITH {REC}, m AS (SELECT DISTINCT session, ts FROM rec WHERE type = 'meta' AND session = '7'), f AS (SELECT min(ts) AS a FROM rec WHERE session = '7'), w AS (SELECT coalesce(lead(ts) OVER o, a) AS lo, ts AS hi, row_number() OVER o AS n FROM m, f WINDOW o AS (ORDER BY ts DESC))
        SELECT line_no, session FROM rec, w WHERE n = 2 AND ts BETWEEN lo AND hi AND type NOT IN ('meta', 'doc')""")
def compacted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all sessions in the time of the second stretch before a compaction of one."""
    e = events(spark, d).withColumn("text", F.when(F.col("type") == "meta", F.concat(F.lit(v.META_HEADS[0]), F.lit(" "), "text")).otherwise(F.col("text")))
    return compacted(e, "7", 2).select("line_no", "session")


@query(time_sql(DAY_15, ["purchase"], "line_no, ts, actor, text").replace("SELECT line_no, ts, actor, text, CASE", "SELECT '[' || strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M') || '] ' || actor || ': ' || text AS line, CASE").replace(", CASE WHEN enough THEN 'L1' ELSE 'L2' END AS level", ""))
def recall_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines to read of an answer, in order of time, without the head."""
    config, now = Config(timezone=TZ), datetime(2024, 1, 15, 12)
    lines = format_lines(recall(Corpus(events(spark, d)), "what did I purchase on 2024-01-15", config, now), config, now)
    rows = [(x,) for x in lines if x.startswith("[20")]
    return spark.createDataFrame(rows, "line string")


# --------------------------------------------------------------- conversion and upkeep


@query(f"WITH {MREC} SELECT strftime((make_timestamp(ts_us) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d') AS day, count(*) AS n, sum(length(text))::BIGINT AS chars, min(md5(text)) AS lo, max(md5(text)) AS hi FROM mrec WHERE ts_us IS NOT NULL GROUP BY ALL")
def days_merged(spark: SparkSession, d: str) -> DataFrame:
    """Day files written from two thirds of the lines and brought up to date with the rest, late rows and repeated ones among them."""
    rows = ingest.day_rows(messages(spark, d).where("ts is not null"), TZ)
    first = rows.where("pmod(hash(origin), 3) <> 0")
    again = rows.where("pmod(hash(origin), 3) = 0 or pmod(hash(origin), 9) = 1")
    merged = ingest.merge(first, again)
    untouched = first.join(again.select("day").distinct(), "day", "left_anti").select(*merged.columns)
    return merged.unionByName(untouched).groupBy("day").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min(F.md5(F.col("text").cast("binary"))).alias("lo"), F.max(F.md5(F.col("text").cast("binary"))).alias("hi"))


@query(f"WITH {MREC} SELECT CASE WHEN starts_with(src, 'main/') THEN src ELSE 'corpus/' || regexp_replace(src, '^corpus/', '') END AS src, count(*) AS n, max(line_no) AS last FROM mrec GROUP BY ALL")
def corpus_sources(spark: SparkSession, d: str) -> DataFrame:
    """Day files and corpora written and scanned again."""
    folder = scratch(spark, "corpus")
    ingest.write_corpus(messages(spark, d), folder)
    return ingest.read_corpus(spark, folder).groupBy("src").agg(F.count("*").alias("n"), F.max("line_no").alias("last"))


@query("SELECT count(DISTINCT src_file) AS files, count(*) AS lines FROM sample_log")
def source_print(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "sample_log").select("src_file", "line_no", F.col("text").alias("line"))
    return ingest.fingerprint(log).select("files", "lines")


def _upkeep(spark: SparkSession, d: str) -> Indexes:
    """Indexes of an earlier state, some sources shorter, other or not there, one that is gone since, brought to the present."""
    now = cut(r.from_meta(table(spark, d, "meta"), False, ("ts", "text")))  # what indexes and their manifest read
    last = F.substring("src", -1, 1)
    then = now.where((F.col("line_no") < 30) & (last != "3")).withColumn("text", F.when((last == "7") & (F.col("line_no") == 0), "other").otherwise(F.col("text")))
    gone = cut(now.limit(1).withColumn("src", F.lit("main/0000-00-00")))
    index = Indexes(spark, scratch(spark, "upkeep"))
    index.tick(then.unionByName(gone), "then")
    index.tick(now, "now")
    return index


@query(SQL["bigram_postings"])
def postings_kept_up(spark: SparkSession, d: str) -> DataFrame:
    """Postings brought up to date must be those of a full build."""
    return _upkeep(spark, d).terms()


@query(bm25_sql(_AND, 50).replace("r.type <> 'meta' AND ", ""))
def bm25_kept_up(spark: SparkSession, d: str) -> DataFrame:
    return _scored(_upkeep(spark, d).bm25(_AND))


@query(f"WITH {MREC}, {TOK} SELECT count(*) AS records, count(DISTINCT src) AS sources, sum(len(t))::BIGINT AS terms FROM mts")
def index_totals(spark: SparkSession, d: str) -> DataFrame:
    return _upkeep(spark, d).totals()


# --------------------------------------------------------------- state


@query("""SELECT a.event_id FROM events a WHERE a.event_type = 'click' AND EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 120000000)""")
def origin_semi(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", "event_type")
    return state.near_origin(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "ts", 120).select("event_id")


@query(f"WITH {MREC} SELECT src, line_no FROM mrec WHERE NOT (contains(text, 'budget') OR contains(text, 'schedule') OR contains(text, 'rec_'))")
def done_topics(spark: SparkSession, d: str) -> DataFrame:
    return state.without_done(messages(spark, d, False).withColumn("topic", F.col("text")), ["budget", "schedule", "rec_"]).select("src", "line_no")


@query("SELECT event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM events) WHERE l IS NULL OR l <> event_type")
def topic_dedupe(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.struct("ts", "event_id").alias("o"), F.col("user_id").alias("session"), F.col("event_type").alias("topic"))
    return state.new_topics(e, "o").select("event_id")


_TREE = """n AS (SELECT user_id AS tree, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS id, ts, event_id FROM events), t AS (SELECT tree, id, CASE WHEN id = 1 THEN NULL WHEN id % 7 = 0 THEN id - 3 ELSE id - 1 END AS parent, ts, event_id FROM n)"""


@query(f"""WITH RECURSIVE {_TREE}, l AS (SELECT tree, id, ts FROM t WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.tree = t.tree AND c.parent = t.id)), ll AS (SELECT * FROM (SELECT *, max(ts) OVER (PARTITION BY tree) AS m FROM l) WHERE epoch_us(m) - epoch_us(ts) <= 6000 * 60000000::BIGINT),
        up AS (SELECT tree, id, ts = m AS newest FROM ll UNION SELECT t.tree, t.parent, newest FROM up JOIN t ON t.tree = up.tree AND t.id = up.id WHERE t.parent IS NOT NULL), a AS (SELECT tree, id, bool_or(newest) AS newest FROM up GROUP BY ALL)
        SELECT event_id, a.id IS NOT NULL AS alive, coalesce(a.newest, false) AS newest FROM t LEFT JOIN a USING (tree, id)""")
def live_branches(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as a tree: each follows the one before, every seventh the third before."""
    from pyspark.sql import Window

    n = table(spark, d, "events").select(F.col("user_id").alias("tree"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("id"), "ts", "event_id")
    tree = n.withColumn("parent", F.when(F.col("id") == 1, None).when(F.col("id") % 7 == 0, F.col("id") - 3).otherwise(F.col("id") - 1))
    return state.live_branches(tree, 6000).select("event_id", "alive", "newest")


@query("""WITH RECURSIVE o AS (SELECT user_id AS u, epoch_us(ts) AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM (SELECT DISTINCT user_id, ts FROM events)),
        b AS (SELECT u, rn, m, m AS st, 1 AS blk FROM o WHERE rn = 1 UNION ALL SELECT o.u, o.rn, o.m, CASE WHEN o.m - b.m > 18000000000 OR o.m - b.st > 54000000000 THEN o.m ELSE b.st END, b.blk + CASE WHEN o.m - b.m > 18000000000 OR o.m - b.st > 54000000000 THEN 1 ELSE 0 END FROM b JOIN o ON o.u = b.u AND o.rn = b.rn + 1)
        SELECT event_id, blk AS block FROM events JOIN b ON u = user_id AND m = epoch_us(ts)""")
def topic_blocks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return state.topic_blocks(e, "user_id", "ts", 300, 900).select("event_id", "block")


@query("""WITH e AS (SELECT *, ts >= TIMESTAMP '2024-01-20 11:00:00' AS recent, event_type = 'error' AS exempt FROM events WHERE ts < TIMESTAMP '2024-01-20 12:00:00'),
        f AS (SELECT *, row_number() OVER (PARTITION BY epoch_us(ts) // 1800000000, recent OR exempt ORDER BY ts, event_id) AS n FROM e) SELECT event_id FROM f WHERE recent OR exempt OR n = 1""")
def fold_buckets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("ts < timestamp_ntz'2024-01-20 12:00:00'").select("event_id", "ts", (F.col("event_type") == "error").alias("exempt"))
    return state.fold(e, "ts", datetime(2024, 1, 20, 12)).select("event_id")


_PREFIX = "|".join(p.replace(" ", r"\s+") for p in sorted(v.HEADLINE_PREFIXES, key=len, reverse=True))


@query(rf"""WITH {MREC}, b AS (SELECT src, line_no, CASE WHEN length(trim(s)) >= 6 THEN s ELSE text END AS base FROM (SELECT *, regexp_replace(text, '(?i)^(?:[,.\s]*(?:{_PREFIX})\b)*[,.\s]*', '') AS s FROM mrec)),
        p AS (SELECT *, list_slice(list_filter(list_transform(string_split_regex(base, '[。、!！?？\n]'), lambda x: trim(x)), lambda x: length(x) >= 4), 1, 8) AS ps FROM b),
        c AS (SELECT *, list_transform(ps, lambda x, i: {{'s': {" + ".join(f"3 * contains(x, '{w}')::INT" for w in v.TOPIC_WORDS)} + least(len(regexp_extract_all(x, '[一-鿿]{{2,}}')), 3) + least(len(regexp_extract_all(x, '[゠-ヿ]{{3,}}')), 2) + least(len(regexp_extract_all(x, '[A-Za-z0-9]{{2,}}')), 2) + ({" OR ".join(f"contains(x, '{w}')" for w in v.REQUEST_WORDS)})::INT + (i = 1)::INT, 'i': -i, 'p': x}}) AS sc FROM p)
        SELECT src, line_no, CASE WHEN len(ps) <= 1 THEN substr(base, 1, 25) ELSE CASE WHEN list_max(sc).i = -1 THEN '' ELSE '…' END || substr(list_max(sc).p, 1, 25) END AS headline FROM c""")
def headlines(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d, False).select("src", "line_no", state.headline(F.col("text")).alias("headline"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT ts, CASE WHEN event_type = 'signup' THEN 'topic ' || (event_id % 7) ELSE event_type || ' ' || props END AS text, event_type = 'signup' AS marker FROM events WHERE user_id % 2 = 0 AND ts <= TIMESTAMP '2024-01-20 12:00:00' AND ts >= TIMESTAMP '2024-01-20 08:00:00'),
        o AS (SELECT ts, row_number() OVER (ORDER BY ts) AS rn FROM (SELECT DISTINCT ts FROM e)), b AS (SELECT rn, ts, ts AS st, 1 AS blk FROM o WHERE rn = 1 UNION ALL SELECT o.rn, o.ts, CASE WHEN epoch_us(o.ts) - epoch_us(b.ts) > 300000000 OR epoch_us(o.ts) - epoch_us(b.st) > 900000000 THEN o.ts ELSE b.st END, b.blk + CASE WHEN epoch_us(o.ts) - epoch_us(b.ts) > 300000000 OR epoch_us(o.ts) - epoch_us(b.st) > 900000000 THEN 1 ELSE 0 END FROM b JOIN o ON o.rn = b.rn + 1),
        x AS (SELECT e.*, blk, contains(text, 'click') AS hot, row_number() OVER (PARTITION BY blk ORDER BY e.ts) AS k FROM e JOIN b USING (ts)), h AS (SELECT *, marker OR hot AS exempt, ts >= TIMESTAMP '2024-01-20 11:00:00' AS recent, row_number() OVER (PARTITION BY blk ORDER BY ts, marker, text) AS j FROM x WHERE k = 1 OR marker OR hot),
        f AS (SELECT *, row_number() OVER (PARTITION BY epoch_us(ts) // 1800000000, recent OR exempt ORDER BY ts, text) AS n FROM h)
        SELECT epoch_us(ts) AS ts_us, CASE WHEN hot AND NOT marker AND j > 1 THEN '!' ELSE '' END AS mark, CASE WHEN marker THEN text ELSE substr(substr(text, 1, 30), 1, 25) END AS headline FROM f WHERE recent OR exempt OR n = 1""")
def current_index(spark: SparkSession, d: str) -> DataFrame:
    """The last four hours of half the users on one timeline; clicks are what is hot, signups are markers."""
    e = table(spark, d, "events").where("user_id % 2 = 0")
    rows = e.where("event_type <> 'signup'").select("ts", F.concat_ws(" ", "event_type", "props").alias("text"), F.lit("").alias("mark")).distinct()
    markers = e.where("event_type = 'signup'").select("ts", F.concat(F.lit("topic "), (F.col("event_id") % 7).cast("string")).alias("topic"), F.lit(False).alias("done")).distinct()
    now = datetime(2024, 1, 20, 12)
    return current.index_rows(current.timeline(rows, markers, now), now, heat=["click"], topic_words=[]).select(us("ts").alias("ts_us"), "mark", "headline")


@query("""WITH e AS (SELECT user_id, ts, event_type = 'signup' AS w, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
        SELECT user_id, epoch_us(coalesce(max(ts) FILTER (WHERE w AND coalesce(gap, 3600000000) >= 3600000000), max(ts) FILTER (WHERE gap >= 18000000000), min(ts))) AS start_us FROM e GROUP BY user_id""")
def stretch_start(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", F.concat(F.col("event_type"), F.lit(" x")).alias("text"))
    return state.stretch_start(e, "user_id", "ts", "signup").select("user_id", us("start").alias("start_us"))


@query(f"""WITH {REC}, m AS (SELECT DISTINCT session, ts_us FROM rec WHERE type = 'meta'), f AS (SELECT session, min(ts_us) AS a FROM rec GROUP BY ALL)
        SELECT session, row_number() OVER w AS n, coalesce(lead(ts_us) OVER w, a) AS start_us, ts_us AS end_us FROM m JOIN f USING (session) WINDOW w AS (PARTITION BY session ORDER BY ts_us DESC)""")
def compaction_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Errors stand for notices that a session is continued."""
    e = events(spark, d).withColumn("text", F.when(F.col("type") == "meta", F.concat(F.lit(v.META_HEADS[0]), F.lit(" "), "text")).otherwise(F.col("text")))
    return search.compaction_ranges(e).select("session", "n", us("start").alias("start_us"), us("end").alias("end_us"))


@query("""WITH RECURSIVE o AS (SELECT user_id AS u, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 7200000000 THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY u ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM o)
        SELECT u AS user_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n_rows FROM s GROUP BY u, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a stream with a watermark, all that are open or closed when what is there has been read."""
    root = scratch(spark, "stream")
    static = table(spark, d, "events")
    source = spark.readStream.schema(static.schema).parquet(f"{d}/events.parquet" if _is_dir(spark, f"{d}/events.parquet") else f"{d}/events.parque[t]")
    found = sessions.session_stream(source.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", "2 hours", "1 hour")
    run = found.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{root}/out")).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_rows")


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


# --------------------------------------------------------------- changes


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "meta").select(F.col("src_day").alias("src"), "line_no", F.coalesce("text", F.lit("")).alias("line")).distinct()


def _earlier(lines: DataFrame) -> DataFrame:
    """An earlier state: 30 lines of each file at most, files of some days other or missing, one file that is gone since."""
    last = F.substring("src", -1, 1)
    old = lines.where((F.col("line_no") < 30) & (last != "3"))
    old = old.withColumn("line", F.when((last == "7") & (F.col("line_no") == 0), "other").otherwise(F.col("line")))
    return old.unionByName(lines.sparkSession.createDataFrame([("main/0000-00-00", 0, "x")], "src string, line_no int, line string"))


@query("""WITH l AS (SELECT DISTINCT src_day AS src, line_no FROM meta), n AS (SELECT src, count(*) AS n FROM l GROUP BY ALL), f AS (SELECT src, arg_min(coalesce(text, ''), line_no) AS t0 FROM (SELECT src_day AS src, line_no, text FROM meta) GROUP BY ALL)
        SELECT src, s AS status, n AS nlines, CASE s WHEN 'appended' THEN 30 WHEN 'unchanged' THEN n ELSE 0 END::BIGINT AS from_line FROM (SELECT *, CASE WHEN right(src, 1) = '3' THEN 'new' WHEN right(src, 1) = '7' AND t0 <> 'other' THEN 'rewritten' WHEN n > 30 THEN 'appended' ELSE 'unchanged' END AS s FROM n JOIN f USING (src))
        UNION ALL SELECT 'main/0000-00-00', 'gone', 0, 0""")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return manifest.classify(lines, manifest.snapshot(_earlier(lines))).select("src", "status", F.coalesce("nlines", F.lit(0)).alias("nlines"), "from_line")


@query("SELECT DISTINCT src_day AS src, line_no, md5(coalesce(text, '')) AS h FROM meta")
def incremental_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of the earlier state brought up to date; it must be what a full build gives."""
    lines = _lines(spark, d)
    old = _earlier(lines)
    return manifest.apply_changes(old, lines, manifest.classify(lines, manifest.snapshot(old)), 1).select("src", "line_no", F.md5(F.col("line").cast("binary")).alias("h"))


@query("SELECT src_day AS src FROM meta GROUP BY src_day HAVING count(*) > count(DISTINCT line_no)")
def damaged_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources with a line twice in what was delivered."""
    index = table(spark, d, "meta").select(F.col("src_day").alias("src"), "line_no")
    return manifest.damaged(index, manifest.snapshot(_lines(spark, d)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
