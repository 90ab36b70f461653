"""Raw logs to records: ``ts_raw, ts, actor, role, type, text, model, session, src, line_no``.

``ts`` is a timestamp without zone, in UTC; ``ts_raw`` and ``text`` are kept as they came. Lines are numbered as they stand in
their file, blank and broken ones included, so that ``(src, line_no)`` says where a record comes from whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairolog.config import Config
from kairolog.functions.textprep import is_meta
from kairolog.operators.timestamps import with_utc_instant

RECORD = T.StructType(
    [T.StructField(n, t) for n, t in (("ts_raw", T.StringType()), ("ts", T.TimestampNTZType()), ("actor", T.StringType()), ("role", T.StringType()), ("type", T.StringType()), ("text", T.StringType()), ("model", T.StringType()), ("session", T.StringType()), ("src", T.StringType()), ("line_no", T.IntegerType()))]
)
FIELDS = [f.name for f in RECORD.fields]
_TRIM = r"(?U)^\s+|\s+$"
_BLOCK = "type string, text string, name string, input string"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, _TRIM, "")


def clean(text: Column) -> Column:
    """Without blocks of local command caveats, trimmed."""
    return trim(F.regexp_replace(text, r"(?s)<local-command-caveat>.*?</local-command-caveat>", ""))


def ntz_from_micros(us: Column) -> Column:
    whole = (us - F.pmod(us, F.lit(1_000_000))) / 1_000_000
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (whole.cast("decimal(18,6)") + (F.pmod(us, F.lit(1_000_000)).cast("decimal(18,6)") / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(18,6)")).cast("decimal(18,6)"))


def with_ts(rows: DataFrame, raw: str = "ts_raw") -> DataFrame:
    """``ts`` from the raw timestamp; without zone it is UTC, unreadable it is null."""
    return with_utc_instant(rows, raw, out="_us").withColumn("ts", ntz_from_micros(F.col("_us"))).drop("_us")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``src_file, line_no, line``: every line of text files, numbered from 0. Files are read whole, so that numbers are their own."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("src_file"), "value")
    return files.select("src_file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def session_name(src_file: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(src_file, "/"), -1), r"\.[^.]*$", "")


def local_day(ts: Column, raw: Column, tz: str) -> Column:
    """Local day of a record as text; where the time can't be read, the first ten characters of what stands there."""
    return F.coalesce(F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(tz), ts), "yyyy-MM-dd"), F.substring(raw, 1, 10))


def plain_messages(messages: DataFrame, user: Column, ai: Column, model: Column) -> DataFrame:
    """Records of messages ``src_file, line_no, ts, role, text``. Without time or text there is no record."""
    is_user = F.coalesce(F.col("role") == "user", F.lit(False))
    step = messages.withColumn("text", clean(F.col("text"))).where(F.col("ts").isNotNull() & (F.col("ts") != "") & (F.col("text") != ""))
    rec = step.select(
        F.col("ts").alias("ts_raw"), F.when(is_user, user).otherwise(ai).alias("actor"), F.when(is_user, "user").otherwise("ai").alias("role"), F.when(is_meta(F.col("text")), "meta").otherwise("text").alias("type"),
        "text", F.when(~is_user, model).alias("model"), session_name(F.col("src_file")).alias("session"), session_name(F.col("src_file")).alias("src"), F.col("line_no").cast("int").alias("line_no"),
    )
    return with_ts(rec).select(*FIELDS)


def parse_plain(lines: DataFrame, config: Config) -> DataFrame:
    """Records of a plain log: a JSON object ``ts, role, text`` a line. Blank and broken lines are skipped."""
    one = lines.select("src_file", "line_no", F.from_json("line", "ts string, role string, text string").alias("j"))
    return plain_messages(one.select("src_file", "line_no", "j.*"), F.lit(config.user_name), F.lit(config.ai_name), F.lit(config.model_name))


def text_of(content: Column) -> Column:
    """Body of a transcript message: a string, or the text blocks of a list, one a line. ``content`` is JSON."""
    blocks = F.from_json(content, f"array<struct<{_BLOCK}>>")
    texts = F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), lambda t: t != "")
    plain = F.from_json(F.concat(F.lit('{"s":'), content, F.lit("}")), "s string")["s"]
    return trim(F.when(F.ltrim(content).startswith("["), F.array_join(texts, "\n")).when(F.ltrim(content).startswith('"'), plain).otherwise(""))


def actions_of(content: Column) -> Column:
    """``name: first string value of the input`` of each tool call in a list of blocks, at most 200 characters of the value."""
    calls = F.filter(F.from_json(content, f"array<struct<{_BLOCK}>>"), lambda b: b["type"] == "tool_use")

    def label(b: Column) -> Column:
        # a string value is what follows a key and stands in quotes; the order is that of the keys
        values = F.transform(F.regexp_extract_all(b["input"], F.lit(r'"(?:[^"\\]|\\.)*"\s*:\s*("(?:[^"\\]|\\.)*")'), F.lit(1)), lambda v: trim(F.from_json(F.concat(F.lit('{"s":'), v, F.lit("}")), "s string")["s"]))
        first = F.try_element_at(F.filter(values, lambda v: v != ""), F.lit(1))
        return F.concat(F.coalesce(F.nullif(b["name"], F.lit("")), F.lit("tool")), F.lit(": "), F.coalesce(F.substring(first, 1, 200), F.lit("")))

    return F.coalesce(F.transform(calls, label), F.array().cast("array<string>"))


def parse_transcript(lines: DataFrame, config: Config) -> DataFrame:
    """Records of a transcript: a row for the body and one for each tool call of the assistant."""
    j = F.from_json("line", "type string, timestamp string, uuid string, parentUuid string, message string").alias("j")
    step = lines.select("src_file", "line_no", j).select("src_file", "line_no", "j.*").where(F.col("type").isin("user", "assistant") & (F.col("timestamp") != "") & F.ltrim("message").startswith("{"))
    step = step.withColumn("content", F.from_json("message", "content string")["content"])
    raw = F.get_json_object("message", "$.content")
    is_list = F.ltrim(raw).startswith("[")
    body = clean(F.when(is_list, text_of(raw)).otherwise(F.coalesce("content", F.lit(""))))
    text_row = F.filter(F.array(F.struct(F.when(is_meta(body), "meta").otherwise("text").alias("type"), body.alias("text"))), lambda r: r["text"] != "")
    called = F.when((F.col("type") == "assistant") & is_list, actions_of(raw)).otherwise(F.array().cast("array<string>"))
    rows = F.concat(text_row, F.transform(called, lambda t: F.struct(F.lit("action").alias("type"), t.alias("text"))))
    is_user = F.col("type") == "user"
    rec = step.select("src_file", "line_no", "timestamp", is_user.alias("u"), F.explode(rows).alias("r")).select(
        F.col("timestamp").alias("ts_raw"), F.when(F.col("u"), config.user_name).otherwise(config.ai_name).alias("actor"), F.when(F.col("u"), "user").otherwise("ai").alias("role"), F.col("r.type").alias("type"), F.col("r.text").alias("text"),
        F.when(~F.col("u"), config.model_name).alias("model"), session_name(F.col("src_file")).alias("session"), session_name(F.col("src_file")).alias("src"), F.col("line_no").cast("int").alias("line_no"),
    )
    return with_ts(rec).select(*FIELDS)


#: Parsers by the name of the format; further ones may be added.
PARSERS = {"plain": parse_plain, "transcript": parse_transcript}


def from_events(events: DataFrame) -> DataFrame:
    """The driver's table of events as records: a user is a session, a day a source."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in {"purchase": "text", "click": "action", "view": "thinking", "signup": "doc", "error": "meta"}.items() for x in kv]), F.col("event_type"))
    return events.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts_raw"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.when(F.col("user_id") % 2 == 0, "user").otherwise("ai").alias("actor"), F.when(F.col("user_id") % 2 == 0, "user").otherwise("ai").alias("role"),
        kind.alias("type"), F.concat_ws(" ", "event_type", "props").alias("text"), F.lit(None).cast("string").alias("model"), F.col("user_id").cast("string").alias("session"), F.concat(F.lit("main/"), F.date_format("ts", "yyyy-MM-dd")).alias("src"), F.col("event_id").cast("int").alias("line_no"),
    )


def from_meta(meta: DataFrame, timed: bool = True, wanted: tuple[str, ...] = ("ts", "actor", "text", "session")) -> DataFrame:
    """The driver's table of indexed messages as records; lines delivered again count once, under their first row. Without ``timed`` the time is not read, ``ts`` is null,
    as are columns that are not ``wanted``; the text always is."""
    once = meta.groupBy("src_day", "line_no").agg(F.min_by(F.struct(*[F.col(c) if c in wanted else F.lit(None).cast("string").alias(c) for c in ("ts", "actor", "text", "session")]), "rowid").alias("r"))
    act = F.col("r.text").rlike(r"^(?:Bash|Read|Write|Search): ")
    rec = once.where(F.col("r.text").rlike(r"(?U)\S")).select(
        F.col("r.ts").alias("ts_raw"), F.col("r.actor").alias("actor"), F.lit(None).cast("string").alias("role"), F.when(is_meta(F.col("r.text")), "meta").when(act, "action").otherwise("text").alias("type"), F.col("r.text").alias("text"), F.lit(None).cast("string").alias("model"), F.col("r.session").alias("session"),
        F.col("src_day").alias("src"), F.col("line_no").cast("int").alias("line_no"),
    )
    return (with_ts(rec) if timed else rec.withColumn("ts", F.lit(None).cast("timestamp_ntz"))).select(*FIELDS)


def write_days(records: DataFrame, data_dir: str, tz: str) -> None:
    """Day files: one folder of JSON lines for each local day, ordered by time as written, then by source. Days written are replaced."""
    day = local_day(F.col("ts"), F.col("ts_raw"), tz)
    out = records.select(F.col("ts_raw").alias("ts"), "actor", "role", "type", "text", "model", "session", day.alias("day"), "src", "line_no")
    spread = out.repartition("day").sortWithinPartitions("day", "ts", "src", "line_no").drop("src", "line_no")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("day").json(f"{data_dir}/main")


def read_days_back(spark: SparkSession, data_dir: str) -> DataFrame:
    """Records of the day files; corrupt lines are skipped."""
    schema = "ts string, actor string, role string, type string, text string, model string, session string, day string"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{data_dir}/main").select(F.col("ts").alias("ts_raw"), "actor", "role", "type", "text", "model", "session", F.concat(F.lit("main/"), F.col("day")).alias("src"), F.monotonically_increasing_id().alias("_i"))
    from pyspark.sql import Window

    numbered = rows.withColumn("line_no", (F.row_number().over(Window.partitionBy("src").orderBy("ts_raw", "_i")) - 1).cast("int")).drop("_i")
    return with_ts(numbered).select(*FIELDS)
