"""One unambiguous instant from timestamps of many notations and zones (problem 1).

Everything stays in the JVM: one regular expression decides a notation and rewrites it to
``year|month|day|half|hour|minute|second|fraction|zone``, the parts are checked and put together, and a zone
is applied by its offset history.

Zones: an offset, abbreviation or zone named by the text decides; else the wall clock is that of the row's declared zone.
Where the declared zone is missing or unknown, `estimate_zones` looks for one: it aligns wall clocks with instants of the same
sequence and takes, of the candidate offset histories, the one with the fewest violations. UTC is its prior: another zone is taken only where the
data contradict UTC and agree with that zone (`settled`). Then instants are converted.

Defined results: text that names no date or no time of day, or one that does not exist, gives null. Wall-clock time that
occurs twice means the earlier instant; skipped wall-clock time is read with the offset in force before the change.
Digits past microseconds are cut off. Null gives null, an unknown zone name means UTC.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Zone abbreviations with one meaning in this data's regions, in minutes (fixed values).
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "NST": -210, "NDT": -150, "BRT": -180,
}

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_OFFSET = r"[+-]\d{1,2}(?::?\d{2})?"
_ZONE = rf"((?:[Zz]|(?:UTC|GMT)?{_OFFSET}|[A-Za-z]{{2,5}})?(?:\[[A-Za-z0-9_+/-]+\])?)"
_DAY = r"(?:[A-Za-z]{3,9},? +)?"

#: Notations: pattern and the form it is rewritten to.
NOTATIONS = [
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[Tt]| +){_CLOCK}(?: *([AaPp][Mm]))? *{_ZONE}$", "$1|$2|$3|$8|$4|$5|$6|$7|$9"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)? *{_ZONE}$", "$1|$2|$3||$4|$5|$6|$7|$8"),
    (rf"^(\d{{4}})年 *(\d{{1,2}})月 *(\d{{1,2}})日 *(午前|午後)? *(\d{{1,2}})時 *(\d{{1,2}})分(?: *(\d{{1,2}})(?:[.](\d+))?秒)? *{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (rf"^{_DAY}([A-Za-z]{{3,9}})\.? +(\d{{1,2}})(?:st|nd|rd|th)?,? +(\d{{4}}),? +{_CLOCK}(?: *([AaPp][Mm]))? *{_ZONE}$", "$3|$1|$2|$8|$4|$5|$6|$7|$9"),
    (rf"^{_DAY}(\d{{1,2}})(?:st|nd|rd|th)? +([A-Za-z]{{3,9}})\.?,? +(\d{{4}}),? +{_CLOCK}(?: *([AaPp][Mm]))? *{_ZONE}$", "$3|$2|$1|$8|$4|$5|$6|$7|$9"),
]

_ISO, _ISO_OFFSET = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?", r"(?:Z|[+-]\d\d:\d\d)"
_OUTER = "^[\\s\\u00a0\\u3000\\ufeff]+|[\\s\\u00a0\\u3000\\ufeff]+$"


def ntz_micros(c: Column) -> Column:
    """Microseconds since 1970-01-01T00:00 of a timestamp without zone; no session zone takes part."""
    second = F.hour(c) * 3600 + F.minute(c) * 60
    exact = F.extract(F.lit("SECOND"), c)
    return F.unix_date(c.cast("date")).cast("bigint") * 86_400_000_000 + second.cast("bigint") * 1_000_000 + (exact * 1_000_000).cast("bigint")


def wall_to_utc_micros(wall: Column, zone: Column) -> Column:
    """Instant of wall-clock time in a valid zone: the earlier one if it occurs twice, the offset before the change if it is skipped."""
    return ntz_micros(F.convert_timezone(zone, F.lit("UTC"), wall))


def _staged(rows: DataFrame, ts: str, utc: bool = False) -> DataFrame:
    """``rows`` with the parts of a timestamp: ``_wall`` (without zone), ``_offset`` (seconds), ``_named`` (a zone as written), ``_unix`` (micros).

    Each step is a projection of its own, so that what a later step uses several times is computed once. The plain ISO notation with an offset (with
    ``utc`` also without) is read by Spark's own parser and skips the steps, as they get null.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns]
    c = F.col
    iso = c(f"`{ts}`").rlike(_ISO + (_ISO_OFFSET + "?$" if utc else _ISO_OFFSET + "$"))
    zoned = F.when(c(f"`{ts}`").rlike(_ISO_OFFSET + "$"), c(f"`{ts}`")).otherwise(F.concat(c(f"`{ts}`"), F.lit("Z")))
    step = rows.select(*kept, F.when(iso, F.unix_micros(zoned.try_cast("timestamp"))).alias("_fast"), F.when(~iso, F.translate(F.regexp_replace(c(f"`{ts}`"), _OUTER, ""), "−‐‑–", "----")).alias("_clean"))
    form = reduce(lambda rest, n: F.when(c("_clean").rlike(n[0]), F.regexp_replace("_clean", n[0], n[1])).otherwise(rest), reversed(NOTATIONS), F.lit(None).cast("string"))
    step = step.select(*kept, "_fast", "_clean", F.split(form, r"\|").alias("_part"))
    at = lambda i: F.get("_part", i)
    digits = r"^(?:UTC|GMT)?[+-](\d{1,2}):?(\d{2})?"
    step = step.select(
        *kept, "_fast", "_clean", at(0).try_cast("int").alias("_y"), F.lower(F.substring(at(1), 1, 3)).alias("_mon"), at(1).try_cast("int").alias("_mo"), at(2).try_cast("int").alias("_d"), F.lower(at(3)).alias("_half"),
        at(4).try_cast("int").alias("_h"), at(5).try_cast("int").alias("_mi"), F.coalesce(at(6).try_cast("int"), F.lit(0)).alias("_s"), F.rpad(F.coalesce(at(7), F.lit("")), 6, "0").try_cast("int").alias("_us"), at(8).alias("_z"),
        F.when(c("_clean").rlike(r"^-?\d{1,19}(?:\.\d+)?$"), F.regexp_extract("_clean", r"^-?(\d+)", 1)).try_cast("bigint").alias("_n"),
    )
    known = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    half, hour = c("_half"), c("_h")
    fits = F.when(half.isin("am", "pm"), hour.between(1, 12)).when(half.isin("午前", "午後"), hour.between(0, 12)).otherwise(hour.between(0, 23))
    size = F.length(F.regexp_extract("_clean", r"^-?(\d+)", 1))
    part = lambda n: F.rpad(F.regexp_extract("_clean", r"\.(\d+)$", 1), n, "0").try_cast("bigint")
    below = F.when(c("_clean").startswith("-"), -1).otherwise(1)
    # Nanoseconds are cut downwards, also before 1970.
    unix = F.when(size <= 11, below * (c("_n") * 1_000_000 + part(6))).when(size <= 14, below * (c("_n") * 1000 + part(3))).when(size <= 17, below * c("_n")).otherwise(below * F.expr("_n div 1000") - F.when((below < 0) & (c("_n") % 1000 > 0), 1).otherwise(0))
    step = step.select(
        *kept, "_y", "_d", "_mi", "_us", "_s", "_z", F.coalesce("_mo", F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), c("_mon")).cast("int"), F.lit(0))).alias("_mo"),
        F.when(fits & (c("_s") <= 59), F.when(half == "", hour).otherwise(hour % 12 + F.when(half.isin("pm", "午後"), 12).otherwise(0))).alias("_h"),
        F.regexp_extract("_z", digits, 1).try_cast("int").alias("_oh"), F.coalesce(F.regexp_extract("_z", digits, 2).try_cast("int"), F.lit(0)).alias("_om"),
        F.try_element_at(known, F.upper(F.regexp_extract("_z", r"^([A-Za-z]{1,5})(?:\[|$)", 1))).alias("_short"), F.nullif(F.regexp_extract("_z", r"\[(.+)\]$", 1), F.lit("")).alias("_named"), F.coalesce("_fast", unix).alias("_unix"),
    )
    sign = F.when(c("_z").rlike("^(?:UTC|GMT)?-"), -1).otherwise(1)
    exact = c("_s").cast("decimal(16,6)") + (c("_us").cast("decimal(16,6)") / F.lit(1_000_000).cast("decimal(16,0)")).cast("decimal(16,6)")
    step = step.select(*kept, "_z", "_named", "_unix", F.coalesce(F.when((c("_oh") <= 18) & (c("_om") <= 59), sign * (c("_oh") * 3600 + c("_om") * 60)), c("_short") * 60).alias("_offset"), F.try_make_timestamp_ntz(c("_y"), c("_mo"), c("_d"), c("_h"), c("_mi"), exact.cast("decimal(16,6)")).alias("_wall"))
    unknown = (c("_z") != "") & c("_offset").isNull() & c("_named").isNull()  # an abbreviation nobody knows names no instant
    parts = F.struct("_offset", "_named", "_unix", F.when(~F.coalesce(unknown, F.lit(False)), c("_wall")).alias("_wall"))
    # A condition on the instant pushed below these steps would repeat all of them for each use of each part;
    # the optimizer pushes none below the elements of an array.
    return step.select(*kept, F.explode(F.array(parts)).alias("_parts")).select(*kept, "_parts.*")


def zone_names(spark: SparkSession) -> DataFrame:
    """``_zone_key, _zone_id``: every region of the time-zone database by its name in lower case (some 600 rows, fixed)."""
    import zoneinfo

    known = {z.lower(): z for z in zoneinfo.available_timezones() if not z.startswith(("posix", "right")) and z not in ("Factory", "localtime")}
    return spark.createDataFrame(pa.table({"_zone_key": sorted(known), "_zone_id": [known[k] for k in sorted(known)]}))


@lru_cache(maxsize=4)
def regions(first: tuple[str, ...] = ()) -> list[str]:
    """One region for each offset history from 2000 to 2037, looked at every week (some 185, fixed); those in ``first`` lead and stand for their like."""
    import zoneinfo

    weeks = [datetime(2000, 1, 1, tzinfo=UTC) + timedelta(weeks=i) for i in range(38 * 52)]
    known = sorted(z for z in zoneinfo.available_timezones() if not z.startswith(("posix", "right")) and z not in ("Factory", "localtime"))
    seen: dict[tuple, str] = {}
    for z in (*first, *known):
        seen.setdefault(tuple(w.astimezone(zoneinfo.ZoneInfo(z)).utcoffset() for w in weeks), z)
    return list(seen.values())


def zone_key(zone: Column) -> Column:
    return F.lower(F.regexp_replace(zone, _OUTER, ""))


_INNER = set("_fast _clean _part _y _mon _mo _d _half _h _mi _s _us _z _n _oh _om _short _named _unix _offset _wall _parts _declared _key _zone_key _zone_id _at".split())


def _apart(rows: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``rows`` with columns named like those of the steps here renamed, and how to name them back."""
    clash = {c: f"_kept_{i}" for i, c in enumerate(rows.columns) if c in _INNER}
    return (rows.withColumnsRenamed(clash) if clash else rows), {v: k for k, v in clash.items()}


def with_utc_instant(rows: DataFrame, ts: str, out: str = "utc_us") -> DataFrame:
    """As :func:`with_instant` for texts that name at most an offset or abbreviation; without one the wall clock is UTC. No join."""
    rows, back = _apart(rows)
    kept = [F.col(f"`{c}`") for c in rows.columns if c != out]
    instant = F.coalesce(F.col("_unix"), ntz_micros(F.col("_wall")) - F.coalesce("_offset", F.lit(0)).cast("bigint") * 1_000_000)
    return _staged(rows, ts, utc=True).select(*kept, instant.alias(out)).withColumnsRenamed(back)


def with_instant(rows: DataFrame, ts: str, zone: Column | None = None, out: str = "utc_us") -> DataFrame:
    """``rows`` with the instant of the column ``ts`` in microseconds; ``zone`` is the name of the row's declared zone.

    The only join is a broadcast of the fixed table of zone names. Columns of ``rows`` keep their names; a column named ``out`` is replaced.
    """
    names = F.broadcast(zone_names(rows.sparkSession))
    given, back = _apart(rows.withColumn("__zone", zone if zone is not None else F.lit("utc")))
    kept = [F.col(f"`{c}`") for c in given.columns if c not in (out, "__zone")]
    given = given.withColumnRenamed("__zone", "_declared")
    step = _staged(given, ts).withColumn("_key", zone_key(F.coalesce("_named", "_declared"))).join(names, F.col("_key") == F.col("_zone_key"), "left")
    walled = step.select(*kept, "_unix", "_offset", F.when(F.col("_offset").isNotNull(), F.col("_wall")).otherwise(F.convert_timezone(F.coalesce("_zone_id", F.lit("UTC")), F.lit("UTC"), F.col("_wall"))).alias("_at"))
    instant = F.coalesce(F.col("_unix"), ntz_micros(F.col("_at")) - F.coalesce("_offset", F.lit(0)).cast("bigint") * 1_000_000)
    return walled.select(*kept, instant.alias(out)).withColumnsRenamed(back)


def declared(rows: DataFrame, configs: DataFrame, key: str = "cfg_id", zone: str = "timezone") -> DataFrame:
    """``rows`` with ``declared_zone``, the zone of their configuration, null if that is missing or unknown; one row per configuration, whatever is repeated there."""
    one = configs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_cfg")).agg(F.max(zone).alias("_declared"))
    names = F.broadcast(zone_names(rows.sparkSession))
    one = one.join(names, zone_key(F.col("_declared")) == F.col("_zone_key"), "left").select("_cfg", F.col("_zone_id").alias("declared_zone"))
    return rows.join(one, rows[key] == F.col("_cfg"), "left").drop("_cfg")


def settled(estimates: DataFrame, source: str, least: int = 20) -> DataFrame:
    """``source, zone`` of the estimates to go by: at least ``least`` clocks were aligned, more than half of them violate the prior, and the zone found leaves at most a tenth of these violations."""
    return estimates.where((F.col("n") >= least) & (2 * F.col("prior_violations") > F.col("n")) & (10 * F.col("violations") <= F.col("prior_violations"))).select(source, "zone")


def log_instants(log: DataFrame, configs: DataFrame) -> DataFrame:
    """Rows of a raw log with ``utc_us``, null where the text names no instant. Configurations without a zone of their own get the one their logs speak for, or else UTC."""
    rows = declared(log, configs)
    open_ = with_parts(rows.where("declared_zone is null and cfg_id is not null").select("cfg_id", "src_file", "line_no", "ts"), "ts")
    open_ = open_.select("cfg_id", "src_file", "line_no", F.when(F.col("known_us").isNull(), F.col("wall")).alias("wall"), "known_us")
    found = settled(estimate_zones(open_, "cfg_id", "wall", "known_us", "src_file", "line_no", regions(("UTC",))), "cfg_id")
    both = rows.join(found.select(F.col("cfg_id").alias("_cfg"), F.col("zone").alias("_found")), F.col("cfg_id") == F.col("_cfg"), "left").withColumn("declared_zone", F.coalesce("declared_zone", "_found")).drop("_cfg", "_found")
    return with_instant(both, "ts", F.col("declared_zone")).drop("declared_zone")


def with_parts(rows: DataFrame, ts: str) -> DataFrame:
    """``rows`` with ``wall``, the clock as written, and ``known_us``, the instant where the text itself names a zone."""
    kept = [F.col(f"`{c}`") for c in rows.columns]
    step = _staged(rows, ts)
    known = F.coalesce("_unix", F.when(F.col("_offset").isNotNull(), ntz_micros(F.col("_wall")) - F.col("_offset").cast("bigint") * 1_000_000))
    return step.select(*kept, F.col("_wall").alias("wall"), known.alias("known_us"))


def estimate_zones(rows: DataFrame, source: str, wall: str, known_us: str, sequence: str, order: str, candidates: list[str], step_minutes: int = 5, block: int = 4096) -> DataFrame:
    """For each ``source`` the candidate whose offset history violates its data least: ``source, zone, n, violations, prior_violations``.

    A wall clock is aligned with the nearest instants known before and after it in its ``sequence`` (an ingestion time, or a row that names its
    zone). Read in the true zone it lies between the two, give or take ``step_minutes``. Rows are first counted by source, quarter
    and bounds, so what each candidate is tried on follows the hours that the data span, not their volume.
    Ties go to the first candidate, which is also the prior: ``prior_violations`` are its own. Sources with nothing to align give no row, rows without
    sequence or order are not aligned. A long sequence is aligned in blocks of ``block`` places, each of which gets the nearest instants outside from
    one row per block.
    """
    placed = rows.where(F.col(sequence).isNotNull() & F.col(order).isNotNull()).select(source, sequence, order, F.col(wall).alias("_w"), F.col(known_us).alias("_k"), F.floor(F.col(order) / block).alias("_b"))
    at = F.when(F.col("_k").isNotNull(), F.col(order))
    blocks = Window.partitionBy(sequence).orderBy("_b")
    ends = placed.groupBy(sequence, "_b").agg(F.max_by("_k", at).alias("_last"), F.min_by("_k", at).alias("_first"))
    ends = ends.select(sequence, "_b", F.last("_last", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"), F.first("_first", ignorenulls=True).over(blocks.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    seen = Window.partitionBy(sequence, "_b").orderBy(order)
    before = F.coalesce(F.last("_k", ignorenulls=True).over(seen.rowsBetween(Window.unboundedPreceding, 0)), "_earlier")
    after = F.coalesce(F.first("_k", ignorenulls=True).over(seen.rowsBetween(0, Window.unboundedFollowing)), "_later")
    unit = step_minutes * 60 * 1_000_000
    aligned = placed.join(ends, [sequence, "_b"]).select(source, "_w", before.alias("_lo"), after.alias("_hi")).where(F.col("_w").isNotNull() & (F.col("_lo").isNotNull() | F.col("_hi").isNotNull()))
    quarter = F.floor(ntz_micros(F.col("_w")) / unit)
    grouped = aligned.groupBy(source, quarter.alias("_q"), F.floor(F.col("_lo") / unit).alias("_lo"), F.floor(F.col("_hi") / unit).alias("_hi")).agg(F.count("*").alias("n"))
    wall_q = F.expr(f"timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, cast(_q * {unit // 1_000_000} as decimal(18,6)))")
    trial = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(z).alias("zone")) for i, z in enumerate(candidates)]))
    tried = grouped.withColumn("_c", trial).withColumn("_u", F.floor(wall_to_utc_micros(wall_q, F.col("_c.zone")) / unit))
    off = F.coalesce(F.col("_u") < F.col("_lo") - 1, F.lit(False)) | F.coalesce(F.col("_u") > F.col("_hi") + 1, F.lit(False))
    scored = tried.groupBy(source, "_c").agg(F.sum("n").alias("n"), F.sum(F.when(off, F.col("n")).otherwise(0)).alias("violations"))
    best = scored.groupBy(source).agg(F.min(F.struct("violations", "_c.i", "_c.zone", "n")).alias("b"), F.max(F.when(F.col("_c.i") == 0, F.col("violations"))).alias("prior_violations"))
    return best.select(source, F.col("b.zone").alias("zone"), F.col("b.n").alias("n"), F.col("b.violations").alias("violations"), "prior_violations")
