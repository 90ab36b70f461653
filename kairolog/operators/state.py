"""What is being talked about now: live branches, topic blocks, folding, headlines, topics."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from datetime import datetime
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from kairolog.functions import vocabulary as v
from kairolog.session import cut

MINUTE_US = 60_000_000


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp, for differences."""
    return F.unix_micros(ts.cast("timestamp"))


#: Nodes of a tree up to which it is walked within one task.
SMALL_TREE = 200_000


def live_branches(nodes: DataFrame, window_minutes: int = 15, small: int = SMALL_TREE) -> DataFrame:
    """``nodes`` (``tree, id, parent, ts`` and whatever else) with ``alive`` and ``newest``: whether the path from a live leaf passes through them.

    A leaf is nobody's parent, and live if it is at most ``window_minutes`` older than the newest leaf of its tree. Trees of up to ``small`` nodes
    are walked in batches of whole trees, after one exchange; larger ones by doubling over joins. Rows without tree or id are not alive. A cycle of parents has no
    leaf, so nothing in it is alive unless a branch hangs on it.
    """
    large = nodes.groupBy("tree").agg(F.count("*").alias("n")).where(F.col("n") > small).select("tree")
    if large.isEmpty():
        return _walked(nodes, window_minutes)
    large = cut(large)
    return _walked(nodes.join(large, "tree", "left_anti"), window_minutes).unionByName(_doubled(nodes.join(large, "tree", "left_semi"), window_minutes))


def _walked(nodes: DataFrame, window_minutes: int) -> DataFrame:
    def mark(tree: np.ndarray, id_: np.ndarray, parent: np.ndarray, us: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of tree, id and parent (-1: none) of whole trees: which rows are alive, and on the newest branch."""
        width = max(int(id_.max(initial=0)), int(parent.max(initial=0))) + 2
        known, at = np.unique(np.where(id_ >= 0, tree * width + id_ + 1, tree * width), return_inverse=True)  # node 0 of a tree: no id
        named = np.zeros(len(known), bool)
        named[at] = id_ >= 0
        key = tree * width + parent + 1
        slot = np.minimum(np.searchsorted(known, key), len(known) - 1)
        has = (parent >= 0) & (id_ >= 0) & (known[slot] == key)
        up = np.arange(len(known))
        up[at[has]] = slot[has]
        leaf = named.copy()
        leaf[slot[has]] = False
        when, of = np.full(len(known), np.iinfo(np.int64).min), np.zeros(len(known), np.int64)
        np.maximum.at(when, at, us)
        of[at] = tree
        last = np.full(int(tree.max(initial=0)) + 1, np.iinfo(np.int64).min)
        np.maximum.at(last, of[leaf], when[leaf])
        alive = leaf & (when >= last[of] - window_minutes * MINUTE_US)
        newest = leaf & (when == last[of])
        for _ in range(max(1, int(len(known)).bit_length())):
            for flag in (alive, newest):
                flag[up[flag]] = True
            up = up[up]
        return alive[at] & (id_ >= 0), newest[at] & (id_ >= 0)

    names = nodes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flagged(t: pa.Table) -> Iterator[pa.RecordBatch]:
            tree = t["tree"].combine_chunks().dictionary_encode()
            ids = pa.concat_arrays([t["id"].combine_chunks(), t["parent"].combine_chunks().cast(t["id"].type)]).dictionary_encode().indices
            ids = ids.fill_null(-1).to_numpy().astype(np.int64)
            n = len(t)
            alive, newest = mark(tree.indices.fill_null(-1).to_numpy().astype(np.int64) + 1, np.where(tree.indices.is_null().to_numpy(zero_copy_only=False), -1, ids[:n]), ids[n:], t["_us"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64))
            yield from t.drop_columns(["_us"]).append_column("alive", pa.array(alive)).append_column("newest", pa.array(newest)).combine_chunks().to_batches()

        for batch in batches:
            if not len(batch):
                continue
            tree = batch.column(names.index("tree"))
            same = pc.equal(tree, tree[len(tree) - 1]).fill_null(False).to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if last:
                yield from flagged(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif held and not pc.equal(held[-1].column(names.index("tree"))[-1], tree[0]).as_py():
                yield from flagged(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from flagged(pa.Table.from_batches(held))

    ordered = nodes.withColumn("_us", F.coalesce(micros(F.col("ts")), F.lit(-(1 << 62)))).repartition("tree").sortWithinPartitions("tree")
    schema = StructType([*(StructField(f.name, f.dataType, True) for f in nodes.schema), StructField("alive", BooleanType()), StructField("newest", BooleanType())])
    return ordered.mapInArrow(run, schema)


def _doubled(nodes: DataFrame, window_minutes: int) -> DataFrame:
    """The same for trees of any size: in round k each marked node marks its ancestor 2^k steps up, so a path of a million nodes takes twenty rounds. A node
    without further ancestors, or one that leads back to itself, drops out; more rounds than a path can need are an error."""
    base = nodes.where("tree is not null and id is not null").select("tree", "id", "parent", "ts")
    parents = base.where("parent is not null").select("tree", F.col("parent").alias("id")).distinct()
    leaves = base.join(parents, ["tree", "id"], "left_anti")
    last = leaves.groupBy("tree").agg(F.max("ts").alias("_last"))
    leaves = leaves.join(last, "tree").where(micros(F.col("_last")) - micros(F.col("ts")) <= window_minutes * MINUTE_US)
    marked = cut(leaves.select("tree", "id", (F.col("ts") == F.col("_last")).alias("newest")))
    up = cut(base.where("parent is not null").select("tree", "id", F.col("parent").alias("anc")).distinct())
    most = max(1, up.count().bit_length()) + 1
    for turn in range(most + 1):
        if up.isEmpty():
            break
        if turn == most:
            raise ValueError("parents of nodes run in a cycle")
        step = up.join(marked, ["tree", "id"]).select("tree", F.col("anc").alias("id"), "newest")
        marked = cut(marked.unionByName(step).groupBy("tree", "id").agg(F.max("newest").alias("newest")))
        again = up.alias("a").join(up.alias("b"), (F.col("a.tree") == F.col("b.tree")) & (F.col("a.anc") == F.col("b.id"))).select("a.tree", "a.id", "b.anc")
        up = cut(again.where("id <> anc"))
    flags = marked.select("tree", "id", F.lit(True).alias("alive"), "newest")
    return nodes.join(flags, ["tree", "id"], "left").withColumns({"alive": F.coalesce("alive", F.lit(False)), "newest": F.coalesce("newest", F.lit(False))}).select(*nodes.columns, "alive", "newest")


def user_events(rows: DataFrame) -> DataFrame:
    """Rows of ``live_branches`` to show: of the user, alive or older than the first one alive or without id, not a command or notice."""
    first_alive = F.min(F.when(F.col("alive"), F.struct("line_no", "ts"))).over(Window.partitionBy("tree"))["ts"]
    head = F.substring("text", 1, 60)
    odd = F.substring("text", 1, 1).isin("[", "<", "【", "#") | head.contains("SYSTEM") | head.contains("Context Usage") | head.contains("command-name")
    shown = rows.withColumn("_first", first_alive).where((F.col("role") == "user") & ~odd & (F.col("alive") | F.col("id").isNull() | (F.col("ts") < F.col("_first"))))
    return shown.withColumn("mark", F.when(F.col("alive") & ~F.col("newest"), "◆").otherwise("")).drop("_first")


def topic_blocks(events: DataFrame, key: str, at: str, gap_minutes: int = 5, block_minutes: int = 15) -> DataFrame:
    """``events`` with ``block``, from 1 within ``key``: a block ends at a gap longer than ``gap_minutes`` or ``block_minutes`` after its start.

    Rows without time are left out. The others are exchanged and sorted once and stream through: what is kept of a key is where its block began, the last time and the block's number.
    A block's end is looked up in the sorted times, so the work is one step for each block.
    """
    gap, most, names = gap_minutes * MINUTE_US, block_minutes * MINUTE_US, events.columns
    where = names.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, start, last, number = None, 0, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            keys, us = batch.column(where), batch.column(batch.num_columns - 1).to_numpy()
            same = pc.fill_null(pc.equal(keys.slice(1), keys.slice(0, len(keys) - 1)), False).to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(keys)]])
            block = np.empty(len(keys), np.int32)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                t = us[a:b]
                if a or number == 0 or keys[0].as_py() != open_:
                    start, last, number = int(t[0]), int(t[0]), 1
                gaps = np.append(np.flatnonzero(np.diff(t, prepend=last) > gap), len(t))
                i = g = 0
                while i < len(t):
                    if gaps[g] == i and gaps[g] < len(t):
                        g += 1
                        start, number = int(t[i]), number + 1
                    elif t[i] - start > most:
                        start, number = int(t[i]), number + 1
                    end = min(int(gaps[g]), int(np.searchsorted(t, start + most, side="right")))
                    block[a + i : a + max(end, i + 1)] = number
                    i = max(end, i + 1)
                last = int(t[-1])
            open_ = keys[len(keys) - 1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(block)], [*names, "block"])

    timed = events.where(F.col(at).isNotNull()).withColumn("_us", micros(F.col(at)))
    ordered = timed.repartition(key).sortWithinPartitions(key, "_us")
    schema = StructType([*(StructField(f.name, f.dataType, True) for f in events.schema), StructField("block", IntegerType())])
    return ordered.mapInArrow(run, schema)


def block_heads(blocks: DataFrame, key: str, at: str, heat: Column) -> DataFrame:
    """The first row of each block, and rows of heat within one, with ``exempt`` for the latter."""
    first = F.row_number().over(Window.partitionBy(key, "block").orderBy(at)) == 1
    return blocks.withColumns({"_first": first, "exempt": heat}).where("_first or exempt").drop("_first")


def fold(rows: DataFrame, at: str, now: datetime, keep_minutes: int = 60, bucket_minutes: int = 30, key: Sequence[str] = ()) -> DataFrame:
    """Rows of the last hour, exempt ones, and of older ones the first in each half hour of the clock."""
    age = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {keep_minutes} minutes")
    recent = F.col(at) >= age
    bucket = F.floor(micros(F.col(at)) / (bucket_minutes * MINUTE_US))
    group = Window.partitionBy(*key, bucket, recent | F.col("exempt")).orderBy(at, *[c for c in rows.columns if c != at])
    return rows.withColumn("_n", F.row_number().over(group)).where(recent | F.col("exempt") | (F.col("_n") == 1)).drop("_n")


def near_origin(rows: DataFrame, origins: DataFrame, at: str, seconds: int = 8) -> DataFrame:
    """Rows with an origin within ``seconds``, by cells of that length: each row looks at three cells, an equi-join."""
    cell = lambda c: F.floor(micros(c) / (seconds * 1_000_000))
    spots = origins.select(F.col(at).alias("_o"), cell(F.col(at)).alias("_c")).distinct()
    asked = rows.withColumn("_c", F.explode(F.array(*[cell(F.col(at)) + d for d in (-1, 0, 1)])))
    return asked.join(spots, (asked["_c"] == spots["_c"]) & (F.abs(micros(F.col(at)) - micros(F.col("_o"))) <= seconds * 1_000_000), "left_semi").select(*rows.columns).distinct()


def without_done(topics: DataFrame, done: Sequence[str]) -> DataFrame:
    """Topics that contain none of the words of done markers, of which there are few."""
    return topics.where(~reduce(lambda a, w: a | F.col("topic").contains(w), done, F.lit(False)))


def new_topics(topics: DataFrame, order: str = "ts") -> DataFrame:
    """Topics cut to 40 characters, without those equal to the one before."""
    short = topics.withColumn("topic", F.substring(F.trim("topic"), 1, 40)).where("topic <> ''")
    last = F.lag("topic").over(Window.partitionBy("session").orderBy(order))
    return short.withColumn("_last", last).where(~F.coalesce(F.col("_last") == F.col("topic"), F.lit(False))).drop("_last")


def stretch_start(events: DataFrame, key: str, at: str, wake_word: str = "good morning", wake_hours: int = 1, gap_hours: int = 5) -> DataFrame:
    """``key, start``: the last event that begins with the wake word after a pause, or else the last after a long gap, or else the first."""
    gap = micros(F.col(at)) - F.lag(micros(F.col(at))).over(Window.partitionBy(key).orderBy(at))
    hour = 60 * MINUTE_US
    woke = F.lower(F.ltrim("text")).startswith(wake_word) & (F.coalesce(gap, F.lit(wake_hours * hour)) >= wake_hours * hour)
    step = events.select(key, F.col(at).alias("_at"), woke.alias("_w"), F.coalesce(gap >= gap_hours * hour, F.lit(False)).alias("_g"))
    return step.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("_w"), F.col("_at"))), F.max(F.when(F.col("_g"), F.col("_at"))), F.min("_at")).alias("start"))


def strip_prefix(text: Column) -> Column:
    """Without leading words that say nothing, unless next to nothing would be left."""
    words = "|".join(p.replace(" ", r"\s+") for p in sorted(v.HEADLINE_PREFIXES, key=len, reverse=True))
    short = F.regexp_replace(text, rf"^(?i)(?:[,.\s]*(?:{words})\b)*[,.\s]*", "")
    return F.when(F.length(F.trim(short)) >= 6, short).otherwise(text)


def headline(text: Column, width: int = 25, topic_words: Sequence[str] = v.TOPIC_WORDS) -> Column:
    """The clause that says most, of the first eight: topic words count three, runs of kanji, katakana and letters one each up to a bound, requests and the first place one. Of equals the first; a later one is marked."""
    base = strip_prefix(text)
    parts = F.slice(F.filter(F.transform(F.split(base, r"[。、!！?？\n]"), lambda p: F.trim(p)), lambda p: F.length(p) >= 4), 1, 8)

    def score(p: Column, i: Column) -> Column:
        runs = lambda rx, most: F.least(F.regexp_count(p, F.lit(rx)), F.lit(most))
        topics = reduce(lambda a, w: a + F.when(p.contains(w), 3).otherwise(0), topic_words, F.lit(0))
        asked = reduce(lambda a, w: a | p.contains(w), v.REQUEST_WORDS, F.lit(False))
        return topics + runs("[一-鿿]{2,}", 3) + runs("[゠-ヿ]{3,}", 2) + runs("[A-Za-z0-9]{2,}", 2) + asked.cast("int") + (i == 0).cast("int")

    best = F.array_max(F.transform(parts, lambda p, i: F.struct(score(p, i).alias("s"), (-i).alias("i"), p.alias("p"))))
    return F.when(F.size(parts) <= 1, F.substring(base, 1, width)).otherwise(F.concat(F.when(best["i"] == 0, "").otherwise("…"), F.substring(best["p"], 1, width)))


def index_lines(rows: DataFrame, at: str, tz: str, cap: int = 40) -> list[str]:
    """Lines ``HH:MM mark+headline`` of the newest ``cap`` rows, oldest first, with a line for those left out. Few rows, in the driver."""
    total = rows.count()
    shown = rows.orderBy(F.col(at).desc()).limit(cap).select(F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(at)), "HH:mm").alias("t"), "mark", "headline", F.col(at).alias("a")).orderBy("a").collect()
    lines = [f"{r.t} {r['mark']}{r.headline}" for r in shown]
    return ([f"({total - cap} earlier omitted)"] if total > cap else []) + lines


def add_topic(path: str, topic: str, now: datetime) -> bool:
    """Appends a topic to a file of JSON lines unless it is the last one there."""
    topic = topic.strip()[:40]
    file = Path(path)
    lines = file.read_text(encoding="utf-8").splitlines() if file.exists() else []
    last = json.loads(lines[-1]).get("topic") if lines else None
    if not topic or topic == last:
        return False
    file.parent.mkdir(parents=True, exist_ok=True)
    with file.open("a", encoding="utf-8") as f:
        f.write(json.dumps({"ts": now.replace(microsecond=0).isoformat(), "topic": topic}, ensure_ascii=False) + "\n")
    return True


def mark_done(path: str, match: str, now: datetime) -> None:
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    with file.open("a", encoding="utf-8") as f:
        f.write(json.dumps({"ts": now.replace(microsecond=0).isoformat(), "match": match.strip()[:40]}, ensure_ascii=False) + "\n")
