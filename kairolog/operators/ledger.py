"""Processing only new or changed records, whatever failed before (problem 4).

A ledger of work items with the states pending, leased and done:

* A run leases an item under a fencing token larger than all before; a lease that is not completed in time expires and
  its item is pending again. A lease whose run is known to have failed counts for nothing.
* A completion counts only if it carries the greatest token that leased its item; a writer that was thought dead and comes
  back with an older token is rejected.
* Outputs go to paths that depend on item and token alone, so a retry overwrites its own half-written files and
  readers look only where the accepted completion points.

`remaining_lines` reads that ledger: an item is a file of one index, a run is a writer, its number the token. The state a run
left behind is its lease, and its completion if the run succeeded. What `state` accepts is then proven by a signature over the lines it claims to have done. A signature
is one SHA-1 over all these lines in order, so a file is hashed by one task, streaming, in constant memory.

Defined results: a null text is the empty string, a line delivered again counts once, state of unknown files is ignored, repeated
state counts once; of two states one run left for a file the greater one counts; a null or empty signature proves nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairolog.operators.manifest import Versions

SIG_DIGITS = 16
LEASE_SECONDS = 600

EVENTS = "item string, token bigint, kind string, at timestamp, detail string"


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and end offsets of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def by_writer(events: DataFrame) -> DataFrame:
    """``item, token`` with what each writer did: ``leased`` (when), ``completed``, ``detail``, ``failed``. Map-side combine; a writer has few events of an item."""
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return events.groupBy("item", "token").agg(of("lease", "at").alias("leased"), of("done", "at").alias("completed"), of("done", "detail").alias("detail"), F.max(F.col("kind") == "fail").alias("failed"))


def state(events: DataFrame, now: Column, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """``item, state, token, detail`` of each item, from its events ``add``, ``lease``, ``done`` and ``fail``: two aggregations with map-side combine.

    The greatest token that was leased, and has not failed, owns the item. Only its completion counts; if its lease has run out the item is
    pending, but its completion is still accepted as long as nobody leased the item again.
    """
    good = F.col("leased").isNotNull() & ~F.col("failed")
    owner = by_writer(events).groupBy("item").agg(F.max(F.when(good, F.struct("token", "leased", "completed", "detail"))).alias("w"))
    live = F.col("w.leased") + F.expr(f"interval {lease_seconds} seconds") > now
    kind = F.when(F.col("w.completed").isNotNull(), "done").when(F.coalesce(live, F.lit(False)), "leased").otherwise("pending")
    return owner.select("item", kind.alias("state"), F.coalesce("w.token", F.lit(0)).cast("bigint").alias("token"), F.col("w.detail").alias("detail"))


def reduced(events: DataFrame) -> DataFrame:
    """The events that still decide something: each item's ``add``, lease and completion of its owner, and failures of greater tokens."""
    good = F.col("leased").isNotNull() & ~F.col("failed")
    owner = by_writer(events).groupBy("item").agg(F.coalesce(F.max(F.when(good, F.col("token"))), F.lit(0)).alias("owner"))
    kept = events.join(owner, "item").where((F.col("kind") == "add") | (F.col("token") == F.col("owner")) | ((F.col("kind") == "fail") & (F.col("token") > F.col("owner"))) | ((F.col("kind") == "lease") & (F.col("token") > F.col("owner"))))
    return kept.groupBy("item", "token", "kind").agg(F.max("at").alias("at"), F.max("detail").alias("detail"))


class StaleToken(Exception):
    """A token that is not greater than every token before it."""


class Ledger:
    """Events in an append-only table of a shared folder. Items are rows, so any number of them can be leased in one write."""

    def __init__(self, spark: SparkSession, root: str, lease_seconds: int = LEASE_SECONDS):
        self.spark, self.root, self.lease_seconds = spark, root.rstrip("/"), lease_seconds
        self.snapshots = Versions(spark, f"{self.root}/snapshot")

    def _files(self) -> list[str]:
        """Files of events that no snapshot holds: one or a few for each write since the last one."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/events")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [str(f.getPath().toString()) for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")] if fs.exists(path) else []

    def events(self) -> DataFrame:
        """Snapshot and what came after it. Events are only ever combined by maxima, so one that stands in both does no harm."""
        files, old = self._files(), self.snapshots.read()
        new = self.spark.read.schema(EVENTS).parquet(*files) if files else self.spark.createDataFrame([], EVENTS)
        return new if old is None else new.unionByName(old.select(*new.columns))

    def _append(self, rows: DataFrame) -> None:
        rows.select("item", F.col("token").cast("bigint").alias("token"), "kind", "at", F.col("detail").cast("string").alias("detail")).write.mode("append").parquet(f"{self.root}/events")

    def compact(self, name: str) -> None:
        """Publishes a snapshot ``name`` of the events so far and removes their files. Events written meanwhile stay; a crash in between leaves some events in both places."""
        files = self._files()
        self.snapshots.publish(reduced(self.events()), name)
        jvm = self.spark._jvm
        for f in files:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)

    def state(self, now: Column) -> DataFrame:
        return state(self.events(), now, self.lease_seconds)

    def add(self, items: DataFrame, now: Column) -> None:
        """New items become pending; known ones stay as they are."""
        new = items.select("item").where("item is not null").distinct().join(self.events().select("item"), "item", "left_anti")
        self._append(new.select("item", F.lit(0).alias("token"), F.lit("add").alias("kind"), now.alias("at"), F.lit(None).alias("detail")))

    def lease(self, token: int, now: Column, most: int | None = None) -> DataFrame:
        """Leases pending items to the writer ``token`` and returns those it owns. A token that is not greater than every one before is refused."""
        greatest = self.events().where("kind = 'lease'").agg(F.coalesce(F.max("token"), F.lit(0))).first()[0]
        if token <= greatest:
            raise StaleToken(f"token {token} is not greater than {greatest}")
        pending = self.state(now).where("state = 'pending'").select("item")
        pending = pending.orderBy("item").limit(most) if most else pending
        self._append(pending.select("item", F.lit(token).alias("token"), F.lit("lease").alias("kind"), now.alias("at"), F.lit(None).alias("detail")))
        return self.state(now).where(F.col("token") == token).select("item")

    def complete(self, items: DataFrame, token: int, now: Column) -> None:
        """Reports items as done. A stale writer may write this, but `state` never accepts it."""
        self._append(items.select("item", F.lit(token).alias("token"), F.lit("done").alias("kind"), now.alias("at"), self.path(F.col("item"), F.lit(token)).alias("detail")))

    def fail(self, items: DataFrame, token: int, now: Column) -> None:
        """Gives items back: the lease of ``token`` counts for nothing from now on."""
        self._append(items.select("item", F.lit(token).alias("token"), F.lit("fail").alias("kind"), now.alias("at"), F.lit(None).alias("detail")))

    def path(self, item: Column, token: Column) -> Column:
        """Where the output of an item goes: a function of item and token alone."""
        return F.concat(F.lit(f"{self.root}/data/"), F.substring(F.sha2(item, 256), 1, 32), F.lit("/"), token.cast("string"))


def progress_events(progress: DataFrame, runs: DataFrame, side: str, key: str, count: str) -> DataFrame:
    """State that runs left behind as events of the ledger: item ``side|file``, token the run's number; detail of a completion: the count, of twelve digits, and the signature."""
    ok = (F.lower(F.trim("status")) == "ok") & F.col("finished_at").isNotNull()
    began = F.col("started_at") if "started_at" in runs.columns else F.lit(None)
    run = runs.where("run_id is not null").groupBy(F.col("run_id").alias("token")).agg(F.max(F.coalesce(ok, F.lit(False))).alias("ok"), F.max(began).cast("timestamp").alias("began"), F.max("finished_at").cast("timestamp").alias("ended"))
    rows = progress.where(F.col(key).isNotNull()).select(F.concat(F.lit(f"{side}|"), F.col(key)).alias("item"), F.col("run_id").cast("bigint").alias("token"), F.col(count).cast("bigint").alias("n"), "sig")
    known = rows.join(run, "token")
    detail = F.concat(F.lpad(F.col("n").cast("string"), 12, "0"), F.lit("|"), F.coalesce("sig", F.lit("")))
    lease = F.struct(F.lit("lease").alias("kind"), F.coalesce("began", F.lit(datetime(1970, 1, 1)).cast("timestamp")).alias("at"), F.lit(None).cast("string").alias("detail"))
    end = F.when(F.col("ok"), F.struct(F.lit("done").alias("kind"), F.col("ended").alias("at"), F.coalesce(detail, F.lit("000000000000|")).alias("detail"))).otherwise(F.struct(F.lit("fail").alias("kind"), F.coalesce("ended", "began").alias("at"), F.lit(None).cast("string").alias("detail")))
    return known.select("item", "token", F.explode(F.array(lease, end)).alias("e")).select("item", "token", "e.*")


def _prefix_signatures(lines: DataFrame) -> DataFrame:
    """``src_day, found``: signature over the lines of each file, in order. Files stream through in sorted order, one hash state at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, last, digest = None, None, hashlib.sha1()
        for batch in batches:
            if not len(batch):
                continue
            day, line = batch.column(0), batch.column(1).to_numpy()
            fresh = np.ones(len(batch), bool)  # a file begins
            same = pc.equal(day.slice(1), day.slice(0, len(day) - 1)).to_numpy(zero_copy_only=False)
            fresh[1:] = ~same
            fresh[0] = day[0].as_py() != open_
            once = np.ones(len(batch), bool)
            once[1:] = fresh[1:] | (line[1:] != line[:-1])
            once[0] = fresh[0] or line[0] != last
            last = line[-1]
            data, ends = text_buffer(batch.column(2).filter(pa.array(once)))
            upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(once)])]  # bytes before each row
            edges = np.append(np.flatnonzero(fresh), len(batch))
            digest.update(data[: upto[edges[0]]])
            names, signs = [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if open_ is not None:
                    names.append(open_)
                    signs.append(digest.hexdigest()[:SIG_DIGITS])
                open_, digest = day[a].as_py(), hashlib.sha1(data[upto[a] : upto[b]])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(signs, pa.string())], ["src_day", "found"])
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_]), pa.array([digest.hexdigest()[:SIG_DIGITS]])], ["src_day", "found"])

    ordered = lines.select("src_day", "line_no", "text").repartition("src_day").sortWithinPartitions("src_day", "line_no")
    return ordered.mapInArrow(run, "src_day string, found string")


def remaining_lines(lines: DataFrame, days: DataFrame, srcs: DataFrame, runs: DataFrame) -> DataFrame:
    """``side, src_day, line_no``: the lines that the next run of either index has to process."""
    slim = lines.select("src_day", "line_no", "text").where(F.col("src_day").isNotNull() & F.col("line_no").isNotNull())
    once = slim.select("src_day", "line_no").distinct()
    size = once.groupBy("src_day").agg(F.count("*").alias("n_lines"))
    src_key = F.when(F.col("src").startswith("corpus/"), F.substring("src", 8, 1_000_000)).otherwise(F.col("src"))
    plain = srcs.where(F.col("src").startswith("main/") | (F.col("src").startswith("corpus/") & ~F.col("src").startswith("corpus/main/"))).withColumn("src", src_key)
    events = progress_events(days, runs, "day", "day", "done_lines").unionByName(progress_events(plain, runs, "src", "src", "nlines"))
    done = state(events, F.current_timestamp()).where("state = 'done'")  # no run is under way: what has not succeeded is pending again
    both = done.select(F.substring("item", 1, 3).alias("side"), F.substring("item", 5, 1_000_000).alias("src_day"), F.substring("detail", 1, 12).cast("bigint").alias("done"), F.substring("detail", 14, 1_000_000).alias("sig"))
    claims = both.join(size, "src_day").where((F.col("done") >= 1) & (F.col("done") <= F.col("n_lines")) & (F.col("sig") != "")).select("side", "src_day", "done", "sig")
    day = claims.where("side = 'day'")
    prefix = slim.hint("merge").join(day.select("src_day", "done"), "src_day")  # the lines themselves are never broadcast
    prefix = prefix.where("line_no < done")
    day_ok = day.join(_prefix_signatures(prefix), "src_day").where("sig = found")
    src = claims.where("side = 'src'")
    last = slim.hint("merge").join(src, (slim.src_day == src.src_day) & (slim.line_no == src.done - 1)).select("side", src.src_day, "done", "sig", F.substring(F.sha1(F.coalesce("text", F.lit("")).cast("binary")), 1, SIG_DIGITS).alias("found"))
    src_ok = last.where("sig = found").select("side", "src_day", "done").distinct()
    proven = day_ok.select("side", "src_day", "done").unionByName(src_ok).groupBy("src_day").pivot("side", ["day", "src"]).agg(F.max("done"))
    todo = once.hint("merge").join(proven, "src_day", "left").select("src_day", "line_no", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.coalesce(s, F.lit(0)).alias("done")) for s in ("day", "src")])).alias("w"))
    return todo.where("line_no >= w.done").select("w.side", "src_day", "line_no")
