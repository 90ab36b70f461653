"""Conversations from message rows (problem 5).

Rows are partitioned by conversation and day and sorted within by instant and line, a secondary sort that the exchange's
consumer reads in order. A finite-state automaton runs over each piece: ``start`` waits for the user, ``asked`` for a reply, ``replied`` accepts, nothing
leaves ``broken``. Where a piece begins the state is not known yet, so what a piece does is kept as a function from state to
state; functions of rows are composed in pairs, and those of a conversation's pieces in order of their days. So a conversation with a
third of all rows is spread over as many tasks as it has days, and a day streams through its task in constant memory.

Positions are counted within a piece and shifted by the messages of earlier pieces. Texts are not moved: a row carries a digest that tells
rows delivered again, and whether its text is blank; `rebuild` fetches the texts of the rows that are kept.

Defined results: rows delivered again count once, under their smallest key; blank texts get no position and do not move the automaton;
ties of instant and line go by key; null file names belong to no conversation. A conversation with a hole in its line numbers, or a row without
instant or known role, is dropped, as is one without any turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairolog.operators.timestamps import log_instants
from kairolog.session import cut

#: Spellings of the roles (fixed values).
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "system": "system"}
DAY_US = 86_400_000_000

#: States, what a row can be, and the state that follows.
START, ASKED, REPLIED, BROKEN = range(4)
SILENT, USER, ASSISTANT, BAD = range(4)
NEXT = np.array(
    [
        # silent, user, assistant, bad
        [START, ASKED, BROKEN, BROKEN],
        [ASKED, ASKED, REPLIED, BROKEN],
        [REPLIED, ASKED, REPLIED, BROKEN],
        [BROKEN, BROKEN, BROKEN, BROKEN],
    ],
    np.int8,
)
ACCEPTING = REPLIED


def known_role(role: Column) -> Column:
    clean = F.lower(F.regexp_replace(role, r"(?U)^\s+|\s+$", ""))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), clean)


def filled(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def session_of(src_file: Column) -> Column:
    return F.regexp_replace(src_file, r"^raw/|\.jsonl$", "")


def turns(log: DataFrame, configs: DataFrame) -> DataFrame:
    """``session, log_id, line_no, utc_us, role, filled, digest`` of each row, without its text. ``role`` is null if unknown; rows delivered again have one digest."""
    slim = log.where("src_file is not null").select("log_id", "src_file", "line_no", "ts", "role", "cfg_id", filled(F.col("text")).alias("filled"), F.xxhash64("ts", "role", "text", "cfg_id", F.md5(F.col("text").cast("binary"))).alias("digest"))
    at = log_instants(slim, configs)
    return at.select(session_of(F.col("src_file")).alias("session"), "log_id", "line_no", "utc_us", known_role(F.col("role")).alias("role"), "filled", "digest")


def composed(functions: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Functions from state to state, one a row, composed in order within each piece: first row and function of each piece."""
    first, begin = np.flatnonzero(np.append(True, piece[1:] != piece[:-1])), None
    begin = first
    while len(functions) > len(begin):
        size = np.diff(np.append(begin, len(functions)))
        rank = np.arange(len(functions)) - np.repeat(begin, size)
        even = np.flatnonzero(rank % 2 == 0)
        pair = even[(even + 1 < len(functions)) & (np.append(rank, 0)[even + 1] > 0)]
        functions[pair] = np.take_along_axis(functions[pair + 1], functions[pair], axis=1)
        functions = functions[even]
        begin = np.concatenate([[0], np.cumsum((size + 1) // 2)[:-1]])
    return first, functions


PLACED = "session string, day bigint, log_id bigint, line_no int, rank bigint, ended array<tinyint>, n bigint"


def placed(rows: DataFrame) -> DataFrame:
    """Of rows of :func:`turns`, once each: ``rank`` among the messages of its conversation and day, null for blank ones; on a row per such piece
    ``ended``, the state it ends in for each state it may begin in, and ``n``, its messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("session", pa.string()), ("day", pa.int64()), ("log_id", pa.int64()), ("line_no", pa.int32()), ("rank", pa.int64()), ("ended", pa.list_(pa.int8())), ("n", pa.int64())])
        held: pa.Table | None = None  # rows of the last instant and line, which may go on
        done, so_far, open_ = np.arange(4, dtype=np.int8), 0, None  # of the piece that is under way

        def number(t: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
            nonlocal done, so_far, open_
            t = t.combine_chunks()
            session, day = t["session"].combine_chunks(), t["day"].fill_null(-(1 << 62)).combine_chunks().to_numpy()
            line, at = t["line_no"].fill_null(-1).combine_chunks().to_numpy(), t["utc_us"].fill_null(-(1 << 62)).combine_chunks().to_numpy()
            n = len(t)
            new = np.ones(n, bool)
            new[1:] = ~pc.equal(session.slice(1), session.slice(0, n - 1)).to_numpy(zero_copy_only=False) | (day[1:] != day[:-1])
            group = np.ones(n, bool)
            group[1:] = new[1:] | (at[1:] != at[:-1]) | (line[1:] != line[:-1])
            of = np.cumsum(group)
            digest = t["digest"].combine_chunks().to_numpy()
            order = np.lexsort((np.arange(n), digest, of))
            again = np.zeros(n, bool)
            again[order[1:]] = (of[order[1:]] == of[order[:-1]]) & (digest[order[1:]] == digest[order[:-1]])
            upto = n if last else int(np.flatnonzero(of == of[-1])[0])
            rest = t.slice(upto).filter(pa.array(~again[upto:]))
            keep = np.flatnonzero(~again[:upto])
            if not len(keep):
                return None, rest
            piece = np.cumsum(new)[keep]
            role = pc.fill_null(t["role"], "").combine_chunks()
            bad = (pc.is_null(t["utc_us"]).combine_chunks().to_numpy(zero_copy_only=False) | pc.is_null(t["line_no"]).combine_chunks().to_numpy(zero_copy_only=False) | pc.equal(role, "").to_numpy(zero_copy_only=False))[keep]
            full = t["filled"].combine_chunks().to_numpy(zero_copy_only=False)[keep]
            of_user, of_ai = (pc.equal(role, x).to_numpy(zero_copy_only=False)[keep] for x in ("user", "assistant"))
            move = np.where(bad, BAD, np.where(full & of_user, USER, np.where(full & of_ai, ASSISTANT, SILENT)))
            first, ends = composed(NEXT[:, move].T.copy(), piece)
            size = np.diff(np.append(first, len(keep)))
            count = np.cumsum(full)
            base = np.where(first > 0, count[first - 1], 0)
            name, when = session[int(keep[0])].as_py(), int(day[keep[0]])
            tail_session, tail_day, tail_ended, tail_n = [], [], [], []
            if open_ is not None and open_ != (name, when):
                tail_session, tail_day, tail_ended, tail_n = [open_[0]], [open_[1]], [done.tolist()], [so_far]
                done, so_far = np.arange(4, dtype=np.int8), 0
            messages = np.add.reduceat(full.astype(np.int64), first)
            ends[0] = ends[0][done]
            base = base.astype(np.int64)
            base[0] -= so_far
            messages[0] += so_far
            rank = np.where(full, count - 1 - np.repeat(base, size), -1)
            heads = keep[first]
            for k in range(len(first) - 1):
                tail_session.append(session[int(heads[k])].as_py())
                tail_day.append(int(day[heads[k]]))
                tail_ended.append(ends[k].tolist())
                tail_n.append(int(messages[k]))
            open_, done, so_far = (session[int(heads[-1])].as_py(), int(day[heads[-1]])), ends[-1], int(messages[-1])
            k = len(tail_day)
            out = [
                pa.concat_arrays([session.take(pa.array(keep)), pa.array(tail_session, pa.string())]), pa.array(np.concatenate([day[keep], np.array(tail_day, np.int64)])),
                pa.concat_arrays([t["log_id"].combine_chunks().take(pa.array(keep)), pa.nulls(k, pa.int64())]), pa.concat_arrays([t["line_no"].combine_chunks().take(pa.array(keep)), pa.nulls(k, pa.int32())]),
                pa.concat_arrays([pa.array(rank, pa.int64(), mask=~full), pa.nulls(k, pa.int64())]), pa.concat_arrays([pa.nulls(len(keep), pa.list_(pa.int8())), pa.array(tail_ended, pa.list_(pa.int8()))]), pa.concat_arrays([pa.nulls(len(keep), pa.int64()), pa.array(tail_n, pa.int64())]),
            ]
            return pa.RecordBatch.from_arrays(out, schema=schema), rest

        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            out, held = number(table if held is None or not len(held) else pa.concat_tables([held, table]), False)
            if out is not None:
                yield out
        if held is not None and len(held):
            out, _ = number(held, True)
            if out is not None:
                yield out
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_[0]]), pa.array([open_[1]]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([done.tolist()], pa.list_(pa.int8())), pa.array([so_far])], schema=schema)

    slim = rows.select("session", F.floor(F.col("utc_us") / DAY_US).alias("day"), "log_id", F.col("line_no").cast("int").alias("line_no"), "utc_us", "role", "filled", "digest")
    ordered = slim.repartition("session", "day").sortWithinPartitions("session", "day", "utc_us", "line_no", "log_id")
    return ordered.mapInArrow(run, PLACED)


def kept_pieces(rows: DataFrame) -> DataFrame:
    """``session, day, base`` of the pieces of conversations in which the automaton ends in the accepting state; ``base`` are the messages of earlier pieces."""
    lines = rows.where("log_id is not null").groupBy("session").agg(F.min("line_no").alias("lo"), F.max("line_no").alias("hi"), F.count_distinct("line_no").alias("c"))
    whole = lines.where("lo = 0 and hi = c - 1").select("session")
    pieces = rows.where("ended is not null").groupBy("session").agg(F.array_sort(F.collect_list(F.struct("day", "ended", "n"))).alias("pieces"))  # one for each day it spans
    step = lambda have, p: F.struct(F.element_at(p["ended"], have["state"].cast("int") + 1).alias("state"), (have["n"] + p["n"]).alias("n"), F.concat(have["bases"], F.array(F.struct(p["day"].alias("day"), have["n"].alias("base")))).alias("bases"))
    begin = F.struct(F.lit(START).cast("tinyint").alias("state"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<struct<day:bigint,base:bigint>>").alias("bases"))
    ran = pieces.select("session", F.aggregate("pieces", begin, step).alias("r")).where(F.col("r.state") == ACCEPTING)
    return ran.join(whole, "session", "left_semi").select("session", F.inline("r.bases"))


def positions(log: DataFrame, configs: DataFrame) -> DataFrame:
    """``session, pos, log_id`` of the conversations to keep, in order from position 0."""
    rows = cut(placed(turns(log, configs)))  # narrow, and read three times below
    kept = rows.where("rank is not null").join(kept_pieces(rows), ["session", "day"])
    return kept.select("session", (F.col("base") + F.col("rank")).cast("int").alias("pos"), "log_id")


def rebuild(log: DataFrame, configs: DataFrame) -> DataFrame:
    """``session, pos, log_id, ts, role, text`` of the conversations to keep, in order from position 0. ``role`` is the known one."""
    text = log.where("src_file is not null").groupBy("log_id").agg(F.min_by(F.struct("ts", "role", "text"), "line_no").alias("m"))
    return positions(log, configs).join(text, "log_id").select("session", "pos", "log_id", "m.ts", known_role(F.col("m.role")).alias("role"), "m.text")
