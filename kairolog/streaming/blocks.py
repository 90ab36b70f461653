"""Topic blocks over a stream: the state of a session is the start and the last time of its open block."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session string, us bigint, block int"
STATE = "block int, start bigint, last bigint"


def block_stream(events: DataFrame, gap_minutes: int = 5, block_minutes: int = 15) -> DataFrame:
    """``session, us, block`` of a stream ``session, us``. Within a trigger events are ordered; an event older than the state joins the open block."""
    gap, most = gap_minutes * 60_000_000, block_minutes * 60_000_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block, start, last = state.get if state.exists else (0, 0, 0)
        times = sorted(t for f in frames for t in f["us"].tolist())
        blocks = []
        for t in times:
            if block == 0 or t - last > gap or t - start > most:
                block, start = block + 1, t
            last = max(last, t)
            blocks.append(block)
        state.update((block, start, last))
        yield pd.DataFrame({"session": [key[0]] * len(times), "us": times, "block": blocks})

    return events.groupBy("session").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
