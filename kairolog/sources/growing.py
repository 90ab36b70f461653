"""Streams and batches over files that only grow, which Spark's own file stream would read once and never again.

The offset of the stream is the size of each file up to its last whole line. A file that shrank is read again from its start, and its rows
say so. Lines that are still being written wait for their line feed.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "src_file string, byte_at bigint, rewritten boolean, line string"
_TAIL = 1 << 16


def whole_size(path: str) -> int:
    """Bytes of a file up to and with its last line feed."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        end = size
        while end > 0:
            start = max(0, end - _TAIL)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


class Stretch(InputPartition):
    def __init__(self, path: str, start: int, end: int, rewritten: bool):
        self.path, self.start, self.end, self.rewritten = path, start, end, rewritten


def plan(old: dict[str, int], new: dict[str, int]) -> list[Stretch]:
    """What to read to get from one offset to the next."""
    out = []
    for path, end in sorted(new.items()):
        start = old.get(path, 0)
        if end < start:
            out.append(Stretch(path, 0, end, True))
        elif end > start:
            out.append(Stretch(path, start, end, False))
    return out


def read_stretch(part: Stretch) -> Iterator[tuple[str, int, bool, str]]:
    at = part.start
    with open(part.path, "rb") as f:
        f.seek(at)
        while at < part.end:
            raw = f.readline()
            if not raw:
                break
            yield part.path, at, part.rewritten, raw.rstrip(b"\r\n").decode("utf-8", "replace")
            at += len(raw)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps({p: whole_size(p) for p in sorted(glob.glob(self.pattern, recursive=True))}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return plan(json.loads(start["files"]), json.loads(end["files"]))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from read_stretch(partition)

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """``spark.readStream.format("growing_lines").load("logs/**/*.jsonl")``"""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return GrowingReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLines)
