"""Filling containers of fixed capacity by best-fit decreasing (problem 9).

Best fit places items one after another, which no cluster can do item by item. But
items of one size are interchangeable, and sizes are whole numbers up to the
capacity. So the corpus is first counted by size (at most ``capacity`` numbers, however
large it is), best-fit decreasing runs over these counts, and the plan it returns,
intervals of ranks within a size mapped to intervals of containers, is joined to the
records by size and rank. The assignment is exactly that of item-wise best-fit
decreasing with items of equal size in the order of their rank.

The open containers are a segment tree over remaining capacities; the tightest one
that holds a size is found by one climb and one descent of the tree.

Defined results: a record larger than a container is cut into full containers and one
rest; no other record is cut. Records of no tokens (null or empty text) come out once with
piece 0, 0 tokens and a null container. Repeated rows are items of their own.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairolog.session import cut

CAPACITY = 2048


class OpenContainers:
    """Open containers by remaining capacity: a segment tree of counts over intervals of container numbers."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.spans: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        node = room + self.width
        while node:
            self.count[node] += n
            node >>= 1

    def push(self, room: int, first: int, n: int) -> None:
        self.spans[room].append((first, n))
        self._add(room, n)

    def pop(self, room: int) -> tuple[int, int]:
        first, n = self.spans[room].popleft()
        self._add(room, -n)
        return first, n

    def tightest(self, size: int) -> int | None:
        """The smallest remaining capacity of at least ``size`` that an open container has."""
        node = size + self.width
        if self.count[node]:
            return size
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Plan for ``counts`` items of each size: (size, first rank, items, items per container, first container).

    Each step moves a whole interval of containers, or splits it once, so the plan's length depends on
    the capacity alone.
    """
    open_, plan, made = OpenContainers(capacity), [], 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = open_.tightest(size)
            if room is None:
                room, first, n = capacity, made, -(-left // (capacity // size))
                made += n
            else:
                first, n = open_.pop(room)
            each = room // size
            full = min(n, left // each)
            if full:
                plan.append((size, rank, full * each, each, first))
                open_.push(room - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                if left:
                    plan.append((size, rank, left, left, first + full))
                    open_.push(room - left * size, first + full, 1)
                    left, full = 0, full + 1
                if full < n:
                    open_.push(room, first + full, n - full)
    return plan


def pieces(sized: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """``key, piece, first_token, n_tokens``: records as they are, larger ones cut into full containers and a rest."""
    n = F.coalesce(F.col("n_tokens"), F.lit(0))
    last = F.greatest(F.ceil(n / capacity) - 1, F.lit(0)).cast("int")
    cut_up = sized.select(key, n.alias("total"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    first = F.col("piece").cast("bigint") * capacity
    return cut_up.select(key, "piece", first.alias("first_token"), F.least(F.col("total") - first, F.lit(capacity)).cast("int").alias("n_tokens"))


def pack(sized: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, per_group: int = 200_000) -> DataFrame:
    """Container of each piece of ``sized`` (``key, n_tokens``): ``key, piece, first_token, n_tokens, container``.

    ``per_group`` is about how many pieces are ranked together: a size that a third of all records share is
    spread over as many groups as that takes, and each group's ranks start where those of the last end.
    """
    spark = sized.sparkSession
    items = pieces(sized, key, capacity)
    real = items.where("n_tokens > 0")
    counts = {r.n_tokens: r.n for r in real.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = best_fit_decreasing(counts, capacity)
    salts = max(1, -(-max(counts.values(), default=1) // per_group))
    real = real.withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int"))
    if salts > 1:
        before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        base = real.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
        base = base.select("n_tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        real = real.join(base, ["n_tokens", "salt"])
    else:
        real = real.withColumn("base", F.lit(0))
    rank = F.col("base") + F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy(key, "piece")) - 1
    steps = spark.createDataFrame(plan, "n_tokens int, first_rank bigint, items bigint, each bigint, first_container bigint")
    steps = F.broadcast(steps.withColumn("end_rank", F.col("first_rank") + F.col("items")))  # its length is bounded by the capacity
    ranked = real.withColumn("rank", rank)
    held = ranked.join(steps, (ranked.n_tokens == steps.n_tokens) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    held = held.select(key, "piece", "first_token", ranked.n_tokens, (F.col("first_container") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("each"))).cast("bigint").alias("container"))
    return held.unionByName(items.where("n_tokens = 0").withColumn("container", F.lit(None).cast("bigint")))


def pack_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """:func:`pack` with sizes in tokens. Texts are encoded once; their sizes are written and read twice."""
    from kairolog.llm import byte_bpe

    return pack(cut(byte_bpe.sizes(docs, key, text, path)), key, capacity)
