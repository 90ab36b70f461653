"""Embeddings: context of a message, a pluggable embedder, nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of the previous, own and next message that are embedded together, and of a query.
BEFORE, OWN, AFTER, QUERY = 400, 1600, 400, 2000


class Embedder(Protocol):
    """Maps texts to unit vectors. ``near`` and ``far`` are its distances of a sure and of no match."""

    dim: int
    q_prefix: str
    p_prefix: str
    near: float
    far: float

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashedNgrams:
    """Character n-grams hashed to signed buckets, L2-normalised. Needs no model and gives the same everywhere.

    ``near`` and ``far`` are its own distances: a text that holds all words of a short question lies within 1.1, texts without common n-grams lie at 1.41.
    """

    dim, q_prefix, p_prefix, near, far = 384, "", "", 1.10, 1.30

    def __init__(self, low: int = 2, high: int = 4):
        self.low, self.high = low, high

    def encode(self, texts: list[str]) -> np.ndarray:
        """All texts of a batch at once: n-grams over their code points laid end to end, those across a border left out."""
        low = [t.lower() for t in texts]
        size = np.array([len(t) for t in low], np.int64)
        cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(len(low)), size)
        out = np.zeros(len(low) * self.dim)
        for n in range(self.low, self.high + 1):
            if len(cp) < n:
                break
            h = np.zeros(len(cp) - n + 1, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) ^ cp[k : k + len(h)]
            inside = row[: len(h)] == row[n - 1 :]
            h, own = h[inside], row[: len(h)][inside]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            at = own * self.dim + ((h >> np.uint64(33)) % np.uint64(self.dim)).astype(np.int64)
            out += np.bincount(at, np.where(h >> np.uint64(63), 1.0, -1.0), len(out))
        out = out.reshape(len(low), self.dim).astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def embed_column(text: Column, embedder: Embedder) -> Column:
    """Vectors of a column, in Arrow batches; the embedder is loaded once in a worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [embedder.p_prefix + t if isinstance(t, str) else "" for t in batch]
            yield pd.Series(list(embedder.encode(texts)), index=batch.index)

    return run(text)


def should_embed(kind: Column) -> Column:
    return ~F.coalesce(kind, F.lit("text")).isin("meta", "thinking")


def context_window(records: DataFrame) -> DataFrame:
    """Records to embed with ``context``: the text, and for messages their neighbours among the messages of the same source."""
    kept = records.where(should_embed(F.col("type")))
    message = F.coalesce(F.col("type") == "text", F.lit(False))
    order = Window.partitionBy("src", message).orderBy("line_no")
    around = F.when(message, F.array(F.substring(F.lag("text").over(order), 1, BEFORE), F.substring("text", 1, OWN), F.substring(F.lead("text").over(order), 1, AFTER))).otherwise(F.array("text"))
    return kept.withColumn("context", F.array_join(F.filter(around, lambda t: t.isNotNull()), "\n"))


def l2(vector: Column, query: list[float]) -> Column:
    diff = F.zip_with(vector, F.array(*[F.lit(float(x)) for x in query]), lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x))


def knn(vectors: DataFrame, query: list[float], k: int, key: str, vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest: each task keeps its best, no sort of all."""
    near = vectors.select(key, l2(F.col(vector), query).alias("distance"))
    return near.orderBy("distance", key).limit(k)


#: Vectors that centroids are fitted on at most; every vector is indexed whatever their number.
SAMPLE = 50_000


def _nearest_of(rows: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    d = (centres * centres).sum(1)[None, :] - 2 * rows @ centres.T
    return np.argpartition(d, min(n, len(centres)) - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(len(centres)), (len(rows), 1))


def centroids(vectors: DataFrame, lists: int, vector: str = "embedding", rounds: int = 8, seed: int = 7, sample: int = SAMPLE) -> np.ndarray:
    """Centres of ``lists`` clusters, fitted in the driver on at most ``sample`` vectors picked by a hash of their content."""
    rows = vectors.where(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(vector)).limit(sample).toPandas()[vector]
    if not len(rows):
        return np.zeros((1, 1))
    x = np.stack(rows.to_numpy()).astype(np.float64)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        own = _nearest_of(x, c, 1)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def listed(vectors: DataFrame, centres: np.ndarray, key: str, vector: str = "embedding", probes: int = 1) -> DataFrame:
    """``key, vector, list``: every vector once for each of its ``probes`` nearest lists."""
    kind = vectors.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                near = _nearest_of(np.stack(f[vector].to_numpy()).astype(np.float64), centres, probes)
                out = f.loc[f.index.repeat(near.shape[1])].copy()
                out["list"] = near.ravel().astype(np.int32)
                yield out

    return vectors.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias(vector)).mapInPandas(run, f"`{key}` {kind}, `{vector}` array<double>, list int")


def knn_lists(vectors: DataFrame, queries: DataFrame, k: int, key: str, q_key: str, centres: np.ndarray, probes: int, vector: str = "embedding", per_task: int = 20_000, block: int = 256) -> DataFrame:
    """``q_key, key, distance``: the ``k`` nearest of each query among the vectors of its ``probes`` nearest lists; with as many probes as lists, exactly.

    Vectors and queries meet by list, an equi-exchange; large lists are spread over pieces of about ``per_task`` vectors, to each of which the queries of the list go. What comes out of a
    piece is ``k`` rows a query. Nothing is sent to all tasks but the centres.
    """
    held = listed(vectors, centres, key, vector)
    size = held.groupBy("list").agg(F.ceil(F.count("*") / per_task).cast("int").alias("pieces"))
    v = held.join(size, "list").select("list", F.pmod(F.xxhash64(key), F.col("pieces")).cast("int").alias("piece"), F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    q = listed(queries, centres, q_key, vector, probes).join(size, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col(q_key).cast("bigint").alias("id"), F.col(vector).alias("v"))

    def near(group: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "k": [], "d": []}).astype({"q": "int64", "k": "int64", "d": "float64"})
        x, ids = np.stack(left["v"].to_numpy()), left["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        norm = (x * x).sum(1)
        found = []
        for a in range(0, len(right), block):  # queries compared at once
            y, own = np.stack(right["v"].to_numpy()[a : a + block]), right["id"].to_numpy()[a : a + block]
            d = np.sqrt(np.maximum((y * y).sum(1)[:, None] + norm[None, :] - 2 * y @ x.T, 0))
            best = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :k]
            found.append(pd.DataFrame({"q": np.repeat(own, best.shape[1]), "k": ids[best].ravel(), "d": np.take_along_axis(d, best, 1).ravel()}))
        return pd.concat(found)

    met = v.groupBy("list", "piece").cogroup(q.groupBy("list", "piece")).applyInPandas(near, "q bigint, k bigint, d double")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.round("d", 9), "k"))
    return met.withColumn("r", best).where(F.col("r") <= k).select(F.col("q").alias(q_key), F.col("k").alias(key), F.col("d").alias("distance"))


def knn_many(vectors: DataFrame, queries: DataFrame, k: int, key: str, q_key: str, vector: str = "embedding", block: int = 256) -> DataFrame:
    """``q_key, key, distance``: the ``k`` nearest of each query of a stated set, exactly: every query visits every list."""
    centres = centroids(vectors, 16, vector, rounds=1, sample=1_000)
    return knn_lists(vectors, queries, k, key, q_key, centres, len(centres), vector, block=block)
