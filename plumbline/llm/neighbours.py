"""Approximate nearest neighbours over learned partitions (operator 4).

On a bounded sample a neighbour graph is cut into balanced parts: halves along the graph's slowest
direction, then swaps while they cut fewer edges, again and again. A small network learns the part
of a vector from its neighbours' parts. Every row is indexed under its most probable part; a query
goes to its most probable parts until they hold nearly all of its probability, and everything
there is ranked by exact distance. Parts are searched in pieces of a fixed number of rows, so a
part that many equal vectors fill is more tasks, not a longer one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import shipped, written

#: Rows that the partition and the network are learned from at most (about).
SAMPLE = 12_000
#: Rows of the table for each part, and parts at most; rows in a piece of a part.
ROWS_PER_PART = 1_600
MOST_PARTS = 256
PIECE = 4_000
#: Neighbours in the graph; the probability that a query's parts must hold together.
GRAPH = 10
MASS = 0.995
NEIGHBOURS = 10


def able(vector: str) -> Column:
    """Vectors that take part: neither null nor all zero, without null, infinite or NaN components."""
    c = F.col(f"`{vector}`")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return c.isNotNull() & F.coalesce(~F.exists(c, odd) & F.exists(c, lambda x: x != 0), F.lit(False))


def nearest_in(points: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other points of each point, in blocks."""
    k = min(k, len(points) - 1)
    norms = (points**2).sum(axis=1)
    out = np.zeros((len(points), k), np.int64)
    for a in range(0, len(points), 1024):
        far = norms[a : a + 1024, None] + norms - 2 * points[a : a + 1024] @ points.T
        far[np.arange(len(far)), np.arange(a, a + len(far))] = np.inf
        out[a : a + 1024] = np.argpartition(far, k - 1, axis=1)[:, :k]
    return out


def halves(edges: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Two equal halves of a graph's nodes (True: the second) that cut few of its edges."""
    a, b = edges
    degree = np.maximum(1, np.bincount(a, minlength=n) + np.bincount(b, minlength=n))
    x = rng.standard_normal(n)
    for _ in range(60):
        x = 0.5 * x + 0.5 * (np.bincount(a, x[b], n) + np.bincount(b, x[a], n)) / degree
        x -= (x * degree).sum() / degree.sum()
        x /= max(1e-12, np.abs(x).max())
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[n // 2 :]] = True
    for _ in range(20):
        cross = np.where(side[a] != side[b], 1.0, -1.0)
        gain = np.bincount(a, cross, n) + np.bincount(b, cross, n)
        left, right = (np.flatnonzero(side == s) for s in (False, True))
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        swaps = int((gain[left[:m]] + gain[right[:m]] > 0).sum())
        if not swaps:
            break
        swaps = max(1, swaps // 4)  # some at a time: a swap changes its neighbours' gains
        side[left[:swaps]], side[right[:swaps]] = True, False
    return side


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """The part of each node, parts being equally large, by halving again and again."""
    rng = np.random.default_rng(seed)
    n, k = graph.shape
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    part, done = np.zeros(n, np.int64), 1
    while done < parts:
        new = part * 2
        for p in range(done):
            own = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            inside = (place[a] >= 0) & (place[b] >= 0)
            new[own] += halves(np.stack([place[a[inside]], place[b[inside]]]), len(own), rng)
        part, done = new, done * 2
    return part


@dataclass
class Router:
    """A network of one hidden layer from vectors to the probabilities of parts."""

    mean: np.ndarray
    scale: float
    layers: tuple[np.ndarray, ...]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = np.maximum(0, (x - self.mean) / self.scale @ w1 + b1) @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def trained(points: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, hidden: int = 128, epochs: int = 30, seed: int = 7) -> Router:
    """The network trained to give, for a point, the shares of the parts among its neighbours and itself."""
    rng = np.random.default_rng(seed)
    n, d = points.shape
    want = np.zeros((n, parts))
    np.add.at(want, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1.0)
    want[np.arange(n), part] += 1.0
    want /= want.sum(axis=1, keepdims=True)
    mean, scale = points.mean(axis=0), float(points.std()) or 1.0
    x = (points - mean) / scale
    layers = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        rate = 2e-3 * (1 - epoch / epochs) + 1e-4
        for at in range(0, n, 256):
            rows = order[at : at + 256]
            h = np.maximum(0, x[rows] @ layers[0] + layers[1])
            z = h @ layers[2] + layers[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            off = (z / z.sum(axis=1, keepdims=True) - want[rows]) / len(rows)
            back = off @ layers[2].T * (h > 0)
            slopes = [x[rows].T @ back, back.sum(axis=0), h.T @ off, off.sum(axis=0)]
            step += 1
            for i, slope in enumerate(slopes):
                first[i] += 0.1 * (slope - first[i])
                second[i] += 0.001 * (slope**2 - second[i])
                layers[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Router(mean, scale, tuple(layers))


def fit(points: np.ndarray, rows: int) -> tuple[Router, int]:
    """A router, and its number of parts, for a table of so many rows, from a sample of its vectors."""
    wanted = min(MOST_PARTS, max(1, rows // ROWS_PER_PART), max(1, len(points) // 32))
    parts = 1 << (wanted.bit_length() - 1)
    if parts < 2:
        return Router(np.zeros(points.shape[1]), 1.0, (np.zeros((points.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))), 1
    graph = nearest_in(points, GRAPH)
    return trained(points, graph, balanced_parts(graph, parts), parts), parts


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return np.asarray(vectors.flatten(), dtype=np.float64).reshape(-1, width)


def nearest(
    df: DataFrame, queries: Column, k: int = NEIGHBOURS, vector: str = "embedding", key: str = "vec_id", mass: float = MASS
) -> DataFrame:
    """(query_id, rank, key, score): the k nearest rows found of each row that ``queries`` picks.

    Score is the Euclidean distance in double precision; ties go to the smaller key, and rows
    with the query's own key are no candidates. Vectors that are null, all zero, hold a null or
    non-finite component or have another length than most take no part, as rows without key.
    Fewer candidates than k give as many rows; no rows give no rows; other columns are not read.
    """
    shipped(df.sparkSession)
    c = F.col(f"`{vector}`").cast("array<double>")
    rows = df.where(able(vector) & F.col(f"`{key}`").isNotNull())
    rows = rows.select(F.col(f"`{key}`").cast("long").alias("id"), c.alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    widths = rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "width").first()
    empty = f"query_id long, rank int, {key} long, score double"
    if widths is None:
        return df.sparkSession.createDataFrame([], empty)
    width, n = widths["width"], widths["n"]
    rows = rows.where(F.size("vector") == width)
    share = min(1.0, SAMPLE / n)
    # equal vectors are one in the sample, or a graph of copies would have no other edges
    sample = rows.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) < int(share * (1 << 20))).select("vector").distinct()
    router, parts = fit(np.array([r["vector"] for r in sample.orderBy("vector").collect()]).reshape(-1, width), n)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = router(matrix(batch.column("vector"), width))
            order = np.argsort(-p, axis=1, kind="stable")
            held = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
            first = [o[: int(np.searchsorted(h, mass)) + 1].tolist() for o, h in zip(order, held, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vector"), batch.column("asks"), pa.array(order[:, 0].astype(np.int32)), pa.array(first, pa.list_(pa.int32()))],
                ["id", "vector", "asks", "part", "parts"],
            )

    index = written(rows.mapInArrow(routed, "id long, vector array<double>, asks boolean, part int, parts array<int>"))
    # at most MOST_PARTS rows
    sizes = index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    pieces = F.broadcast(sizes)
    held = index.join(pieces, "part").select("part", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), "id", "vector")
    asked = index.where("asks").select("id", "vector", F.explode("parts").alias("part")).join(pieces, "part")
    asked = asked.select("part", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("id").alias("query"), F.col("vector").alias("point"))

    def search(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, points = left["id"].to_numpy(), matrix(left["vector"].combine_chunks(), width) if left.num_rows else np.zeros((0, width))
        found = ([], [], [])
        if left.num_rows and right.num_rows:
            for query, q in zip(right["query"].to_pylist(), matrix(right["point"].combine_chunks(), width), strict=True):
                score = np.sqrt(((points - q) ** 2).sum(axis=1))
                other = np.flatnonzero(ids != query)
                if len(other) > k:
                    # all that tie with the last one stay in until ids have decided
                    other = other[score[other] <= np.partition(score[other], k - 1)[k - 1]]
                best = other[np.lexsort((ids[other], score[other]))][:k]
                for out, x in zip(found, ([query] * len(best), ids[best].tolist(), score[best].tolist()), strict=True):
                    out += x
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    near = held.groupBy("part", "piece").cogroup(asked.groupBy("part", "piece")).applyInArrow(search, "query_id long, id long, score double")
    # at most k rows from each piece; rows that repeat a key and vector are one
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    best = near.distinct().withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(key), "score")
