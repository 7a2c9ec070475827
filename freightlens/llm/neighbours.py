"""Approximate nearest neighbours through learned partitions.

A bounded sample gives a neighbour graph; balanced partitioning of the graph gives
each sampled vector a part; a small classifier learns the parts from the vectors.
It sends every indexed vector to its most probable part and every query to several,
where all vectors are ranked by their exact cosine.

Parts and the queries of a part are cut into blocks of bounded size before they
meet, so a part of any size is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightlens.llm.words import extended
from freightlens.session import reliable_checkpoint

SAMPLE_ROWS = 6000
GRAPH_NEIGHBOURS = 10
PART_ROWS = 2000
MOST_PARTS = 256
PROBABILITY = 0.97
BLOCK_ROWS = 4000
BLOCK_QUERIES = 1000


def neighbour_graph(points: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other rows of every row of unit vectors, in blocks."""
    out = np.empty((len(points), min(k, len(points) - 1)), np.int64)
    for at in range(0, len(points), 1024):
        near = points[at:at + 1024] @ points.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at:at + 1024] = np.argpartition(-near, out.shape[1] - 1, axis=1)[:, :out.shape[1]]
    return out


def balanced_parts(points: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 15) -> np.ndarray:
    """A part for every row, all of nearly one size, cutting few graph edges.

    Starts from halves along principal directions; then rows move to the part that
    has most of their neighbours, the largest gains first, while there is room.
    """
    own = np.zeros(len(points), np.int64)

    def halve(rows: np.ndarray, first: int, count: int) -> None:
        own[rows] = first
        if count < 2 or len(rows) < 2:
            return
        low = count // 2
        centred = points[rows] - points[rows].mean(axis=0)
        _, vectors = np.linalg.eigh(centred.T @ centred)
        order = rows[np.argsort(centred @ vectors[:, -1], kind="stable")]
        cut = len(rows) * low // count
        halve(order[:cut], first, low)
        halve(order[cut:], first + low, count - low)

    halve(np.arange(len(points)), 0, parts)
    most = math.ceil(len(points) / parts * 1.05)
    sizes = np.bincount(own, minlength=parts)
    both = np.concatenate([np.stack([np.repeat(np.arange(len(graph)), graph.shape[1]),
                                     graph.ravel()]),
                           np.stack([graph.ravel(), np.repeat(np.arange(len(graph)),
                                                              graph.shape[1])])], axis=1)
    for _ in range(rounds):
        near = np.bincount(both[0] * parts + own[both[1]],
                           minlength=len(points) * parts).reshape(-1, parts)
        best = near.argmax(axis=1)
        gain = near[np.arange(len(own)), best] - near[np.arange(len(own)), own]
        moved = 0
        for row in np.argsort(-gain, kind="stable"):
            if gain[row] <= 0:
                break
            if sizes[best[row]] < most:
                sizes[own[row]] -= 1
                sizes[best[row]] += 1
                own[row] = best[row]
                moved += 1
        if not moved:
            break
    return own


@dataclass
class Router:
    """A classifier with one hidden layer, from unit vectors to parts."""

    weights: list[np.ndarray]
    parts: int

    def probabilities(self, points: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        z = np.maximum(points.astype(np.float32) @ a + b, 0) @ c + d
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    @classmethod
    def fit(cls, points: np.ndarray, targets: np.ndarray, hidden: int = 128, epochs: int = 40,
            rate: float = 3e-3, seed: int = 1) -> Router:
        """Adam on cross-entropy; ``targets`` are distributions over the parts."""
        random = np.random.default_rng(seed)
        x, t = points.astype(np.float32), targets.astype(np.float32)
        shapes = [(x.shape[1], hidden), (hidden,), (hidden, t.shape[1]), (t.shape[1],)]
        w = [(random.normal(size=s) * math.sqrt(2 / s[0]) if len(s) == 2 else np.zeros(s)).astype(
            np.float32) for s in shapes]
        m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(epochs):
            for rows in np.array_split(random.permutation(len(x)), max(1, len(x) // 256)):
                h = np.maximum(x[rows] @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                g = (p / p.sum(axis=1, keepdims=True) - t[rows]) / len(rows)
                back = (g @ w[2].T) * (h > 0)
                step += 1
                for i, d in enumerate([x[rows].T @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0)]):
                    m[i] = 0.9 * m[i] + 0.1 * d
                    v[i] = 0.999 * v[i] + 0.001 * d * d
                    w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (
                        np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return cls(w, t.shape[1])


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zeros."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.empty((0, 0))


def _unit(points: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is taken out first, so that no
    square overflows or vanishes."""
    points = points / np.abs(points).max(axis=1, keepdims=True)
    return points / np.sqrt((points * points).sum(axis=1, keepdims=True))


def cosines(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Cosine of row i of one with row i of the other; the same for equal rows
    wherever they stand."""
    scale = np.sqrt((queries * queries).sum(axis=1) * (points * points).sum(axis=1))
    return (queries * points).sum(axis=1) / scale


def fit(vectors: DataFrame, parts: int, sample_rows: int = SAMPLE_ROWS) -> Router:
    """A router from at most ``sample_rows`` distinct vectors, picked by a hash."""
    sample = vectors.select("embedding", F.xxhash64("embedding").alias("pick")).dropDuplicates(
        ["pick"]).orderBy("pick").limit(sample_rows).select("embedding").collect()
    points = _unit(np.array([r["embedding"] for r in sample], np.float64))
    if len(points) < 2 * parts:
        parts = max(1, len(points) // 2)
    graph = neighbour_graph(points, GRAPH_NEIGHBOURS) if len(points) > 1 else np.empty(
        (len(points), 0), np.int64)
    own = balanced_parts(points, graph, parts)
    targets = np.eye(parts)[own] * 0.5
    if graph.shape[1]:
        targets += 0.5 * np.eye(parts)[own[graph]].mean(axis=1)
    return Router.fit(points, targets / targets.sum(axis=1, keepdims=True))


def _route(router: Router, probability: float):
    """Every vector's part; for a query also the parts to search, most probable
    first until they hold ``probability``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = router.probabilities(_unit(_matrix(batch.column("embedding"))))
            order = np.argsort(-p, axis=1, kind="stable")
            share = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
            number = 1 + (share < probability).sum(axis=1)
            searched = [o[:n].tolist() if q else None for o, n, q in zip(
                order, number, batch.column("is_query").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(order[:, 0], pa.int32()),
                 pa.array(searched, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "part", "searched"])

    return run


def _rank(k: int):
    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and points.num_rows:
            ids = points.column("vec_id").to_numpy()
            raw = _matrix(points.column("embedding").combine_chunks())
            own = queries.column("query_vec_id").to_numpy()
            wanted = _matrix(queries.column("query_embedding").combine_chunks())
            unit = _unit(raw)
            for at in range(0, len(own), 256):
                near = _unit(wanted[at:at + 256]) @ unit.T
                near[own[at:at + 256, None] == ids[None, :]] = -np.inf
                n = min(k, near.shape[1])
                least = -np.partition(-near, n - 1, axis=1)[:, n - 1] - 1e-9
                row, column = np.nonzero((near >= least[:, None]) & np.isfinite(near))
                score = cosines(wanted[at + row], raw[column])
                order = np.lexsort((ids[column], -score, row))
                row, column, score = row[order], column[order], score[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                keep = rank < k
                out += zip(own[at + row[keep]], ids[column[keep]], score[keep])
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()),
                         "vec_id": pa.array(columns[1], pa.int64()),
                         "score": pa.array(columns[2], pa.float64())})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5,
           probability: float = PROBABILITY) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each row
    of ``vec_id, embedding`` for which ``is_query`` holds, nearest first.

    The score is the cosine in double precision; ties fall to the smaller
    ``vec_id``. Vectors that are null, zero or hold a null or non-finite component,
    and rows with a null id, take no part; all others must have one length. A row
    is no neighbour of rows with its id; rows that repeat a whole row count once.
    Other columns are ignored; an empty table gives an empty result.
    """
    clean = vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias(
        "is_query")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    clean = clean.dropDuplicates(["vec_id", "embedding"])
    rows = clean.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not rows:
        return vectors.sparkSession.createDataFrame([], schema)
    router = fit(clean, max(1, min(MOST_PARTS, rows // PART_ROWS)))
    routed = reliable_checkpoint(clean.mapInArrow(
        _route(router, probability), extended(clean, "part int, searched array<int>")))
    asked = routed.where("is_query").select(
        "vec_id", "embedding", F.explode("searched").alias("part"))
    sizes = dict(routed.groupBy("part").count().collect())
    queries = dict(asked.groupBy("part").count().collect())
    numbers = vectors.sparkSession.createDataFrame(
        [(p, -(-sizes.get(p, 0) // BLOCK_ROWS) or 1, -(-queries.get(p, 0) // BLOCK_QUERIES) or 1)
         for p in range(router.parts)], "part int, blocks long, query_blocks long")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n))
    key = ["part", "block", "query_block"]
    points = routed.select("vec_id", "embedding", "part").join(numbers, "part").withColumn(
        "block", one("blocks", 1)).withColumn("query_block", every("query_blocks"))
    asked = asked.join(numbers, "part").withColumn(
        "query_block", one("query_blocks", 2)).withColumn("block", every("blocks"))
    columns = [*key, "vec_id", "embedding"]
    asked = asked.select(*columns).toDF(*(f"query_{c}" for c in columns))
    found = asked.groupBy(*(f"query_{c}" for c in key)).cogroup(
        points.select(*columns).groupBy(*key)).applyInArrow(
        _rank(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
