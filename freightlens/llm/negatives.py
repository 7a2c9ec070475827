"""Hard negatives by threshold joins in the manner of L2AP.

An anchor's neighbours are the rows whose inner product with it reaches a threshold.
Dimensions are ordered by their share of all squares, the largest first. A row is
indexed in its first dimensions only: by the Cauchy-Schwarz bound, what stands behind
the point where the norm of the rest falls below ``threshold / |anchor|`` can't reach
the threshold on its own. The postings of the first dimensions give partial scores;
a pair is dropped if the partial score and the product of both remaining norms stay
below the anchor's threshold, and the others are finished exactly.

Thresholds begin high. Anchors whose windows are not full are joined again with a
lower one, at last with the bound below which nothing counts, so the result is exact.

Rows and anchors are dealt into blocks of bounded size by a hash, whatever their
labels. A pair of blocks returns as many rows as a window holds, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightlens.session import reliable_checkpoint

BLOCK_ROWS = 4096
BLOCK_ANCHORS = 2048
CHUNK = 256
# Thresholds, as shares of the anchor's own square and of the positive's score. What
# they leave open is joined with the least bound that counts.
POSITIVE_SHARES = (0.6, 0.3)
NEGATIVE_SHARES = (0.75,)
PAIRED = "row long, k int, found_row long, found_id long, score long"


def usable(vector: Column) -> Column:
    """Not null, and no null or non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) < float("inf"))), F.lit(False))


def floored(vector: Column, scale: int) -> Column:
    """Components times ``scale``, rounded down; null where one is null or not finite."""
    return F.when(usable(vector), F.transform(
        vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dims).astype(np.float64)


class Index:
    """Postings of a block of rows. ``rest[:, p]`` is the norm of a row behind its
    first ``p`` dimensions."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.rest = self.norms(points)

    @staticmethod
    def norms(points: np.ndarray) -> np.ndarray:
        squares = np.cumsum((points * points)[:, ::-1], axis=1)[:, ::-1]
        return np.sqrt(np.pad(squares, ((0, 0), (0, 1))))

    def depths(self, reach: float) -> np.ndarray:
        """How many dimensions of each row are indexed, if a rest whose norm is below
        ``reach`` needs no posting."""
        return np.minimum((self.rest >= reach).sum(axis=1), self.points.shape[1])

    def join(self, anchors: np.ndarray, thresholds: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs (anchor, row) with their scores that reach the anchor's threshold."""
        rests = self.norms(anchors)
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(thresholds > 0, thresholds / rests[:, 0], -np.inf)
        depths = self.depths(reach.min(initial=np.inf))
        # Rows in the order of their depth: the postings of a dimension are one slice,
        # and rows of one depth get the sums of all their postings at once.
        order = np.argsort(depths, kind="stable")
        cuts = np.flatnonzero(np.diff(depths[order], prepend=-1))
        slack = 1e-9 * (np.abs(thresholds) + 1)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            rows, p = order[a:b], int(depths[order[a]])
            partial = anchors[:, :p] @ self.points[rows, :p].T
            most = partial + rests[:, p, None] * self.rest[rows, p] * (1 + 1e-9)
            i, near = np.nonzero(most >= (thresholds - slack)[:, None])
            j, score = rows[near], partial[i, near]
            for at in range(0, len(i), 200_000):
                part = slice(at, at + 200_000)
                score[part] += np.einsum(
                    "ij,ij->i", anchors[i[part], p:], self.points[j[part], p:])
            reached = score >= thresholds[i]
            out.append((i[reached], j[reached], score[reached]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _ordered(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.lexsort((rows, ids, -score, owner))


def _positives(k: int, dims: list[int]):
    """The first ``k`` rows of a block with the anchor's label, for each anchor."""

    def run(anchors: pa.Table, points: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and points.num_rows:
            own, ids, labels = (points.column(c).to_numpy() for c in ("row", "vec_id", "label"))
            vectors = _matrix(points.column("embedding"), len(dims))[:, dims]
            asked, wanted = (anchors.column(f"a_{c}").to_numpy() for c in ("row", "label"))
            queries = _matrix(anchors.column("a_embedding"), len(dims))[:, dims]
            bounds = anchors.column("a_threshold").to_numpy()
            for label in np.intersect1d(labels, wanted):
                there = np.flatnonzero(labels == label)
                index = Index(vectors[there])
                for at in _chunks(np.flatnonzero(wanted == label), bounds, queries):
                    i, j, score = index.join(queries[at], bounds[at])
                    i, j = at[i], there[j]
                    other = asked[i] != own[j]
                    i, j, score = i[other], j[other], score[other]
                    order = _ordered(i, score, ids[j], own[j])
                    i, j, score = i[order], j[order], score[order]
                    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                    out.append((asked[i[keep]], np.zeros(keep.sum(), np.int32), own[j[keep]],
                                ids[j[keep]], score[keep]))
        return _table(out)

    return run


def _chunks(at: np.ndarray, bounds: np.ndarray, queries: np.ndarray) -> Iterator[np.ndarray]:
    """Anchors in chunks of similar reach, so that one low threshold does not make
    the index deep for all."""
    norms = np.sqrt((queries[at] * queries[at]).sum(axis=1))
    order = at[np.argsort(-(bounds[at] / np.maximum(norms, 1e-300)), kind="stable")]
    for a in range(0, len(order), CHUNK):
        yield order[a:a + CHUNK]


def _table(out: list[tuple]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0)] * 5
    kinds = [np.int64, np.int32, np.int64, np.int64, np.int64]
    names = ["row", "k", "found_row", "found_id", "score"]
    return pa.table({n: pa.array(c.astype(t)) for n, c, t in zip(names, columns, kinds)})


def _negatives(k: int, low: int, high: int, dims: list[int]):
    """The first ``k`` rows of a block with another label in each window of an anchor."""

    def run(anchors: pa.Table, points: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and points.num_rows:
            own, ids, labels = (points.column(c).to_numpy() for c in ("row", "vec_id", "label"))
            index = Index(_matrix(points.column("embedding"), len(dims))[:, dims])
            asked, wanted = (anchors.column(f"a_{c}").to_numpy() for c in ("row", "label"))
            queries = _matrix(anchors.column("a_embedding"), len(dims))[:, dims]
            bounds = anchors.column("a_threshold").to_numpy()
            windows = anchors.column("a_windows").to_pylist()
            for at in _chunks(np.arange(len(asked)), bounds, queries):
                i, j, score = index.join(queries[at], bounds[at])
                other = wanted[at[i]] != labels[j]
                i, j, score = at[i[other]], j[other], score[other]
                order = _ordered(i, score, ids[j], own[j])
                i, j, score = i[order], j[order], score[order]
                for anchor in at:
                    first, last = np.searchsorted(i, [anchor, anchor + 1])
                    falling = -100 * score[first:last]
                    for window in windows[anchor]:
                        a = first + np.searchsorted(falling, -high * window["score"])
                        b = first + np.searchsorted(
                            falling, -max(low * window["score"], 100 * window["threshold"]), "right")
                        b = min(b, a + k)
                        if a < b:
                            n = b - a
                            out.append((np.full(n, asked[anchor]), np.full(n, window["k"]),
                                        own[j[a:b]], ids[j[a:b]], score[a:b]))
        return _table(out)

    return run


class _Blocks:
    """Rows by block, next to blocks of the anchors that are to meet all of them."""

    def __init__(self, rows: DataFrame, count: int) -> None:
        self.rows, self.blocks = rows, max(1, -(-count // BLOCK_ROWS))

    def join(self, anchors: DataFrame, count: int, run) -> DataFrame:
        parts = max(1, -(-count // BLOCK_ANCHORS))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        one = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        points = self.rows.select("row", "vec_id", "label", "embedding").withColumn(
            "block", one("row", self.blocks)).withColumn("part", every(parts))
        asked = anchors.toDF(*(f"a_{c}" for c in anchors.columns)).withColumn(
            "a_part", one("a_row", parts)).withColumn("a_block", every(self.blocks))
        return asked.groupBy("a_block", "a_part").cogroup(
            points.groupBy("block", "part")).applyInArrow(run, PAIRED)


def _first(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("row", "k").orderBy(F.desc("score"), "found_id", "found_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _dimensions(rows: DataFrame, dims: int) -> list[int]:
    """Dimensions by their sum of squares over all rows, the largest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims)
        for batch in batches:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            total += (flat.reshape(-1, dims) ** 2).sum(axis=0) if dims else 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dims)), pa.array(total)], names=["d", "s"])

    sums = rows.select("embedding").mapInArrow(run, "d long, s double").groupBy("d").agg(
        F.sum("s").alias("s"))
    return [r["d"] for r in sorted(sums.collect(), key=lambda r: (-r["s"], r["d"]))]


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3,
         low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of the rows of ``vec_id, label, embedding`` for which
    ``is_anchor`` holds, as ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score``.

    Components are integers as doubles, labels integers; a score is the inner product
    with the anchor, exact while it stays below 2**53. An anchor's positives are its first
    ``positives`` other rows of its label. For each, the first ``negatives`` rows of
    another label are returned that satisfy ``low * positive_score <=
    100 * negative_score <= high * positive_score``. Higher scores come first, ties
    by smaller ``vec_id``.

    Rows with a null id or label, a null vector or any null or non-finite component
    take no part. A vector that is shorter than the longest counts as filled with
    zeros. Repeated rows are rows of their own. Other columns are ignored; an empty
    table gives an empty result.
    """
    fine = vectors.select("vec_id", "label", "embedding", is_anchor.alias("anchor")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    dims = fine.agg(F.max(F.size("embedding"))).first()[0] or 0
    rows = reliable_checkpoint(fine.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.concat(F.col("embedding").cast("array<double>"), F.array_repeat(
            F.lit(0.0), F.lit(dims) - F.size("embedding"))).alias("embedding"),
        F.coalesce("anchor", F.lit(False)).alias("anchor")))
    order = _dimensions(rows, dims)
    count, n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
    blocks = _Blocks(rows, count)
    anchors = rows.where("anchor").select(
        "row", "label", "embedding", F.aggregate(
            "embedding", F.lit(0.0), lambda s, x: s + x * x).alias("square"))

    found, open_ = [], anchors
    for share in (*POSITIVE_SHARES, None):
        asked = open_.select("row", "label", "embedding", (
            F.lit(float("-inf")) if share is None else F.col("square") * share).alias("threshold"))
        first = reliable_checkpoint(_first(
            blocks.join(asked, n_anchors, _positives(positives, order)), positives))
        if share is None:
            found.append(first)
            break
        full = first.where(F.col("rank") == positives).select("row")
        found.append(first.join(full, "row", "left_semi"))
        open_ = open_.join(full, "row", "left_anti")
        if open_.isEmpty():
            break
    pairs = _union(found).where("score >= 0").select(
        "row", F.col("rank").alias("k"), F.col("found_id").alias("positive_id"),
        F.col("score").alias("positive_score"))

    found, open_ = [], pairs
    for share in (*NEGATIVE_SHARES, None):
        bound = F.col("positive_score") * F.lit(low) / 100 if share is None else (
            F.col("positive_score") * max(share, low / 100))
        windows = open_.groupBy("row").agg(
            F.collect_list(F.struct("k", F.col("positive_score").alias("score"), (
                F.lit(float("-inf")) if share is None else bound).alias("threshold"))
            ).alias("windows"), F.min(bound).alias("threshold"))
        asked = anchors.join(windows, "row").select(
            "row", "label", "embedding", "threshold", "windows")
        first = reliable_checkpoint(_first(
            blocks.join(asked, n_anchors, _negatives(negatives, low, high, order)), negatives))
        if share is None:
            found.append(first)
            break
        full = first.where(F.col("rank") == negatives).select("row", "k")
        found.append(first.join(full, ["row", "k"], "left_semi"))
        open_ = open_.join(full, ["row", "k"], "left_anti")
        if open_.isEmpty():
            break
    return _union(found).join(pairs, ["row", "k"]).join(
        rows.where("anchor").select("row", F.col("vec_id").alias("anchor_id")), "row").select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
