"""Language identification by the nearest of several centroids per language.

Texts become TF-IDF vectors of hashed letter n-grams. Document frequencies come from
all labelled rows; the centroids are spherical k-means clusters of a bounded sample
of them. A text takes the language of the centroid with the largest cosine, and is
rejected when it is farther from it than texts of that language are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightlens.llm.words import chunks, extended, utf8_values

FEATURES = 4096
SAMPLE_ROWS = 3000
CENTROIDS = 3
PIECE_OCTETS = 2_000_000
ROWS_AT_ONCE = 512
UNKNOWN = "und"


class Letters:
    """Code points to lower-case letters; everything else becomes 0."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, text: bytes) -> np.ndarray:
        if cls.table is None:
            cls.table = np.zeros(0x110000, np.uint32)
            for i in range(0x110000):
                c = chr(i)
                if c.isalpha():
                    cls.table[i] = ord(c.lower()[0])
        return cls.table[np.frombuffer(text.decode(errors="replace").encode("utf-32-le"), "<u4")]


def _features(letters: np.ndarray) -> list[np.ndarray]:
    """(place, feature) of the n-grams of one to three letters. A 0 stands for a
    word's edge: pairs and triples may begin or end with one."""
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    middle = b != 0
    out = []
    for salt, keep, parts in (
            (1, middle, (b,)), (2, middle | (a != 0), (a, b)), (3, middle, (a, b, c))):
        h = np.full(int(keep.sum()), salt * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for part in parts:
            h = (h ^ part[keep]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        out.append((np.flatnonzero(keep), (h >> np.uint32(4)) % np.uint32(FEATURES)))
    return out


def term_counts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of every feature (texts x features), and which texts have a letter."""
    gap = np.zeros(2, np.uint32)
    parts = [gap]
    for text in texts:
        parts += [Letters.of(text or b""), gap]
    letters = np.concatenate(parts)
    owner = np.repeat(np.arange(len(texts)), [len(p) + 2 for p in parts[1::2]])
    owner = np.concatenate([owner, [len(texts) - 1]])  # of the place in the middle
    counts = np.zeros(len(texts) * FEATURES, np.int64)
    for place, feature in _features(letters):
        counts += np.bincount(owner[place] * FEATURES + feature, minlength=len(counts))
    counts = counts.reshape(len(texts), FEATURES)
    return counts, counts.sum(axis=1) > 0


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in chunks(batches, "text", PIECE_OCTETS):
        for at in range(0, piece.num_rows, ROWS_AT_ONCE):
            yield piece.slice(at, ROWS_AT_ONCE)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length (or of zeros): dampened counts times ``idf``."""
    weighted = np.log1p(counts.astype(np.float32)) * idf.astype(np.float32)
    norm = np.linalg.norm(weighted, axis=1, keepdims=True)
    return weighted / np.where(norm > 0, norm, 1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(FEATURES, np.int64)
    for piece in pieces(batches):
        counts, _ = term_counts(utf8_values(piece.column("text")))
        found += (counts > 0).sum(axis=0)
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays(
        [pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], names=["feature", "docs"])


def cluster(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the point nearest the mean, then the farthest ones."""
    chosen = [int(np.argmax(points @ points.mean(axis=0)))]
    while len(chosen) < min(k, len(points)):
        nearest = (points @ points[chosen].T).max(axis=1)
        chosen.append(int(np.argmin(nearest)))
    centres = points[chosen]
    for _ in range(rounds):
        own = np.argmax(points @ centres.T, axis=1)
        sums = np.stack([points[own == i].sum(axis=0) if (own == i).any() else centres[i]
                         for i in range(len(centres))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = sums / np.where(norm > 0, norm, 1)
    return centres


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray  # smallest accepted cosine of each centroid

    def predict(self, texts: list[bytes | None]):
        """Language, cosine and whether it was rejected, for each text."""
        counts, lettered = term_counts(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosines = vectors(counts, self.idf) @ self.centroids.T
        best = np.argmax(cosines, axis=1)
        score = np.clip(cosines[np.arange(len(texts)), best].astype(float), 0, 1)
        score[~lettered] = 0
        names = [self.languages[i] if has else UNKNOWN for i, has in zip(best, lettered)]
        return names, score, ~lettered | (score < self.least[best])


def fit(labelled: DataFrame, lang: str = "lang", sample_rows: int = SAMPLE_ROWS,
        centroids: int = CENTROIDS, slack: float = 0.5) -> LanguageModel:
    """Learn from ``text`` and a label column.

    Document frequencies count every labelled row. The centroids are fitted on at
    most ``sample_rows`` different texts, spread evenly over the languages and picked
    by a hash of the text; copies count once. Centroids accept cosines down to
    ``slack`` times the first percentile of their language's sample. Rows with a null
    text or label are left out.
    """
    rows = labelled.select("text", F.col(lang).alias("lang")).where(
        "text is not null and lang is not null")
    found = rows.select("text").mapInArrow(_frequencies, "feature int, docs long").groupBy(
        "feature").agg(F.sum("docs").alias("docs")).collect()
    by_language = {r["lang"]: r for r in rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.approx_count_distinct("text").alias("texts")).collect()}
    df = np.zeros(FEATURES)
    for row in found:
        df[row["feature"]] = row["docs"]
    idf = np.log((1 + sum(r["n"] for r in by_language.values())) / (1 + df)) + 0.1
    if not by_language:
        return LanguageModel(idf, np.zeros((0, FEATURES)), [], np.zeros(0))
    each = max(1, sample_rows // len(by_language))
    # About four times the sample is taken by its hash before anything is sorted.
    share = F.create_map(*[F.lit(x) for lang, r in by_language.items() for x in (
        lang, min(1.0, 4 * each / max(r["texts"], 1)))])
    picked = rows.select("lang", "text", F.xxhash64("text").alias("pick")).where(
        F.col("pick") / 2.0**64 + 0.5 <= share[F.col("lang")]).groupBy("lang", "pick").agg(
        F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("pick")
    sample = picked.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= each).select("lang", "text")

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            counts, lettered = term_counts(utf8_values(piece.column("text")))
            rows = vectors(counts, idf)
            yield pa.RecordBatch.from_arrays(
                [piece.column("lang"), pa.array([r.tobytes() for r in rows], pa.binary()),
                 pa.array(lettered)], names=["lang", "vector", "lettered"])

    points: dict[str, list[np.ndarray]] = {}
    for row in sample.mapInArrow(weighted, "lang string, vector binary, lettered boolean").where(
            "lettered").collect():
        points.setdefault(row["lang"], []).append(np.frombuffer(row["vector"], np.float32))
    centres, languages, least = [], [], []
    for name in sorted(points):
        own = np.stack(sorted(points[name], key=lambda v: v.tobytes()))
        found_centres = cluster(own, centroids)
        bound = slack * np.quantile((own @ found_centres.T).max(axis=1), 0.01)
        centres += list(found_centres)
        languages += [name] * len(found_centres)
        least += [bound] * len(found_centres)
    return LanguageModel(idf, np.array(centres).reshape(-1, FEATURES), languages, np.array(least))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``lang_pred, score, rejected`` beside the columns of ``docs``, which needs a
    ``text`` column; columns with those three names are replaced.

    A text that is null or has no letter is ``und`` with score 0 and rejected.
    Empty tables give empty results; equal texts get equal answers; ties fall to
    the first language in order.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    kept = docs.select(*keep)
    schema = extended(kept, "lang_pred string, score double, rejected boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            names, score, rejected = model.predict(utf8_values(piece.column("text")))
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()),
                 pa.array(rejected)], names=[*piece.schema.names, "lang_pred", "score", "rejected"])

    return kept.mapInArrow(run, schema)


def held_out(doc_id: str | Column, folds: int, fold: int) -> Column:
    """Whether crc32 of an id, as text, leaves ``fold`` modulo ``folds``; false for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))
