"""URL rules by a cascade of Bloom filters.

The first filter encodes the listed keys; the second the keys of the corpus that the
first takes wrongly; the third the listed keys that the second takes wrongly; and so
on until a level makes no mistake. A key of the corpus is listed exactly if the number
of levels that take it, one after the other, is odd. The filters hold some bits per
listed key and travel to the tasks; no URL is joined or moved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.llm.words import extended
from freightlens.session import reliable_checkpoint

FIRST_RATE = 1 / 256
NEXT_RATE = 1 / 2
MOST_BYTES = 256_000_000


@dataclass
class Bloom:
    bits: np.ndarray  # packed, 64 to a word
    size: int
    hashes: int
    seed: int

    def __contains__(self, key: str) -> bool:
        return all(int(self.bits[p >> 6]) >> (p & 63) & 1 for p in places(
            key, self.size, self.hashes, self.seed))


def places(key: str, size: int, hashes: int, seed: int) -> list[int]:
    both = xxhash.xxh3_128_intdigest(key.encode(), seed)
    a, b = both >> 64, both & 0xFFFFFFFFFFFFFFFF | 1
    return [(a + i * b) % size for i in range(hashes)]


def build(keys: DataFrame, count: int, rate: float, seed: int) -> Bloom:
    """A filter of the ``key`` column: tasks set bits, words are combined by key."""
    size = max(64, math.ceil(count * math.log2(1 / rate) * 1.44))
    hashes = max(1, round(math.log2(1 / rate)))
    if size // 8 > MOST_BYTES:
        raise ValueError(f"a filter of {size // 8} bytes is above the bound of {MOST_BYTES}")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, int] = {}
            for key in batch.column("key").to_pylist():
                for p in places(key, size, hashes, seed):
                    found[p >> 6] = found.get(p >> 6, 0) | 1 << (p & 63)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int64()),
                 pa.array(np.array(list(found.values()), np.uint64).astype(np.int64))],
                names=["at", "word"])

    bits = np.zeros(size // 64 + 1, np.uint64)
    for row in keys.select("key").mapInArrow(words, "at long, word long").groupBy("at").agg(
            F.bit_or("word").alias("word")).toLocalIterator():
        bits[row["at"]] = np.int64(row["word"]).astype(np.uint64)
    return Bloom(bits, size, hashes, seed)


@dataclass
class Cascade:
    """Exact membership for the keys of the universe it was built over."""

    levels: list[Bloom]

    def __contains__(self, key: str) -> bool:
        taken = 0
        for level in self.levels:
            if key not in level:
                break
            taken += 1
        return taken % 2 == 1

    @classmethod
    def over(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """Both have a ``key`` column; null keys are left out. Only what the first
        level takes is compared with the list, by an anti join."""
        listed = reliable_checkpoint(listed.select("key").where("key is not null").distinct())
        count = listed.count()
        if not count:
            return cls([])
        levels = [build(listed, count, FIRST_RATE, 0)]
        inside, outside = listed, reliable_checkpoint(
            _passing(universe.select("key").where("key is not null"), levels[0]).distinct().join(
                listed, "key", "left_anti"))
        while True:
            # outside: keys that all levels so far took and that must not count as taken
            wrong = outside.count()
            if not wrong:
                return cls(levels)
            levels.append(build(outside, wrong, NEXT_RATE, len(levels)))
            inside, outside = outside, reliable_checkpoint(_passing(inside, levels[-1]))


def _passing(keys: DataFrame, level: Bloom) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [k for k in batch.column("key").to_pylist() if k in level]
            yield pa.RecordBatch.from_arrays([pa.array(known, pa.string())], names=["key"])

    return keys.mapInArrow(run, "key string")


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    """Host and path: the host runs from the first ``://`` to ``/``, ``?``, ``#`` or
    the end, the path from there to ``?``, ``#`` or the end. Both are empty for
    null and for texts without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def candidates(host: str, path: str, lengths: Sequence[int]) -> list[str]:
    """Keys under which a rule for this URL can be listed, the longest first: the
    host and its parent domains, with the path's beginnings of the listed lengths."""
    labels = host.split(".")
    domains = [".".join(labels[i:]) for i in range(len(labels))]
    heads = [path[:n] for n in sorted(lengths, reverse=True) if n <= len(path)]
    return sorted((d + h for d in domains for h in heads), key=len, reverse=True)


@dataclass
class UrlRules:
    """Rules ``(verdict, host, path)``; the longest that fits a URL decides."""

    rules: Sequence[tuple[str, str, str]]
    otherwise: str = "allow"

    def lengths(self) -> list[int]:
        return sorted({len(path) for _, _, path in self.rules})


def judge(pages: DataFrame, rules: UrlRules) -> DataFrame:
    """``host, path, rule, verdict`` beside the columns of ``pages``, which needs
    ``url``; columns with those four names are replaced.

    A rule fits its host and all subdomains if the path starts with the rule's. The
    list is told apart by verdict: one cascade for the allowing rules and one for the
    blocking ones, each exact over all keys of the corpus. A URL that no rule fits,
    a null one included, gets ``rules.otherwise``. Repeated rows are judged each; an
    empty table gives an empty result. Listing a rule twice is the same as once; of
    one rule with both verdicts, blocking holds.
    """
    spark, lengths = pages.sparkSession, rules.lengths()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {k for url in batch.column("url").to_pylist()
                     for k in candidates(*parts(url), lengths)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["key"])

    universe = pages.select("url").mapInArrow(keys, "key string")
    cascades = {}
    for verdict in ("block", "allow"):
        listed = [(host.translate(_LOWER) + path,) for v, host, path in rules.rules if v == verdict]
        cascades[verdict] = Cascade.over(spark.createDataFrame(listed, "key string"), universe)
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    kept = pages.select(*keep)
    schema = extended(kept, "host string, path string, rule string, verdict string")

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                host, path = parts(url)
                rule, verdict = None, rules.otherwise
                for key in candidates(host, path, lengths):
                    verdict = next((v for v, c in cascades.items() if key in c), None)
                    if verdict:
                        rule = key
                        break
                rows.append((host, path, rule, verdict or rules.otherwise))
            columns = [pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 4)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns],
                names=[*batch.schema.names, "host", "path", "rule", "verdict"])

    return kept.mapInArrow(verdicts, schema)
