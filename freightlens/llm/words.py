"""Words, their hashes and rolling window hashes, as numpy helpers inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: a word, by every contract on word counts.
WORD = r"[^\x20\x09-\x0D]+"

# Odd multipliers of the two independent rolling hashes (arithmetic modulo 2**64).
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def extended(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` with more columns behind."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def split_words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text. ``bytes.split`` parts at the six ASCII white
    space characters and no others, which is what ``WORD`` says."""
    return text.split() if text else []


def utf8_values(column: pa.Array) -> list[bytes | None]:
    """The texts of a string column as bytes, nulls kept."""
    return column.cast(pa.binary()).to_pylist()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, limit: int = 300_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the value."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Rabin-Karp hashes of all windows of a sequence of token hashes.

    A window's hash is the sum of ``token * base**place``; differences of one
    running sum give all windows at once.
    """

    def __init__(self, base: int) -> None:
        self.base = np.uint64(base)
        self.inverse_base = np.uint64(pow(base, -1, 2**64))
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            size = 1 << int(n - 1).bit_length()
            for name, base in (("powers", self.base), ("inverses", self.inverse_base)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def windows(self, tokens: np.ndarray, width: int) -> np.ndarray:
        n = len(tokens)
        if n < width:
            return np.empty(0, np.uint64)
        self._grow(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(tokens * self.powers[:n], out=sums[1:])
        return (sums[width:] - sums[:-width]) * self.inverses[: n - width + 1]


def owners(counts: Sequence[int]) -> np.ndarray:
    """The row number of every item, for rows with so many items each."""
    return np.repeat(np.arange(len(counts)), counts)


def inside(owner: np.ndarray, width: int) -> np.ndarray:
    """Which windows of a concatenation lie in one row."""
    return owner[: len(owner) - width + 1] == owner[width - 1:] if len(owner) >= width else (
        np.empty(0, bool))


def row_key() -> Column:
    """128 bits of a row's ``doc_id`` and ``text``, also where either is null: rows with
    one key are copies of each other."""
    return F.unhex(F.md5(F.concat(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        F.when(F.col("text").isNull(), F.lit("-")).otherwise(F.lit(" ")),
        F.coalesce("text", F.lit("")))))


# What this process keeps from task to task, by its operator's key.
KEPT: dict[str, object] = {}


def kept(key: str, make: Callable[[], Any]) -> Any:
    """What ``make()`` gave when this process was first asked under ``key``, until
    :func:`chunks` begins for another operator."""
    if key not in KEPT:
        KEPT[key] = make()
    return KEPT[key]


def _release(keep: str | None) -> None:
    """Drop what other operators have kept here, and give the room that Arrow holds free
    back to the machine."""
    for key in KEPT.keys() - {keep}:
        del KEPT[key]
    pa.default_memory_pool().release_unused()


def chunks(batches: Iterable[pa.RecordBatch], text: str, octets: int,
           row_octets: int = 64, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about so many octets of ``text``, each row
    counting ``row_octets`` more, so that a task's memory follows neither the number
    of rows in a batch nor their length.

    Workers outlive tasks and stages, and an executor has several. So a task begins
    without what operators other than its own (``keep``) have kept, and Arrow's free room
    goes back after every batch."""
    _release(keep)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)
        piece = np.cumsum(sizes + row_octets) // octets
        starts = np.flatnonzero(np.diff(piece, prepend=-1))
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(start, end - start)
        del batch
        pa.default_memory_pool().release_unused()


def narrow(values: np.ndarray) -> tuple[bytes, int]:
    """Non-negative integers in the fewest octets each, and that number."""
    most = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    return values.astype(f"<u{width}").tobytes(), width


def widened(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{width}").astype(np.int64)
