"""Benchmark decontamination by suffix arrays of the training texts.

A task takes a shard of documents and sorts its suffixes, word by word: the shard's
suffix array. Every suffix of every benchmark item is then looked up in it by binary
search. The interval of suffixes that begin with the item's next ``width`` words
gives all places where that window occurs; going deeper gives the longest verbatim
match and its location. Shards are searched on their own, so no document moves.

A match can't go past a word that no item has, nor past the longest item. Suffixes
are therefore compared up to such a word and to that length, and those that are
shorter than the shortest window are left out: they can match nothing.

The benchmark is sent to the tasks in groups of items of bounded size, one after the
other, whatever its whole size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.llm.words import chunks, owners, utf8_values
from freightlens.session import reliable_checkpoint

WIDTH = 10
PIECE_OCTETS = 4_000_000
GROUP_OCTETS = 16_000_000

# Fixed value: letters and digits, and all beyond ASCII, make words; A-Z are lowered.
_FOLDED = bytes(
    c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else ord(chr(c).lower())
    if chr(c).isupper() else 0x20 for c in range(256))


def folded_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text, A-Z lowered."""
    return text.translate(_FOLDED).split() if text else []


class _Numbers(dict):
    """Word numbers; 0 for words that no item has."""

    def __missing__(self, word: bytes) -> int:
        return 0


@dataclass
class Keys:
    """Numbers of a concatenation of texts, each closed by a 0, and ``per_key`` of
    them packed into one integer from every place on."""

    numbers: np.ndarray
    bits: int
    per_key: int = field(init=False)
    packed: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.per_key = 62 // self.bits
        padded = np.append(self.numbers, np.zeros(self.per_key, np.int64))
        n = len(self.numbers)
        self.packed = np.zeros(n + 1, np.int64)
        for i in range(self.per_key):
            # What stands behind a 0 belongs to another text or can't match.
            np.left_shift(self.packed, self.bits, out=self.packed)
            self.packed[:n] |= padded[i:i + n]

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.packed[np.minimum(places, len(self.numbers))]

    def cut(self, keys: np.ndarray) -> np.ndarray:
        """Keys without what stands behind their first 0."""
        keys = keys.copy()
        ended = np.zeros(len(keys), bool)
        for i in range(self.per_key - 1, -1, -1):
            mask = ((1 << self.bits) - 1) << (self.bits * i)
            ended |= (keys & mask) == 0
            keys[ended] &= ~mask
        return keys


def room(numbers: np.ndarray) -> np.ndarray:
    """How many places from each one on hold no 0."""
    at = np.arange(len(numbers))
    zero = np.where(numbers == 0, at, len(numbers))
    return np.minimum.accumulate(zero[::-1])[::-1] - at


class SuffixArray:
    """Sorted suffixes of a shard that have at least ``least`` known words, compared
    up to ``depth`` words."""

    def __init__(self, keys: Keys, least: int, depth: int) -> None:
        self.keys = keys
        rooms = room(keys.numbers)
        places = np.flatnonzero(rooms >= least)
        found = keys.cut(keys.at(places))
        order = np.argsort(found, kind="stable")
        self.places, self.first = places[order], found[order]
        # A group is named by the index where it starts, so its order never changes.
        group = self._starts(np.diff(self.first, prepend=-1) != 0)
        for reached in range(keys.per_key, depth, keys.per_key):
            # Suffixes that agree with a neighbour so far, and go on, are compared on.
            same = np.append(False, group[1:] == group[:-1])
            open_ = np.flatnonzero((same | np.append(same[1:], False))
                                   & (rooms[self.places] >= reached))
            if not len(open_):
                break
            deeper = keys.cut(keys.at(self.places[open_] + reached))
            order = np.lexsort((deeper, group[open_]))
            self.places[open_], deeper = self.places[open_[order]], deeper[order]
            turn = (np.diff(deeper, prepend=-1) != 0) | (np.diff(group[open_], prepend=-1) != 0)
            group[open_] = open_[self._starts(turn)]

    @staticmethod
    def _starts(turn: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(turn, np.arange(len(turn)), 0))

    def _bound(self, low: np.ndarray, high: np.ndarray, reached: int,
               wanted: np.ndarray) -> np.ndarray:
        """First place in ``low:high`` whose key ``reached`` words on is not smaller."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            less = open_ & (self._key(np.minimum(mid, len(self.places) - 1), reached) < wanted)
            low = np.where(less, mid + 1, low)
            high = np.where(open_ & ~less, mid, high)
        return low

    def _key(self, index: np.ndarray, reached: int) -> np.ndarray:
        return self.keys.cut(self.keys.at(self.places[index] + reached))

    def search(self, suffixes: np.ndarray, tests: Keys, lengths: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
        """Where the suffixes stand that begin with ``lengths`` words of each test suffix."""
        low = np.zeros(len(suffixes), np.int64)
        high = np.full(len(suffixes), len(self.places))
        step, bits = self.keys.per_key, self.keys.bits
        for reached in range(0, int(lengths.max(initial=0)), step):
            at = np.flatnonzero((lengths > reached) & (low < high))
            if not len(at):
                break
            free = bits * np.maximum(step - (lengths[at] - reached), 0)
            least = (tests.at(suffixes[at] + reached) >> free) << free
            most = least + (np.int64(1) << free)
            if reached == 0:
                low[at], high[at] = (np.searchsorted(self.first, x) for x in (least, most))
            else:
                start = self._bound(low[at], high[at], reached, least)
                high[at] = self._bound(start, high[at], reached, most)
                low[at] = start
        return low, high

    def longest(self, suffixes: np.ndarray, tests: Keys, rooms: np.ndarray, low: np.ndarray,
                high: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest match of each test suffix and one place that has it.
        ``low:high`` are the suffixes that share its first ``known`` words; each
        further word narrows them until none is left."""
        low, high, length = low.copy(), high.copy(), known.copy()
        place = self.places[low]
        live = np.flatnonzero(length < rooms)
        while len(live):
            start, end = self.search_word(
                low[live], high[live], length[live], tests.numbers[suffixes[live] + length[live]])
            going = start < end
            live, start, end = live[going], start[going], end[going]
            low[live], high[live] = start, end
            place[live] = self.places[start]
            length[live] += 1
            live = live[length[live] < rooms[live]]
        return length, place

    def search_word(self, low: np.ndarray, high: np.ndarray, reached: np.ndarray,
                    word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of ``low:high`` whose word ``reached`` words on is ``word``."""
        bounds = []
        for wanted in (word, word + 1):
            left, right = (bounds[0].copy() if bounds else low.copy()), high.copy()
            while (open_ := left < right).any():
                mid = np.minimum((left + right) >> 1, len(self.places) - 1)
                here = np.minimum(self.places[mid] + reached, len(self.keys.numbers) - 1)
                less = open_ & (self.keys.numbers[here] < wanted)
                left, right = np.where(less, mid + 1, left), np.where(open_ & ~less, mid, right)
            bounds.append(left)
        return bounds[0], bounds[1]


class Tests:
    """Items of a benchmark with the suffixes that are looked up: one for every window
    of ``width`` words, or of the whole item where it is shorter."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], width: int) -> None:
        texts = [(name, words) for name, text in items if (words := folded_words(text))]
        self.names = [name for name, _ in texts]
        words = sorted({w for _, text in texts for w in text})
        self.numbers = _Numbers(zip(words, range(1, len(words) + 1)))
        self.bits = max(1, len(words).bit_length())
        lengths = np.array([len(t) for _, t in texts], np.int64)
        flat = np.fromiter(
            (n for _, t in texts for n in (*map(self.numbers.__getitem__, t), 0)), np.int64)
        self.keys = Keys(flat, self.bits)
        self.item = owners(lengths + 1)
        self.start = (np.cumsum(lengths + 1) - lengths - 1)[self.item] if len(texts) else flat
        self.room = room(flat)
        window = np.minimum(lengths, width)[self.item] if len(texts) else flat
        self.suffixes = np.flatnonzero((self.room >= window) & (self.room > 0))
        self.windows = window[self.suffixes]
        self.least = int(self.windows.min(initial=1 << 40))
        self.depth = int(lengths.max(initial=0))

    def shard(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, SuffixArray]:
        """Word counts of texts, the text of every place, and their suffix array."""
        counts, numbers = [], []
        for text in texts:
            words = folded_words(text)
            counts.append(len(words))
            numbers.append(np.fromiter(
                map(self.numbers.__getitem__, words), np.int64, len(words)))
            numbers.append(np.zeros(1, np.int64))
        flat = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        sizes = np.array(counts, np.int64)
        return sizes, owners(sizes + 1), SuffixArray(
            Keys(flat, self.bits), self.least, self.depth)


def _spans(covered: np.ndarray, start: int) -> list[dict]:
    turns = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0)) - start
    return [{"start": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)]


def _found(tests: Tests, texts: list[bytes | None]):
    """Word counts, and for each text that is hit the covered places and the names of
    the items whose windows occur in it."""
    sizes, owner, array = tests.shard(texts)
    low, high = array.search(tests.suffixes, tests.keys, tests.windows)
    hit = np.flatnonzero(low < high)
    # Suffixes with one window have one interval, which is marked once.
    intervals, window = np.unique(
        np.stack([low[hit], high[hit], tests.windows[hit]]), axis=1, return_inverse=True)
    n = intervals[1] - intervals[0]
    at = array.places[np.repeat(intervals[0] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    edge = np.zeros(len(owner) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + np.repeat(intervals[2], n), -1)
    covered = np.cumsum(edge)[:-1] > 0
    begins = np.cumsum(sizes + 1) - sizes - 1
    pairs = np.unique(np.stack([owner[at], np.repeat(np.arange(len(n)), n)]), axis=1)
    items: dict[int, set] = {}
    for k, i in zip(window.reshape(-1), tests.item[tests.suffixes[hit]]):
        items.setdefault(int(k), set()).add(tests.names[i])
    known: dict[bytes, list] = {}  # copies share their windows
    cuts = np.flatnonzero(np.diff(pairs[0], prepend=-1))
    result = {}
    for a, b in zip(cuts, [*cuts[1:], pairs.shape[1]]):
        doc, which = int(pairs[0, a]), pairs[1, a:b]
        if (mark := which.tobytes()) not in known:
            known[mark] = sorted(set().union(*(items[int(k)] for k in which)) - {None})
        start = int(begins[doc])
        result[doc] = (covered[start:start + int(sizes[doc])], known[mark])
    return sizes, result


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _mark(shared):
    """Adds what this group of items hits to the spans and items of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        for batch in chunks(batches, "text", PIECE_OCTETS):
            sizes, found = _found(tests, utf8_values(batch.column("text")))
            spans, items = (batch.column(c).to_pylist() for c in ("spans", "items"))
            for doc, (covered, names) in found.items():
                covered = covered.copy()
                for span in spans[doc]:
                    covered[span["start"]:span["end"]] = True
                spans[doc] = _spans(covered, 0)
                items[doc] = sorted({*items[doc], *names})
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(sizes, pa.int64()),
                 pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "text", "n_words", "spans", "items"])

    return run


def _leave_out(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        for batch in chunks(batches, "text", PIECE_OCTETS):
            _, found = _found(tests, utf8_values(batch.column("text")))
            clean = np.ones(batch.num_rows, bool)
            clean[list(found)] = False
            yield batch.filter(pa.array(clean))

    return run


def _longest(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        for batch in chunks(batches, "text", PIECE_OCTETS):
            sizes, owner, array = tests.shard(utf8_values(batch.column("text")))
            low, high = array.search(tests.suffixes, tests.keys, tests.windows)
            hit = np.flatnonzero(low < high)
            suffixes = tests.suffixes[hit]
            length, place = array.longest(
                suffixes, tests.keys, tests.room[suffixes], low[hit], high[hit],
                tests.windows[hit])
            begins = np.cumsum(sizes + 1) - sizes - 1
            item = tests.item[suffixes]
            # One row for each item of the shard: its longest match, the first such.
            order = np.lexsort((suffixes, -length, item))
            order = order[np.append(True, np.diff(item[order]) != 0)] if len(order) else order
            doc = owner[place[order]]
            ids = batch.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([tests.names[i] for i in item[order]], pa.string()),
                 pa.array(length[order], pa.int64()),
                 pa.array(suffixes[order] - tests.start[suffixes[order]], pa.int64()),
                 pa.array([ids[d] for d in doc], batch.schema.field("doc_id").type),
                 pa.array(place[order] - begins[doc], pa.int64())],
                names=["item_id", "n_words", "item_start", "doc_id", "doc_start"])

    return run


def _groups(benchmark: DataFrame, width: int, octets: int) -> Iterator:
    """The items in groups of about ``octets`` of text each, as broadcast ``Tests``."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(
        "text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // octets))
    for i in range(groups):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == i)
        yield benchmark.sparkSession.sparkContext.broadcast(Tests(
            [(r["item_id"], r["text"].encode()) for r in part.toLocalIterator()], width))


def _passes(df: DataFrame, benchmark: DataFrame, step, width: int, octets: int) -> DataFrame:
    """``step`` over ``df`` with one group of items after the other."""
    for i, shared in enumerate(_groups(benchmark, width, octets)):
        if i:  # one group at a time in a task's memory
            df = reliable_checkpoint(df)
        df = df.mapInArrow(step(shared), df.schema)
    return df


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH,
         octets: int = GROUP_OCTETS) -> DataFrame:
    """``doc_id, text, n_words, spans, items`` for every row of ``docs``: the maximal
    word intervals (from ``start``, up to but without ``end``) that windows of
    benchmark items cover, and the ``item_id`` of these items as sorted strings.

    A window is ``width`` consecutive words of an item, or the whole item if it has
    fewer. Null or empty texts have no words and hit nothing. Items with a null id
    hit, but are not listed; repeated items count once. Other columns are ignored;
    an empty table of documents gives an empty result, one of items hits nothing. A
    task holds the words of a few million octets of text, or of one longer text.
    """
    plain = docs.select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"))
    return _passes(plain, benchmark, _mark, width, octets)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH,
                  octets: int = GROUP_OCTETS) -> DataFrame:
    """The rows of ``docs``, with all columns, that no window of ``benchmark`` hits."""
    return _passes(docs, benchmark, _leave_out, width, octets)


def longest_matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH,
                    octets: int = GROUP_OCTETS) -> DataFrame:
    """``item_id, n_words, item_start, doc_id, doc_start``: the longest verbatim match
    of each item in the documents that is not shorter than its window, and one of the
    places where it is."""
    plain = docs.select("doc_id", "text")
    kind = plain.schema["doc_id"].dataType.simpleString()
    found = reduce(DataFrame.unionByName, [
        plain.mapInArrow(_longest(shared), "item_id string, n_words long, item_start long, "
                         f"doc_id {kind}, doc_start long")
        for shared in _groups(benchmark, width, octets)])
    best = F.struct(-F.col("n_words"), F.col("doc_id").isNull(), "doc_id", "doc_start", "item_start")
    return found.groupBy("item_id").agg(F.min_by(F.struct(
        "n_words", "item_start", "doc_id", "doc_start"), best).alias("best")).select(
        "item_id", "best.*")
