"""Spelling variants by composition of finite-state machines.

The vocabulary is a minimal acyclic acceptor. Composed with a transducer that makes
exactly one edit, and with the acceptor again, it accepts the pairs of words that are
one edit apart. A state of the composition holds a state of either acceptor and the
number of edits made. Before the edit both acceptors have read the same prefix and
stand in one state; behind it they read the same letters.

The composition is cut into partitions by the state they start from:

- from a prefix, before the edit: all pairs of words that begin with it;
- from a prefix, just at the edit: the pairs whose first difference stands right
  behind it. They have one rest in common, so blocks of rests, by hash, are
  partitions of their own.

A prefix whose words would not fit one task is cut into its longer prefixes and the
blocks of the edit behind it. Every pair is accepted by exactly one partition, and
each word takes part in two partitions more for every prefix that is cut.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.llm.words import chunks, utf8_values
from freightlens.session import reliable_checkpoint

# Letters of a run (A-Z are lowered before), and the share of planted slips.
LETTERS = "a-zÀ-ÿ"
SLIPS = 199

PIECE_OCTETS = 4_000_000
MOST_WORDS = 200_000  # counted in a task before they are sent on
PART_LETTERS = 60_000
STAY = "\0"  # not a letter; sorts before all


def slipped(run: str, start: int) -> str:
    """The run without one letter, for one of ``SLIPS`` hashes. ``start`` is the crc32
    of what stands before the run."""
    h = zlib.crc32(run.encode(), start)
    if h % SLIPS:
        return run
    gone = h % len(run)
    return run[:gone] + run[gone + 1:]


def _count(least: int, slip: bool):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
            schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Shorter runs can't make a word, and a slip only takes a letter away.
        runs, counts = re.compile(f"[{LETTERS}]{{{max(least, 1)},}}"), Counter()
        for batch in chunks(batches, "text", PIECE_OCTETS):
            for doc, text in zip(
                    batch.column("doc_id").to_pylist(), utf8_values(batch.column("text"))):
                # bytes.lower changes A-Z only.
                found = Counter(runs.findall(text.lower().decode()) if text else ())
                start = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
                for word, n in found.items():
                    if slip:
                        word = slipped(word, start)
                    if len(word) >= least:
                        counts[word] += n
                if len(counts) > MOST_WORDS:
                    yield table(counts)
                    counts = Counter()
        yield table(counts)

    return run


def vocabulary(docs: DataFrame, least_letters: int = 6, least_count: int = 5,
               slip: bool = False) -> DataFrame:
    """``word, n``: runs of letters in whole texts, A-Z lowered, with at least so many
    letters and occurrences. With ``slip``, one of ``SLIPS`` distinct runs of a
    document (by crc32 of ``<doc_id>:<run>``, a null id as empty) loses a letter."""
    counted = docs.select("doc_id", "text").mapInArrow(
        _count(least_letters, slip), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Acceptor:
    """The minimal acyclic acceptor of sorted distinct words.

    ``arcs[q]`` maps a letter to the next state, ``final[q]`` tells whether a word
    ends there and ``words[q]`` counts the words from there on, so that a path numbers
    its word: the words before an arc in order are those of smaller arcs, and the one
    that ends before them.
    """

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.words: list[int] = []
        self.lengths: list[int] = []
        self._known: dict[tuple, int] = {}
        path: list[tuple[bool, dict[str, int]]] = [(False, {})]
        last = ""
        for word in words:
            common = 0
            most = min(len(word), len(last))
            while common < most and word[common] == last[common]:
                common += 1
            self._close(path, last, common)
            path += [(False, {}) for _ in range(len(word) - common)]
            path[-1] = (True, path[-1][1])
            last = word
        self._close(path, last, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list, last: str, down_to: int) -> None:
        """The states of the last word's end can't change any more."""
        for at in range(len(last), down_to, -1):
            path[at - 1][1][last[at - 1]] = self._state(*path.pop())

    def _state(self, final: bool, arcs: dict[str, int]) -> int:
        key = (final, tuple(arcs.items()))
        if key not in self._known:
            self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
            self.words.append(final + sum(self.words[q] for q in arcs.values()))
            # Lengths of the words from here on, modulo 64, as bits.
            bits = int(final)
            for q in arcs.values():
                bits |= self.lengths[q] << 1 | self.lengths[q] >> 63
            self.lengths.append(bits & (1 << 64) - 1)
        return self._known[key]

    def steps(self, q: int) -> Iterator[tuple[str, int, int]]:
        """Letter, next state and the number of words before, of each arc."""
        before = int(self.final[q])
        for letter, to in self.arcs[q].items():
            yield letter, to, before
            before += self.words[to]


class Composition:
    """The acceptor, one edit, and the acceptor again."""

    def __init__(self, acceptor: Acceptor) -> None:
        self.a = acceptor
        self._steps = [dict((c, (to, n)) for c, to, n in acceptor.steps(q))
                       for q in range(len(acceptor.arcs))]

    def meets(self, p: int, q: int) -> list[tuple[int, int]]:
        """Words that both states accept, as pairs of their numbers from there on."""
        a, out, stack = self.a, [], [(p, q, 0, 0)]
        while stack:
            p, q, i, j = stack.pop()
            if p == q:
                out += [(i + k, j + k) for k in range(a.words[p])]
                continue
            if a.final[p] and a.final[q]:
                out.append((i, j))
            mine, others = self._steps[p], self._steps[q]
            if len(others) < len(mine):
                both = [(c, mine[c], to) for c, to in others.items() if c in mine]
            else:
                both = [(c, to, others[c]) for c, to in mine.items() if c in others]
            for _, (x, m), (y, n) in both:
                if a.lengths[x] & a.lengths[y]:
                    stack.append((x, y, i + m, j + n))
        return out

    def edits(self, changed: int, shorter: int | None) -> list[tuple[int, int]]:
        """Pairs whose first difference is an arc of ``changed``: two of its arcs are
        followed (a letter replaced), or one of them on one side and none on the other
        (a letter deleted), which goes on in ``shorter``. A deletion counts where the
        other word goes on with another letter, or ends; else the words differ later."""
        a, out = self.a, []
        steps = [s for s in a.steps(changed) if s[0] != STAY]
        for k, (_, p, m) in enumerate(steps):
            for _, q, n in steps[k + 1:]:
                if a.lengths[p] & a.lengths[q]:
                    out += [(m + i, n + j) for i, j in self.meets(p, q)]
        if shorter is None:
            return out
        for letter, p, m in steps:
            if a.final[p] and a.final[shorter]:
                out.append((m, 0))
            further = self._steps[p]
            for c, (q, n) in self._steps[shorter].items():
                if c != letter and c in further:
                    to, before = further[c]
                    if a.lengths[to] & a.lengths[q]:
                        out += [(m + before + i, n + j) for i, j in self.meets(to, q)]
        return out

    def pairs(self, starts: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """All pairs accepted from states before the edit (each with the number of its
        first word). The edits right behind a state are found once and hold for every
        prefix that leads there."""
        a, known, stack = self.a, {}, list(starts)
        while stack:
            q, first = stack.pop()
            if q not in known:
                known[q] = self.edits(q, q)
            for i, j in known[q]:
                yield first + i, first + j
            stack += [(to, first + n) for _, to, n in a.steps(q) if a.words[to] > 1]


def _behind(words: list[str], prefix: int, whole: bool) -> Iterator[tuple[str, str]]:
    """Pairs of a partition before the edit: of all its words, or of those that also
    have the letter behind the prefix in common."""
    words = sorted(words)
    machine = Composition(Acceptor([w[prefix:] for w in words]))
    start = machine.a.start
    starts = [(start, 0)] if whole else [(to, n) for _, to, n in machine.a.steps(start)]
    for i, j in machine.pairs(starts):
        yield words[i], words[j]


def _at_edit(words: list[str], stays: list[bool], prefix: int) -> Iterator[tuple[str, str]]:
    """Pairs of a partition at the edit: a word takes the letter behind the prefix, or
    stays before it while the other takes one."""
    entries = sorted((STAY * stay + w[prefix:], w) for w, stay in zip(words, stays))
    machine = Composition(Acceptor([text for text, _ in entries]))
    start = machine.a.start
    for i, j in machine.edits(start, machine.a.arcs[start].get(STAY)):
        yield entries[i][1], entries[j][1]


def _near(group: pa.Table) -> pa.Table:
    """For each word of a partition that has pairs there: their number, and the near
    word of the largest count."""
    words, counts, stays = (group.column(c).to_pylist() for c in ("word", "n", "stays"))
    prefix, block, whole = (group.column(c)[0].as_py() for c in ("prefix", "block", "whole"))
    n = dict(zip(words, counts))
    pairs = _at_edit(words, stays, len(prefix)) if block >= 0 else _behind(
        words, len(prefix), whole)
    number: Counter = Counter()
    best: dict[str, tuple[int, str]] = {}
    for x, y in pairs:
        for word, other in ((x, y), (y, x)):
            number[word] += 1
            here = (-n[other], other)
            if word not in best or here < best[word]:
                best[word] = here
    found = list(number)
    return pa.table({
        "word": pa.array(found, pa.string()),
        "n_near": pa.array([number[w] for w in found], pa.int64()),
        "near": pa.array([best[w][1] for w in found], pa.string()),
        "near_n": pa.array([-best[w][0] for w in found], pa.int64())})


def partitions(words: DataFrame, letters: int = PART_LETTERS) -> DataFrame:
    """``prefix, block, whole, stays, word, n``: the words of every partition, each of
    about ``letters`` letters. Blocks from 0 on are at the edit."""
    size, rest = F.length("word") + 1, lambda skip: F.substr("word", F.length("prefix") + skip)
    shape = ["prefix", "block", "whole", "stays", "word", "n"]
    at = lambda hashed, to: F.pmod(F.xxhash64(hashed), to)
    open_ = words.select(F.lit("").alias("upper"), F.lit(1).cast("long").alias("bins"),
                         F.lit("").alias("prefix"), "word", "n")
    out = None
    while True:
        sizes = open_.groupBy("prefix").agg(
            F.sum(size).alias("letters"), F.count("*").alias("words"),
            F.min("word").alias("low"), F.max("word").alias("high"))
        large = (F.col("letters") > letters) & (F.col("words") > 1)
        # A cut prefix goes on to where its first and last word part: so do all others.
        common = F.size(F.filter(F.sequence(F.lit(1), F.least(F.length("low"), F.length("high"))),
                                 lambda i: F.left("low", i) == F.left("high", i)))
        # Stored on its own, so that the join can split a prefix that most words share.
        sizes = reliable_checkpoint(sizes.select(
            "prefix", F.when(large, F.left("low", common)).alias("cut"),
            F.ceil(F.col("letters") / letters).alias("parts")))
        # The first prefix is a constant: a join on it would pair all partitions of both sides.
        open_ = reliable_checkpoint(open_.join(F.broadcast(sizes) if out is None else sizes, "prefix"))
        small = open_.where("cut is null").select(
            F.col("upper").alias("prefix"), (-1 - at("prefix", F.col("bins"))).alias("block"),
            (F.col("prefix") == "").alias("whole"), F.lit(False).alias("stays"), "word", "n")
        cut = open_.where("cut is not null").select(
            F.col("cut").alias("prefix"), "parts", "word", "n")
        taking = cut.where(F.length("word") > F.length("prefix")).select(
            "prefix", at(rest(2), 2 * F.col("parts")).alias("block"), F.lit(False).alias("whole"),
            F.lit(False).alias("stays"), "word", "n")
        staying = cut.select(
            "prefix", at(rest(1), 2 * F.col("parts")).alias("block"), F.lit(False).alias("whole"),
            F.lit(True).alias("stays"), "word", "n")
        parts = small.select(shape).unionByName(taking).unionByName(staying)
        out = parts if out is None else out.unionByName(parts)
        if cut.isEmpty():
            return out
        open_ = cut.where(F.length("word") > F.length("prefix")).select(
            F.col("prefix").alias("upper"), F.col("parts").alias("bins"),
            F.left("word", F.length("prefix") + 1).alias("prefix"), "word", "n")


def near_words(words: DataFrame, letters: int = PART_LETTERS) -> DataFrame:
    """``word, n_near, near, near_n`` for the words of ``word, n`` that have near words:
    how many, and the one of the largest ``n`` (ties: the smallest in code-point
    order). Near are words that differ by one letter inserted, deleted or replaced."""
    found = partitions(words, letters).groupBy("prefix", "block").applyInArrow(
        _near, "word string, n_near long, near string, near_n long")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")).select(
        "word", "n_near", F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n"))


def group_variants(docs: DataFrame, least_letters: int = 6, least_count: int = 5,
                   times: int = 5, slip: bool = False, letters: int = PART_LETTERS) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: the vocabulary of ``docs`` (see
    ``vocabulary``) with the spelling that each word is a variant of.

    ``form`` is the near word of the largest ``n`` (ties: the smallest in code-point
    order), if its ``n`` is at least ``times`` the word's; else null. ``root`` is where
    the forms lead in the end, the word itself if it has none. ``n_near`` counts all
    near words.

    Null or empty texts have no words. Null ids count as empty in the hash of a slip.
    Repeated rows count as often as they are there. Other columns are ignored; an empty
    table gives an empty result. A task holds the runs of one text, and the words of a
    partition: about ``letters`` letters, or one longer word with its neighbours.
    ``times`` must be over 1.
    """
    words = reliable_checkpoint(vocabulary(docs, least_letters, least_count, slip))
    close = F.col("near_n") >= times * F.col("n")
    formed = reliable_checkpoint(words.join(near_words(words, letters), "word", "left").select(
        "word", F.when(close, F.col("near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(close, F.col("near_n")).alias("form_n")))
    # Counts grow ``times``-fold from form to form, so their largest bounds the way.
    most = formed.agg(F.max("n")).first()[0] or 1
    roots, reached = formed.where("form is not null").select("word", F.col("form").alias("root")), 1
    while reached < math.log(most) / math.log(times):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = reliable_checkpoint(roots.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root")))
        reached *= 2
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
