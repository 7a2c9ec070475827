"""Language-model scores of documents by a weighted backoff automaton.

States are the contexts seen in training (the empty one included). A state has an
arc, with a log-probability, for every token that followed it, and a failure arc to
the next shorter context, with the weight of backing off. Smoothing is Dirichlet's:
``p(w|h) = (c(hw) + m * p(w|h')) / (c(h) + m)``, over add-one single tokens; ``m`` is
the strength under which all training tokens, each left out of the counts in its
turn, are likeliest.

Counts grow with the corpus, so no task ever holds the whole automaton. The rows of
a partition are gathered into batches of bounded size, stored as one compressed row
each. A batch sends one row of hashed n-grams per bucket of the hash space, with its
own counts of training; a bucket adds them up and answers every batch with the
totals of just the n-grams it asked for. From the answers the batch builds the part
of the automaton that its texts can reach, and walks through them once.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.llm.words import (
    BASES, WordHashes, chunks, mixed, narrow, split_words, utf8_values, widened,
)
from freightlens.session import reliable_checkpoint

BATCH_OCTETS = 5_000_000
BUCKET_OCTETS = 8_000_000
STRENGTHS = (3.0, 10.0, 30.0, 100.0, 300.0, 1000.0)
SINGLE, LONGER = 1, 2
# Hashes of the two marks; a word has no white space, so no word is either.
_START, _END = b" start", b" end"


@dataclass
class Grams:
    """The n-grams that end at each place of a batch, by order.

    Every document is a start mark, its words and an end mark. ``ids[k]`` numbers
    the distinct n-grams of order ``k + 1`` (-1: would begin before the mark).
    """

    owner: np.ndarray
    ids: list[np.ndarray]
    hashes: list[np.ndarray]
    is_start: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes | None], order: int) -> Grams:
        hashing = WordHashes(limit=1 << 62)
        lists = []
        for text in texts:  # bytes.lower changes A-Z only
            lists.append([_START, *split_words((text or b"").lower()), _END])
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        flat = hashing.of([w for x in lists for w in x])
        del lists
        is_start = flat == np.uint64(hashing[_START])
        place = np.arange(len(flat)) - np.flatnonzero(is_start)[owner] if len(flat) else flat
        ids, hashes, key = [], [], mixed(flat)
        for k in range(order):
            if k:
                key = np.append(key[:1], mixed(key[:-1] * np.uint64(BASES[0]) + flat[1:]))
            known = place >= k
            values, inverse = np.unique(key[known], return_inverse=True)
            numbers = np.full(len(flat), -1)
            numbers[known] = inverse
            ids.append(numbers)
            hashes.append(values)
        return cls(owner, ids, hashes, is_start)


def _bucketed(values: np.ndarray, buckets: int):
    """Index arrays of the values of each bucket, a range of values, in their order."""
    order = np.argsort(values, kind="stable")
    span = np.uint64(min(2**64 // buckets + 1, 2**64 - 1))
    bucket = np.minimum(values[order] // span, np.uint64(buckets - 1)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for start, end in zip(cuts, [*cuts[1:], len(order)]):
        yield int(bucket[start]), order[start:end]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size, a batch as one compressed row. Texts that are
    pressed together take less room than each on its own."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    number = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=options) as writer:
            writer.write_table(pa.Table.from_batches(held).combine_chunks())
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()])],
            names=["batch", "rows"])

    octets = 0
    for piece in chunks(batches, "text", BATCH_OCTETS // 8):
        held.append(piece)
        octets += sum(len(t) for t in utf8_values(piece.column("text"))) + 64 * piece.num_rows
        if octets >= BATCH_OCTETS:
            yield flush()
            number, octets, held = number + 1, 0, []
    if held:
        yield flush()


def _rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _texts(rows: pa.Table) -> list[bytes]:
    return utf8_values(rows.column("text"))


def _planes(values: np.ndarray) -> bytes:
    """Sorted 64-bit integers as steps, octet by octet: the high octets of all steps
    come together and are mostly 0, which the shuffle's own compression takes out."""
    steps = np.diff(values, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def _kinds(grams: Grams):
    """What is asked for: single tokens without the start mark, and the rest."""
    start = np.zeros(len(grams.hashes[0]), bool)
    start[grams.ids[0][grams.is_start]] = True
    yield SINGLE, [(0, np.flatnonzero(~start))]
    yield LONGER, [(0, np.flatnonzero(start))] + [
        (k, np.arange(len(h))) for k, h in enumerate(grams.hashes) if k]


def _ask(order: int, buckets: int):
    def asked(batch: int, rows: pa.Table) -> pa.RecordBatch:
        grams = Grams.of(_texts(rows), order)
        trained = ~np.array(rows.column("held_out").to_pylist(), bool)[grams.owner]
        counts = [np.bincount(n[trained & (n >= 0)], minlength=len(h))
                  for n, h in zip(grams.ids, grams.hashes)]
        out = []
        for kind, parts in _kinds(grams):
            values = np.concatenate([grams.hashes[k][i] for k, i in parts])
            own = np.concatenate([counts[k][i] for k, i in parts])
            for bucket, at in _bucketed(values, buckets):
                data, width = narrow(own[at])
                out.append((bucket, batch, kind, _planes(values[at]), data, width))
        columns = list(zip(*out)) or [()] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for (_, t), c in zip(_ASKED, columns)], names=[n for n, _ in _ASKED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield asked(batch.column("batch")[row].as_py(),
                            _rows(batch.column("rows")[row].as_py()))

    return run


_ASKED = [("bucket", pa.int64()), ("batch", pa.int64()), ("kind", pa.int32()),
          ("hashes", pa.binary()), ("counts", pa.binary()), ("width", pa.int32())]
_ASKED_SQL = "bucket long, batch long, kind int, hashes binary, counts binary, width int"


def _answer(group: pa.Table) -> pa.Table:
    """Totals over all batches, sent back in the order each batch asked in."""
    rows = sorted(group.to_pylist(), key=lambda r: (r["batch"], r["kind"]))
    out = []
    for kind in (SINGLE, LONGER):
        asked = [r for r in rows if r["kind"] == kind]
        if not asked:
            continue
        hashes = [_unplaned(r["hashes"]) for r in asked]
        values, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        own = np.concatenate([widened(r["counts"], r["width"]) for r in asked])
        totals = np.zeros(len(values), np.int64)
        np.add.at(totals, inverse, own)
        ends = np.cumsum([len(h) for h in hashes])
        for i, (row, end) in enumerate(zip(asked, ends)):
            data, width = narrow(totals[inverse[end - len(hashes[i]):end]])
            first = kind == SINGLE and i == 0
            out.append((row["batch"], row["bucket"], kind, data, width,
                        int((totals > 0).sum()) if first else 0, int(totals.sum()) if first else 0))
    names = [("batch", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()),
             ("counts", pa.binary()), ("width", pa.int32()), ("types", pa.int64()),
             ("tokens", pa.int64())]
    columns = list(zip(*out)) or [()] * len(names)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(names, columns)})


@dataclass
class Automaton:
    """The part of the automaton that a batch can reach.

    N-grams have one number over all orders, their place in ``counts``. State 0 is the
    empty context and state ``1 + n`` the n-gram ``n``. ``arcs`` finds the n-gram that
    a state and a token make, if training has it; from the empty state a token's arc is
    its own number. ``target`` is the state that an n-gram leads to, ``back`` where the
    failure arc of a state ends. ``context`` and ``suffix`` are the n-grams without
    their last and first token, for orders above one.
    """

    sizes: list[int]
    counts: np.ndarray
    context: np.ndarray
    suffix: np.ndarray
    arcs: dict[int, int]
    target: array
    back: array
    base: np.ndarray

    @classmethod
    def of(cls, grams: Grams, counts: list[np.ndarray], tokens: int, types: int) -> Automaton:
        sizes = [len(c) for c in counts]
        offsets = np.cumsum([0, *sizes])
        flat = np.concatenate(counts)
        context, suffix = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        arcs: dict[int, int] = {}
        target = np.where(flat > 0, np.arange(len(flat)) + 1, 0)
        back = np.zeros(len(flat) + 1, np.int64)
        for k in range(1, len(counts)):
            # An n-gram's context ends one place before it, its suffix at the same place.
            at = np.zeros(sizes[k], np.int64)
            here = np.flatnonzero(grams.ids[k] >= 0)
            at[grams.ids[k][here]] = here
            own = slice(offsets[k], offsets[k + 1])
            context[own] = offsets[k - 1] + grams.ids[k - 1][at - 1]
            suffix[own] = offsets[k - 1] + grams.ids[k - 1][at]
            back[1 + offsets[k]:1 + offsets[k + 1]] = 1 + suffix[own]
            # In the order of the text, so that a walk finds neighbours close together.
            seen = np.flatnonzero(counts[k] > 0)
            seen = seen[np.argsort(at[seen])]
            keys = (1 + context[own][seen]) * sizes[0] + grams.ids[0][at[seen]]
            arcs.update(zip(keys.tolist(), (offsets[k] + seen).tolist()))
        # The longest n-grams are no states: they lead to their suffix.
        last = slice(offsets[-2], offsets[-1])
        target[last] = 1 + suffix[last] if len(counts) > 1 else 0
        return cls(sizes, flat, context, suffix, arcs, array("q", target.tobytes()),
                   array("q", back.tobytes()),
                   (flat[:sizes[0]] + 1) / (tokens + types + 1))

    def walk(self, grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One traversal from left to right that carries the state: the n-gram of the
        arc taken at each token, and token and state of every failure arc on the way."""
        taken, failed, states = [], [], []
        find, target, back, width, state = self.arcs.get, self.target, self.back, self.sizes[0], 0
        for token, start in zip(grams.ids[0].tolist(), grams.is_start.tolist()):
            if start:
                state = target[token]
                continue
            arc = token
            while state:
                found = find(state * width + token)
                if found is not None:
                    arc = found
                    break
                failed.append(len(taken))
                states.append(state)
                state = back[state]
            taken.append(arc)
            state = target[arc]
        return tuple(np.array(x, np.int64) for x in (taken, failed, states))

    def _smoothed(self, left_out: int, base: np.ndarray, strength: float) -> np.ndarray:
        """Probability of every n-gram's last token, ``left_out`` occurrences less."""
        p = np.concatenate([base, np.zeros(len(self.counts) - len(base))])
        counts, at = np.maximum(self.counts - left_out, 0), self.sizes[0]
        for size in self.sizes[1:]:
            own = slice(at, at + size)
            p[own] = (counts[own] + strength * p[self.suffix[own]]) / (
                counts[self.context[own]] + strength)
            at += size
        return p

    def scores(self, path: tuple[np.ndarray, np.ndarray, np.ndarray], owner: np.ndarray, n: int,
               strength: float) -> np.ndarray:
        """Log10-probability of each of ``n`` texts: the arcs and failure arcs of a walk.
        ``owner`` is the text of every token."""
        taken, failed, states = path
        arc = np.log10(self._smoothed(0, self.base, strength))
        failing = np.log10(strength / (self.counts + strength))
        return np.bincount(owner, weights=arc[taken], minlength=n) + np.bincount(
            owner[failed], weights=failing[states - 1], minlength=n)

    def left_out(self, weight: np.ndarray, total: int, strength: float) -> float:
        """Log10-probability of the training tokens of a batch under counts that leave
        each one's own occurrence out. ``weight`` counts, for every n-gram, the tokens
        that it is the longest n-gram of."""
        used = np.flatnonzero(weight)
        p = self._smoothed(1, self.counts[:self.sizes[0]] / max(total, 1), strength)
        return float(weight[used] @ np.log10(p[used]))


_SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
           "base_score double, scores array<double>, left_out array<double>")


def _score(order: int, tokens: int, types: int, strengths: Sequence[float]):
    def run(batch: pa.Table, answers: pa.Table) -> pa.Table:
        if not batch.num_rows:
            return pa.table({n: [] for n in _SCORED_NAMES})
        rows = _rows(batch.column("rows")[0].as_py())
        n = rows.num_rows
        grams = Grams.of(_texts(rows), order)
        replies = {(r["bucket"], r["kind"]): widened(r["counts"], r["width"])
                   for r in answers.select(["bucket", "kind", "counts", "width"]).to_pylist()}
        buckets = answers.column("buckets")[0].as_py()
        counts = [np.zeros(len(h), np.int64) for h in grams.hashes]
        for kind, parts in _kinds(grams):
            values = np.concatenate([grams.hashes[k][i] for k, i in parts])
            found = np.zeros(len(values), np.int64)
            for bucket, at in _bucketed(values, buckets):
                found[at] = replies[bucket, kind]
            for k, i in parts:
                counts[k][i], found = found[:len(i)], found[len(i):]
        automaton = Automaton.of(grams, counts, tokens, types)
        path = automaton.walk(grams)
        places = np.flatnonzero(~grams.is_start)
        single = counts[0][grams.ids[0][places]]
        ends = np.searchsorted(grams.owner[places], np.arange(1, n))

        owner = grams.owner[places]
        learned = ~np.array(rows.column("held_out").to_pylist(), bool)
        longest, at = grams.ids[0].copy(), 0
        for ids in grams.ids:
            longest[ids >= 0] = at + ids[ids >= 0]
            at += int(ids.max(initial=-1)) + 1
        weight = np.bincount(longest[places[learned[owner]]], minlength=len(automaton.counts))
        spared = [automaton.left_out(weight, tokens + types, m) for m in strengths]
        columns = (
            rows.column("doc_id"), rows.column("held_out"),
            np.bincount(grams.owner[places], minlength=n).astype(np.int64),
            np.bincount(grams.owner[places][single > 0], minlength=n).astype(np.int64),
            np.full(n, tokens, np.int64),
            [math.fsum(x) for x in np.split(
                np.log10(automaton.base[grams.ids[0][places]]), ends)],
            list(np.stack([automaton.scores(path, owner, n, m) for m in strengths], axis=1)),
            [spared] + [None] * (n - 1))  # of the whole batch, with its first text
        return pa.table(dict(zip(_SCORED_NAMES, columns)))

    return run


_SCORED_NAMES = [c.split()[0] for c in _SCORED.split(", ")]


def score_documents(docs: DataFrame, held_out: Column, order: int = 2,
                    strength: float | Sequence[float] = STRENGTHS) -> DataFrame:
    """Log10 probabilities of whole texts under an n-gram model of the rows for
    which ``held_out`` is not true.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``: tokens are the words with A-Z lower-cased and one end per text;
    ``base_score`` is the add-one model of single tokens, ``score`` the automaton.
    Of several strengths the one that suits the training rows best is taken.

    Null and empty texts are the end alone. Repeated rows count as often as they
    are there. A null ``held_out`` counts as false. Without rows to learn from,
    all tokens are unknown. Other columns are ignored; an empty table gives an
    empty result. A text longer than a batch is a batch of its own.
    """
    strengths = list(strength) if isinstance(strength, Sequence) else [strength]
    octets = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-octets // BUCKET_OCTETS))
    gathered = reliable_checkpoint(docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    ).mapInArrow(_gathered, "batch long, rows binary"))
    asked = gathered.mapInArrow(_ask(order, buckets), _ASKED_SQL)
    answers = reliable_checkpoint(asked.groupBy("bucket").applyInArrow(
        _answer, "batch long, bucket long, kind int, counts binary, width int, types long, "
        "tokens long"))
    types, tokens = answers.agg(F.sum("types"), F.sum("tokens")).first()
    scored = gathered.groupBy("batch").cogroup(
        answers.withColumn("buckets", F.lit(buckets)).groupBy("batch")
    ).applyInArrow(_score(order, tokens or 0, types or 0, strengths), _SCORED)
    best = 0
    if len(strengths) > 1:
        scored = reliable_checkpoint(scored)
        sums = scored.agg(*[F.sum(F.get("left_out", F.lit(i))).alias(f"m{i}")
                            for i in range(len(strengths))]).first()
        best = max(range(len(strengths)), key=lambda i: sums[i] if sums[i] is not None else 0.0)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
        F.get("scores", F.lit(best)).alias("score"))
