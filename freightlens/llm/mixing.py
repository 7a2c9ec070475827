"""Mixing sources to target weights, in blocks of words.

The words of a source, document after document, are cut into blocks of fixed length.
The mix is a row of output shards with the same number of slots. Every shard gives a
source the whole part of its expected slots and draws the rest multinomially, by a
hash of the shard alone. A source's slots are numbered through all shards; slot
``s`` takes block ``permutation(s mod blocks)``, so every block is taken once before
any is taken twice. Slots and blocks then meet in a join on the block's index.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightlens.llm.words import split_words, utf8_values
from freightlens.session import reliable_checkpoint

BLOCK_WORDS = 128
SHARD_SLOTS = 512
CHUNK_DOCUMENTS = 5000
MOST_EPOCHS = 2
WEIGHTS = (3, 1, 2)
SHARE = 1.5


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [len(split_words(t)) for t in utf8_values(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "source", "row", "id")),
             pa.array(sizes, pa.int64())], names=["doc_id", "source", "row", "id", "size"])


# A row is known by a hash, its id and, among equal rows, a number.
KEY = ["row", "id", "copy"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({
        "row": F.xxhash64("doc_id", "text"),
        "id": F.coalesce("doc_id", F.lit(-(2**63)))})


def _copies(rows: DataFrame) -> DataFrame:
    return rows.withColumn("copy", F.row_number().over(
        Window.partitionBy("row", "id").orderBy("source")))


def target_sizes(sizes: Mapping[str | None, int], share: float = SHARE,
                 weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> dict:
    """Target of each source: ``share`` of all sizes by weight, at most ``most``
    times a source's size, the excess shared again by weight until none is above.

    Sources are in code point order, null last, and take the weights in turn.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, targets = share * sum(sizes.values()), list(names), dict.fromkeys(names, 0.0)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        for s in full or open_:
            targets[s] = float(most * sizes[s]) if full else left * weight[s] / total
        if not full:
            break
        left -= sum(targets[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return targets


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of ``0 .. size - 1``, one for each key: four
    Feistel rounds over the next even number of bits, walked until inside."""
    bits = np.maximum(2, np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64))
    half = ((bits + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    left = np.ones(len(out), bool)
    while left.any():
        a, b = out[left] >> half[left], out[left] & mask[left]
        for turn in range(4):
            h = (b + key[left] + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            a, b = b, a ^ (h & mask[left])
        out[left] = (a << half[left]) | b
        left = out >= size.astype(np.uint64)
    return out.astype(np.int64)


def shard_counts(shards: np.ndarray, share: np.ndarray, slots: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard: the whole part of ``share * slots``, the
    rest drawn multinomially from the fractions, by the shard's own generator."""
    expected = share * slots
    whole = np.floor(expected + 1e-9).astype(np.int64)
    rest = np.maximum(expected - whole, 0)
    n = slots - int(whole.sum())
    out = np.tile(whole, (len(shards), 1))
    if n > 0:
        for i, shard in enumerate(shards):
            out[i] += np.random.Generator(np.random.Philox(key=[seed, int(shard)])).multinomial(
                n, rest / rest.sum())
    return out


def _shards(names: int, share: np.ndarray, slots: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = batch.column("id").to_numpy(zero_copy_only=False)
            counts = shard_counts(shards, share, slots, seed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(shards, names)),
                 pa.array(np.tile(np.arange(names), len(shards))),
                 pa.array(counts.ravel())], names=["shard", "source_no", "slots"])

    return run


def _slots(blocks: np.ndarray, keys: np.ndarray, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, number, shard, no = (
                batch.column(c).to_numpy(zero_copy_only=False)
                for c in ("first", "slots", "shard", "source_no"))
            row = np.repeat(np.arange(len(first)), number)
            place = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            slot, own = first[row] + place, no[row]
            ok = slot < most * blocks[own]
            slot, own, row = slot[ok], own[ok], row[ok]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[row]), pa.array(own),
                 pa.array(permuted(slot % blocks[own], blocks[own], keys[own])),
                 pa.array(slot // blocks[own])],
                names=["shard", "source_no", "block", "epoch"])

    return run


def _running(rows: DataFrame, group: str, chunk: str, order: list[str], value: str,
             name: str) -> DataFrame:
    """The sum of ``value`` over the earlier rows of the same ``group``, without
    bringing a group into one task: sums of chunks first, then inside each chunk."""
    totals = rows.groupBy(group, chunk).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        group, chunk, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    inner = Window.partitionBy(group, chunk).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    return rows.withColumn("__inner", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(
        totals, [group, chunk]).withColumn(
        name, F.col("__inner") + F.col("__before")).drop("__inner", "__before", chunk)


class Mixture:
    """A drawn mix, as two DataFrames: ``sizes`` (``doc_id, source, size, source_size,
    target``) and ``slices`` (``start, length, epoch, shard``: words of a row that one
    slot takes). Both carry the columns ``KEY`` of their row."""

    def __init__(self, docs: DataFrame, share: float = SHARE, seed: int = 7,
                 block_words: int = BLOCK_WORDS) -> None:
        """Plan the mix of ``doc_id, source, text``; runs the counting jobs.

        Null and empty texts have no words and are never taken. A null source is a
        source of its own, after the others. Repeated rows and ids are documents of
        their own. Other columns are ignored. An empty table, or one without words,
        gives an empty mix.
        """
        spark = docs.sparkSession
        sizes = reliable_checkpoint(_copies(_keyed(
            docs.select("doc_id", "source", "text")).mapInArrow(
            _sizes, "doc_id long, source string, row long, id long, size long")))
        sources = sizes.groupBy("source").agg(
            F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        by_source = {r["source"]: r["size"] for r in sources}
        targets = target_sizes(by_source, share)
        names = list(targets)
        blocks = np.array([-(-by_source[s] // block_words) for s in names], np.int64)
        keys = np.array([xxhash.xxh3_64_intdigest(repr(s).encode(), seed) for s in names], np.uint64)
        numbers = spark.createDataFrame(
            [(s, s is None, i, by_source[s], targets[s]) for i, s in enumerate(names)],
            "source string, no_source boolean, source_no long, source_size long, target double")
        documents = sum(r["n"] for r in sources)
        joined = sizes.join(
            F.broadcast(numbers), sizes["source"].eqNullSafe(numbers["source"]), "left").select(
            sizes["doc_id"], sizes["source"], *KEY, "size", "source_no", "source_size", "target")
        self.sizes = joined.drop("source_no")
        chunks = max(1, -(-documents // CHUNK_DOCUMENTS))
        placed = _running(
            joined.where("size > 0").withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks))),
            "source_no", "chunk", KEY, "size", "first")
        length = F.lit(block_words)
        parts = placed.select(
            "source_no", *KEY, "size", "first",
            F.explode(F.sequence(
                F.floor(F.col("first") / length),
                F.floor((F.col("first") + F.col("size") - 1) / length))).alias("block"))
        start = F.greatest(F.col("block") * length - F.col("first"), F.lit(0))
        end = F.least((F.col("block") + 1) * length - F.col("first"), F.col("size"))
        parts = parts.select("source_no", *KEY, "block", start.alias("start"),
                             (end - start).alias("length"))
        total = sum(targets.values())
        goal = np.array([targets[s] for s in names])
        slots = int(round(total / block_words))
        shards = -(-slots // SHARD_SLOTS)
        if not total or not slots:
            self.slices = parts.select(*KEY, "start", "length", F.lit(0).cast("long").alias(
                "epoch"), F.lit(0).cast("long").alias("shard")).where("false")
            return
        drawn = reliable_checkpoint(spark.range(shards).mapInArrow(
            _shards(len(names), goal / total, -(-slots // shards), seed),
            "shard long, source_no long, slots long").withColumn(
            "chunk", F.floor(F.col("shard") / CHUNK_DOCUMENTS)))
        numbered_slots = _running(drawn, "source_no", "chunk", ["shard"], "slots", "first")
        taken = numbered_slots.mapInArrow(
            _slots(blocks, keys, MOST_EPOCHS),
            "shard long, source_no long, block long, epoch long")
        # A few shards draw very many slots, which the optimizer does not see: without the
        # hint it would broadcast them all.
        self.slices = parts.join(taken.hint("merge"), ["source_no", "block"]).select(
            *KEY, "start", "length", "epoch", "shard")


def taken_words(docs: DataFrame, share: float = SHARE, seed: int = 7) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of ``docs``."""
    mix = Mixture(docs, share, seed)
    taken = mix.slices.groupBy(*KEY).agg(F.sum("length").alias("taken"))
    return mix.sizes.join(taken, KEY, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, slices in zip(utf8_values(batch.column("text")),
                                batch.column("slices").to_pylist()):
            words = split_words(text)
            texts.append(b" ".join(
                w for s in slices for w in words[s["start"]:s["start"] + s["length"]]).decode())
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts, pa.string()) if n == "text" else batch.column(n)
             for n in batch.schema.names if n != "slices"],
            names=[n for n in batch.schema.names if n != "slices"])


def mixed_documents(docs: DataFrame, share: float = SHARE, seed: int = 7) -> DataFrame:
    """The mix as documents: for each input row and each time round, one row with
    the words that were taken of it, in their order. Columns are those of ``docs``."""
    mix = Mixture(docs, share, seed)
    chosen = mix.slices.groupBy(*KEY, "epoch").agg(
        F.sort_array(F.collect_list(F.struct("start", "length"))).alias("slices"))
    rows = _copies(_keyed(docs.select(F.struct("*").alias("doc"), "doc_id", "text", "source")))
    rows = rows.join(chosen, KEY).select("doc.*", "slices")
    return rows.mapInArrow(_assemble, docs.schema)
