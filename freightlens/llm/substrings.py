"""Substring deduplication: passages that an earlier document already has.

Every window of ``width`` consecutive words gets a Rabin-Karp hash. A task
combines the windows of its own documents, so that it sends one row per distinct
window with the smallest document that has it; what a smaller document of the same
task already has is settled there. The buckets of the hash space then find the
smallest document of each window over the whole corpus. A passage shared by any
number of documents therefore sends as many rows as there are task pieces, never
as many as there are documents.

A window is known by 64 bits and by its bucket, which a second hash picks; the
number of buckets follows the corpus, so the chance of two different windows
meeting does not grow with the square of the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.llm.words import (
    BASES, RollingHash, WordHashes, chunks, inside, narrow, owners, split_words, utf8_values, widened,
)

PIECE_OCTETS = 4_000_000
BLOCK_OCTETS = 12_000_000
BUCKET_WINDOWS = 400_000
OCTETS_PER_WORD = 6
OWN_BLOCK = "own_block"


class WindowHashes:
    """Both hashes of every window of some documents, and the document of each."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.words = WordHashes()
        self.first, self.second = (RollingHash(b) for b in BASES)

    def of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tokens = np.concatenate([self.words.of(w) for w in texts] or [np.empty(0, np.uint64)])
        owner = owners([len(w) for w in texts])
        whole = inside(owner, self.width)
        return (self.first.windows(tokens, self.width)[whole],
                self.second.windows(tokens, self.width)[whole],
                owner[: len(whole)][whole])

    def one(self, words: list[bytes]) -> np.ndarray:
        return self.first.windows(self.words.of(words), self.width)


def _claims(width: int, buckets: int):
    """Rows of a bucket: either window hashes with their smallest document here
    (``step`` > 0), or hashes already settled for document ``doc`` (``step`` 0)."""

    schema = pa.schema([
        ("bucket", pa.int64()), ("hashes", pa.binary()), ("doc", pa.int64()),
        ("steps", pa.binary()), ("step", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = WindowHashes(width)
        for batch in chunks(batches, "text", PIECE_OCTETS):
            ids = np.array(batch.column("doc_id").to_pylist(), np.int64)
            order = np.argsort(ids, kind="stable")
            texts = utf8_values(batch.column("text"))
            hashes, second, owner = hashing.of([split_words(texts[i]) for i in order])
            if not len(hashes):
                continue
            docs = ids[order][owner]
            bucket = (second % np.uint64(buckets)).astype(np.int64)
            by_hash = np.argsort(hashes, kind="stable")
            h, d, b = hashes[by_hash], docs[by_hash], bucket[by_hash]
            opens = np.append(True, (h[1:] != h[:-1]) | (b[1:] != b[:-1]))
            once = opens | np.append(True, d[1:] != d[:-1])
            smallest = d[np.maximum.accumulate(np.where(opens, np.arange(len(h)), 0))]
            rows = []
            sent = np.sort(by_hash[opens])
            sent = sent[np.argsort(bucket[sent], kind="stable")]
            cuts = np.flatnonzero(np.diff(bucket[sent], prepend=-1))
            for start, end in zip(cuts, [*cuts[1:], len(sent)]):
                part = sent[start:end]
                steps, step = narrow(np.diff(docs[part], prepend=docs[part[0]]))
                rows.append((int(bucket[part[0]]), hashes[part].tobytes(), int(docs[part[0]]),
                             steps, step))
            settled = once & (d > smallest)
            for doc, part in _by_document(d[settled], h[settled]):
                rows.append((doc % buckets, part, doc, b"", 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _by_document(docs: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(docs, kind="stable")
    docs, hashes = docs[order], hashes[order]
    cuts = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else []
    for start, end in zip(cuts, [*cuts[1:], len(docs)]):
        yield int(docs[start]), hashes[start:end].tobytes()


def _block(doc_id: int, blocks: int) -> int:
    return zlib.crc32(b"%d" % doc_id) % blocks


def _settle(blocks: int):
    """The windows of one bucket that a smaller document has, packed by block of
    documents: ``docs`` and ``hashes`` side by side."""

    def run(group: pa.Table) -> pa.Table:
        docs, hashes = _settled(group)
        values, inverse = np.unique(docs, return_inverse=True)
        block = np.array([_block(int(d), blocks) for d in values], np.int64)[inverse]
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
        parts = [order[a:b] for a, b in zip(cuts, [*cuts[1:], len(order)])]
        return pa.table({
            "block": pa.array([int(block[p[0]]) for p in parts], pa.int64()),
            "docs": pa.array([docs[p].tobytes() for p in parts], pa.binary()),
            "hashes": pa.array([hashes[p].tobytes() for p in parts], pa.binary())})

    return run


def _settled(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    done_docs, done, hashes, docs = [], [], [], []
    for row in group.select(["hashes", "doc", "steps", "step"]).to_pylist():
        if row["step"]:
            hashes.append(np.frombuffer(row["hashes"], np.uint64))
            docs.append(row["doc"] + np.cumsum(widened(row["steps"], row["step"])))
        else:
            part = np.frombuffer(row["hashes"], np.uint64)
            done_docs.append(np.full(len(part), row["doc"], np.int64))
            done.append(part)
    if hashes:
        h, d = np.concatenate(hashes), np.concatenate(docs)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        opens = np.append(True, h[1:] != h[:-1])
        smallest = d[np.maximum.accumulate(np.where(opens, np.arange(len(h)), 0))]
        later = d > smallest
        done_docs.append(d[later])
        done.append(h[later])
    return np.concatenate(done_docs), np.concatenate(done)


def repeated_windows(docs: DataFrame, width: int, octets: int, blocks: int) -> DataFrame:
    """``block, docs, hashes``: the hash of every window of a document that a document
    with a smaller ``doc_id`` has too, as packed 64-bit integers, by block of documents
    (``blocks`` of them, by crc32 of the id's text)."""
    known = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    buckets = max(1, round(octets / OCTETS_PER_WORD / BUCKET_WINDOWS))
    claims = known.mapInArrow(
        _claims(width, buckets), "bucket long, hashes binary, doc long, steps binary, step int")
    return claims.groupBy("bucket").applyInArrow(
        _settle(blocks), "block long, docs binary, hashes binary")


def _kept(batches: Iterator[pa.RecordBatch], gone: pa.Table, width: int,
          hashing: WindowHashes) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Rows in pieces, and for each row: id, words, kept words and removed intervals."""
    owner = np.frombuffer(b"".join(gone.column("docs").to_pylist()), np.int64)
    hashes = np.frombuffer(b"".join(gone.column("hashes").to_pylist()), np.uint64)
    order = np.argsort(owner, kind="stable")
    owner, hashes = owner[order], hashes[order]
    for batch in chunks(batches, "text", PIECE_OCTETS):
        rows = []
        for doc, text in zip(
                batch.column("doc_id").to_pylist(), utf8_values(batch.column("text"))):
            words, spans = split_words(text), []
            kept = words
            first, last = (0, 0) if doc is None else (
                np.searchsorted(owner, doc, side) for side in ("left", "right"))
            if first < last:
                repeated = np.isin(hashing.one(words), hashes[first:last])
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.flatnonzero(repeated)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + width, -1)
                covered = np.append(np.cumsum(edge)[:-1] > 0, False)
                turns = np.flatnonzero(np.diff(covered, prepend=False))
                spans = [{"start": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)]
                kept = [w for w, gone in zip(words, covered) if not gone]
            rows.append((doc, words, kept, spans))
        yield batch, rows


def _cut(width: int):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    hashing = WindowHashes(width)

    def run(docs: pa.Table, gone: pa.Table) -> pa.Table:
        tables = []
        for _, rows in _kept(docs.to_batches(), gone, width, hashing):
            cut = [(doc, b" ".join(kept).decode(), len(words), len(words) - len(kept), spans)
                   for doc, words, kept, spans in rows]
            tables.append(pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*cut), schema.types)], schema=schema))
        return pa.Table.from_batches(tables, schema)

    return run


def _cut_rows(width: int, names: list[str]):
    hashing = WindowHashes(width)

    def run(docs: pa.Table, gone: pa.Table) -> pa.Table:
        docs = docs.select(names)
        tables, text = [], names.index("text")
        for batch, rows in _kept(docs.to_batches(), gone, width, hashing):
            texts = [b" ".join(kept).decode() if len(kept) < len(words) else old
                     for old, (_, words, kept, _) in zip(batch.column(text).to_pylist(), rows)]
            columns = batch.columns
            columns[text] = pa.array(texts, docs.schema.field(text).type)
            tables.append(pa.RecordBatch.from_arrays(columns, schema=docs.schema))
        return pa.Table.from_batches(tables, docs.schema)

    return run


def _cogrouped(docs: DataFrame, width: int):
    """The rows by block of documents, next to the windows that go from each block."""
    octets = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, round(octets / BLOCK_OCTETS))
    # Rows without an id have no block of their own and are spread by their text.
    block = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))) % blocks
    gone = repeated_windows(docs, width, octets, blocks)
    return docs.withColumn(OWN_BLOCK, block).groupBy(OWN_BLOCK).cogroup(gone.groupBy("block"))


def cut_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """The rows of ``docs``, with all columns: ``text`` is as ``remove_repeats`` leaves
    it where words are removed, and stays as it is, white space included, elsewhere."""
    # Other columns may have any name; the one of the block is not theirs.
    names = ["doc_id" if c == "doc_id" else "text" if c == "text" else f"c{i}"
             for i, c in enumerate(docs.columns)]
    named = docs.toDF(*names)
    cut = _cogrouped(named, width).applyInArrow(_cut_rows(width, names), named.schema)
    return cut.toDF(*docs.columns)


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """Documents without the passages that a document with a smaller id has.

    Returns ``doc_id, text, n_words, n_removed, spans`` for every row: the kept
    words joined by one space, and the maximal removed word intervals (from
    ``start``, up to but without ``end``).

    Null or empty texts have no words and come back empty. Rows with a null
    ``doc_id`` are neither larger nor smaller than others: they lose nothing and
    cause no loss. Rows that share a ``doc_id`` are one document to each other.
    Other columns are ignored; an empty table gives an empty result.
    """
    return _cogrouped(docs.select("doc_id", "text"), width).applyInArrow(
        _cut(width), "doc_id long, text string, n_words long, n_removed long, "
        "spans array<struct<start:long,end:long>>")
