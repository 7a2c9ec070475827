"""Cost-balanced packing of tokenised documents into training sequences.

A document's tokens are cut into whole sequences and a tail. Tails are dealt into
groups of a fixed expected size, and each group is packed on its own: in descending
order every piece goes to the sequence with the least estimated attention cost that
still has room for it. A piece that fits nowhere is cut over the sequences with the
most room, so a group leaves at most one sequence part-filled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.llm.words import chunks, kept

GROUP_DOCUMENTS = 1500
PIECE_OCTETS = 4_000_000
REMEMBERED_CHUNKS = 1_000_000

_ODD = re.compile(r"\s\s|^\s|\s$|<\|")
# Letters behind a line end or none, and a few marks behind those: tokens of their own.
_WORD = re.compile(
    r"(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\-./:;<=>?@\[\]^_`{|}~]{0,3})\Z")


class ChunkTokenizer(dict):
    """Token ids of texts by a byte-level tokenizer file.

    The tokenizer never joins a word to what stands before the white space in
    front of it, so a text without two white spaces in a row is the concatenation
    of its chunks, each with the space or line end before it. Chunks are encoded
    once and remembered, up to a bound; any other text is encoded whole. Two white
    spaces in a row, or one at an end, show in a chunk: it is odd, and remembered as
    None. So is one that may hold a special token of the file, which a whole text is
    encoded with as it stands.

    Where the file splits texts as GPT-2 does, a space and the letters behind it reach
    the model as one piece, and so do the marks behind letters: a chunk of letters is
    given to the model itself, and marks and line ends add their own ids.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = "<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2"
        split = self.tokenizer.pre_tokenizer
        self.plain = self.tokenizer.normalizer is None and isinstance(split, ByteLevel) and (
            split.use_regex and not split.add_prefix_space) and all(
            t.content.startswith("<|") for t in self.tokenizer.get_added_tokens_decoder().values())
        letters = ByteLevel(add_prefix_space=False, use_regex=False)
        # Octets as the model has them, for the characters beyond ASCII of a word.
        self.octets = {c: letters.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.marks: dict[str, bytes] = {}  # of at most three, so never many

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in
                self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, text: str) -> bytes:
        if not text.isascii():
            text = text.translate(self.octets)
        return np.array([t.id for t in self.model.tokenize(text)], self.kind).tobytes()

    def _marks(self, text: str) -> bytes:
        if text not in self.marks:
            self.marks[text] = self._encode([text])[0]
        return self.marks[text]

    def __missing__(self, chunk: str) -> bytes | None:
        if len(self) > REMEMBERED_CHUNKS:
            self.clear()
        if self.plain and chunk.isascii() and chunk.isalpha():
            ids = self._letters("Ġ" + chunk)
        elif chunk in ("", "\n") or _ODD.search(chunk.removeprefix("\n")):
            ids = None
        elif self.plain and (parts := _WORD.match(chunk)):
            end, word, marks = parts.groups()
            if end:
                ids = self._marks(end) + self._letters(word)
            else:
                ids = self[word] if marks else self._letters("Ġ" + word)
            if marks:
                ids += self._marks(marks)
        else:
            ids = self._encode([chunk if chunk[0] == "\n" else " " + chunk])[0]
        self[chunk] = ids
        return ids

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        for text in texts:
            split = text.replace("\n", " \n").split(" ")
            found = list(map(self.__getitem__, split))
            if None in found:
                found = self._encode([text])
            else:
                found[0] = self._encode(split[:1])[0]
            yield np.frombuffer(b"".join(found), self.kind).astype("<u4")


def _pieces(path: str, capacity: int, end: int, groups: int):
    schema = pa.schema([
        ("group", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()),
        ("length", pa.int64()), ("doc_tokens", pa.int64()), ("crc", pa.int64()),
        ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # Kept by this process, so that a worker's next task finds its chunks again.
        tokenizer = kept(path, lambda: ChunkTokenizer(path))
        for batch in chunks(batches, "text", PIECE_OCTETS, keep=path):
            rows = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, row, ids in zip(batch.column("doc_id").to_pylist(),
                                     batch.column("row").to_pylist(), tokenizer.encode(texts)):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start:start + capacity]
                    full = len(part) == capacity
                    group = zlib.crc32(b"%d/%d" % (row, start)) % groups
                    rows.append((group, doc, start, len(part), len(ids),
                                 zlib.crc32(part.tobytes()),
                                 None if full else part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def deal(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[list]:
    """Pieces ``(item, from, length)`` of each sequence, for items of at most
    ``capacity`` tokens. The cost of a piece is ``linear * n + quadratic * n**2``."""
    count = -(-int(lengths.sum()) // capacity)
    cost, room = np.zeros(count), np.full(count, capacity)
    sequences: list[list] = [[] for _ in range(count)]

    def place(item: int, start: int, n: int, at: int) -> None:
        sequences[at].append((item, start, n))
        cost[at] += linear * n + quadratic * n * n
        room[at] -= n

    for item in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[item])
        while left:
            at = int(np.argmin(np.where(room >= left, cost, np.inf)))
            if room[at] < left:
                at = int(np.argmax(room))
            n = min(left, int(room[at]))
            place(int(item), start, n, at)
            start, left = start + n, left - n
    return sequences


def _pack(capacity: int, linear: float, quadratic: float):
    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by([
            ("doc_id", "ascending"), ("start", "ascending"), ("crc", "ascending")]).to_pylist()
        out, number = [], 0

        def add(row, start, length, crc, offset):
            out.append((row["doc_id"], row["start"] + start, length, crc, row["doc_tokens"],
                        (row["group"] << 32) + number, offset))

        for row in rows:
            if row["ids"] is None:
                add(row, 0, row["length"], row["crc"], 0)
                number += 1
        tails = [r for r in rows if r["ids"] is not None]
        for sequence in deal(np.array([r["length"] for r in tails], np.int64), capacity,
                             linear, quadratic):
            offset = 0
            for item, start, n in sequence:
                ids = tails[item]["ids"]
                add(tails[item], start, n, zlib.crc32(ids[4 * start:4 * (start + n)]), offset)
                offset += n
            number += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table({n: pa.array([r[i] for r in out], pa.int64())
                         for i, n in enumerate(names)})

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 0,
         linear: float = 1.0, quadratic: float = 1 / 4096) -> DataFrame:
    """Pieces of sequences: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.

    Every document is its token ids and then ``end``; each id lies in exactly one
    piece. Sequences hold at most ``capacity`` tokens; their pieces follow each
    other without gaps. The default cost weighs attention as a model four times as
    wide as the capacity does.

    Null and empty texts are the one token ``end``. Repeated rows, null ids and
    ties are documents of their own. Other columns are ignored; an empty table
    gives no piece.
    """
    groups = max(1, -(-docs.count() // GROUP_DOCUMENTS))
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    pieces = numbered.mapInArrow(
        _pieces(tokenizer, capacity, end, groups),
        "group long, doc_id long, start long, length long, doc_tokens long, crc long, ids binary")
    return pieces.groupBy("group").applyInArrow(
        _pack(capacity, linear, quadratic),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long")
