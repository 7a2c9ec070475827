"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is a weighted set of word shingles. Every shingle throws darts at a
region of its weight, at hashed moments and hashed coordinates of the signature; a
document keeps the earliest dart of each coordinate. It looks only as far in time as
it takes to fill its ``k`` coordinates, about ``k ln k`` darts in all, however many
shingles it has. Two documents agree in a coordinate with the probability that is
their weighted Jaccard similarity.

Documents with the same shingles are one text. Texts that agree in a band meet in a
join on the band's hash with the bucket's first few texts; what joins the same class
is not compared again. Where a bucket still holds several classes, its texts are
compared in blocks, by signatures first and then by their sets, and a spanning forest
of the links leaves them: never more rows than texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightlens.llm.words import (
    BASES, RollingHash, WordHashes, chunks, mixed, row_key, split_words, utf8_values,
)
from freightlens.session import reliable_checkpoint

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 5
PIECE_OCTETS = 4_000_000
ROW_OCTETS = 4000  # darts of a document, as text
# Texts of a bucket that the rounds compare with, and how many for each text.
FIRST_ROUNDS = ((1, 1), (16, 4))
BLOCK_TEXTS, BLOCK_SHINGLES = 1500, 1_000_000


def shingles(words: list[bytes], hashing: WordHashes, rolling: RollingHash,
             width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and how often each occurs. A text of fewer
    words than a shingle is one shingle of all its words; no words give none."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    width = min(width, len(words))
    found = rolling.windows(hashing.of(words), width) + np.uint64(width)
    return np.unique(mixed(found), return_counts=True)


def darts(elements: np.ndarray, weights: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Signatures (documents x ``k``) of concatenated sets that begin at ``starts``.

    The region of an element is cut into strips of weight 1. Darts hit a strip at
    the moments of a Poisson process, so the moment of the next dart is the last
    one plus an exponential step drawn from the hash of element, strip and number;
    a dart above the element's weight misses. A document first looks up to
    ``(k ln k + 2k) / weight``; if a coordinate is still empty, twice as far.
    """
    n = len(starts)
    ends = np.append(starts[1:], len(elements))
    strips = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), strips)
    strip = np.arange(len(at)) - np.repeat(np.cumsum(strips) - strips, strips)
    owner = np.repeat(np.arange(n), ends - starts)[at]
    room = weights[at] - strip
    seed = mixed(elements[at] + np.uint64(BASES[1]) * strip.astype(np.uint64))
    mass = np.bincount(owner, weights=np.minimum(room, 1.0), minlength=n)
    until = (k * np.log(k) + 2 * k) / np.maximum(mass, 1e-9)
    first = np.full((n, k), np.inf)
    out = np.zeros((n, k), np.uint64)
    open_ = mass > 0
    whole = bool((room >= 1).all())
    while open_.any():
        live = open_[owner]
        s, o, r = seed[live], owner[live], room[live]
        when, found = np.zeros(len(s)), []
        number = 0
        while len(s):
            h = mixed(s + np.uint64(number))
            when = when - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
            inside = when <= until[o]
            s, o, when, h = s[inside], o[inside], when[inside], h[inside]
            low = mixed(h)
            place = o * k + ((low & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64)
            if whole:
                found.append((place, when, h))
            else:
                r = r[inside]
                hit = ((low >> np.uint64(32)).astype(np.float64) / 2.0**32) < r
                found.append((place[hit], when[hit], h[hit]))
            number = (number + BASES[0]) % 2**64
        place, when, h = (np.concatenate(c) for c in zip(*found))
        np.minimum.at(first.reshape(-1), place, when)
        earliest = when == first.reshape(-1)[place]
        out.reshape(-1)[place[earliest]] = h[earliest]
        open_ &= np.isinf(first).any(axis=1)
        until = until * 2
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signatures), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    parts = signatures.reshape(len(signatures), bands, rows)
    for i in range(rows):
        keys = mixed(keys * np.uint64(BASES[0]) + parts[:, :, i])
    return keys.astype(np.int64)


def _sign(width: int, bands: int, rows: int, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashing, rolling = WordHashes(), RollingHash(BASES[0])
        for batch in chunks(batches, "text", PIECE_OCTETS, ROW_OCTETS):
            sets = [shingles(split_words(t), hashing, rolling, width)
                    for t in utf8_values(batch.column("text"))]
            sizes = np.array([len(s) for s, _ in sets])
            full = np.flatnonzero(sizes)
            keys: list = [None] * len(sets)
            marks: list = [None] * len(sets)
            if len(full):
                weights = np.concatenate([sets[i][1] for i in full]).astype(float)
                signed = darts(
                    np.concatenate([sets[i][0] for i in full]),
                    weights if counted else np.ones(len(weights)),
                    np.cumsum(sizes[full]) - sizes[full], bands * rows)
                short = signed.astype(np.uint8)
                for i, row, octets in zip(full, band_keys(signed, bands, rows), short):
                    keys[i], marks[i] = row, octets.tobytes()
            texts = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s, _ in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("own"), pa.array(texts, pa.binary()),
                 pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(marks, pa.binary())],
                names=["doc_id", "own", "text_key", "n", "bands", "marks"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashing, rolling = WordHashes(), RollingHash(BASES[0])
        for batch in chunks(batches, "text", PIECE_OCTETS):
            found = [shingles(split_words(t), hashing, rolling, width)[0]
                     for t in utf8_values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()),
                 pa.array([s.astype(np.int64) for s in found], pa.list_(pa.int64()))],
                names=["text_key", "set"])

    return run


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (``node, label``) with the classes joined that ``edges`` (``a, b``)
    connect. Edges become pairs of labels; every label takes the smallest label next
    to it, and the one that this takes, until no pair has two labels. One row per
    node; pairs stay distributed and shrink with every step."""
    pairs = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(
        labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
    steps = 0
    while True:
        pairs = reliable_checkpoint(pairs.where("x <> y").select(
            F.greatest("x", "y").alias("label"), F.least("x", "y").alias("other")).distinct())
        if pairs.isEmpty():
            return reliable_checkpoint(labels) if steps else labels
        hooks = pairs.groupBy("label").agg(F.min("other").alias("to"))
        further = hooks.select(F.col("label").alias("to"), F.col("to").alias("next"))
        hooks = hooks.join(further, "to", "left").select(
            "label", F.coalesce("next", "to").alias("to"))
        labels = labels.join(hooks, "label", "left").select(
            "node", F.coalesce("to", "label").alias("label"))
        steps += 1
        if steps % 4 == 0:  # keeps the plan short
            labels = reliable_checkpoint(labels)
        others = hooks.select(F.col("label").alias("other"), F.col("to").alias("y"))
        pairs = pairs.join(hooks, "label").join(others, "other", "left").select(
            F.col("to").alias("x"), F.coalesce("y", "other").alias("y"))


def _short(salt: int):
    """Sets as 32 bits of each hash, for comparing them inside blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column("set")
            ends = sets.offsets.to_numpy()
            values = sets.values.to_numpy(zero_copy_only=False).view(np.uint64)
            packed = (mixed(values + np.uint64(salt)) >> np.uint64(32)).astype(np.uint32)
            column = pa.array([packed[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(c for c, n in zip(batch.columns, batch.schema.names) if n != "set"), column],
                names=[*(n for n in batch.schema.names if n != "set"), "short"])

    return run


def _linked(bound: float, similarity: float):
    """Links between the classes in a bucket, between two blocks of it or inside one: a
    spanning forest of the texts that are alike. Pairs whose signatures (an octet for
    each coordinate) agree in less than a share ``bound`` are not looked at, nor those
    of one class by now, nor those that meet in an earlier bucket. The others are
    compared by their sets."""

    def run(group: pa.Table) -> pa.Table:
        marks = np.stack([np.frombuffer(m, np.uint8) for m in group.column("marks").to_pylist()])
        node, label, n, block, low, high = (
            group.column(c).to_numpy() for c in ("node", "label", "n", "block", "low", "high"))
        shorts, buckets, here = group.column("short"), group.column("keys"), group.column("key")[0].as_py()
        sets: dict[int, set] = {}
        keys: dict[int, set] = {}
        parent: dict[int, int] = {}
        sizes, classes = n.tolist(), label.tolist()

        def top(x: int) -> int:
            while x in parent:
                x = parent[x]
            return x

        def one(known: dict, i: int, read) -> set:
            if i not in known:
                known[i] = read(i)
            return known[i]

        words = lambda i: set(np.frombuffer(shorts[i].as_py(), np.uint32).tolist())
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        out: list[tuple[int, int]] = []
        for at in range(0, len(left), 32):
            rows = left[at:at + 32]
            now = np.array([top(c) for c in classes])
            a, b = n[rows, None], n[None, right]
            open_ = (now[rows, None] != now[None, right]) & (
                np.minimum(a, b) >= similarity * np.maximum(a, b))
            if low[0] == high[0]:
                open_ &= rows[:, None] < right[None, :]
            i, j = np.nonzero(open_)
            share = np.concatenate([
                (marks[rows[i[k:k + 20_000]]] == marks[right[j[k:k + 20_000]]]).mean(axis=1)
                for k in range(0, len(i), 20_000)] or [np.empty(0)])
            for x, y in zip(rows[i[share >= bound]].tolist(), right[j[share >= bound]].tolist()):
                p, q = top(classes[x]), top(classes[y])
                if p == q:
                    continue
                shared = one(keys, x, lambda i: set(buckets[i].as_py())) & one(
                    keys, y, lambda i: set(buckets[i].as_py()))
                if min(shared) != here:
                    continue
                common = len(one(sets, x, words) & one(sets, y, words))
                if common >= similarity * (sizes[x] + sizes[y] - common):
                    parent[max(p, q)] = min(p, q)
                    out.append((int(node[x]), int(node[y])))
        ends = list(zip(*out)) or [(), ()]
        return pa.table({"a": pa.array(ends[0], pa.int64()), "b": pa.array(ends[1], pa.int64())})

    return run


def _blocked(placed: DataFrame, marks: DataFrame, sets: DataFrame, similarity: float,
             coordinates: int, salt: int) -> DataFrame:
    """Links between classes that share a bucket: no more from a bucket's block than it
    has texts. Pairs are compared if their signature falls short of ``similarity`` by at
    most five deviations of its estimate. A large bucket is cut into blocks, by its
    texts and by their shingles, and every two of its blocks meet in a group of their
    own."""
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_TEXTS), F.ceil(
        F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    keys = placed.groupBy("node").agg(F.collect_set("key").alias("keys"))
    rows = placed.join(marks.join(keys, "node").join(sets, "node").mapInArrow(
        _short(salt), "node long, marks binary, keys array<long>, short binary"), "node").select(
        "key", "node", "label", "n", "marks", "keys", "short",
        F.pmod(F.xxhash64("node"), blocks).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    bound = similarity - 5 * (similarity * (1 - similarity) / coordinates) ** 0.5
    return rows.groupBy("key", "low", "high").applyInArrow(
        _linked(bound, similarity), "a long, b long").distinct()


def _drawn(placed: DataFrame, width: int, few: int, similarity: float) -> DataFrame:
    """Pairs (``a, b``) of a text and one of the first ``width`` texts of a bucket, of
    another class and a fitting size; one a bucket and ``few`` a text, by hash. A
    bucket hands over one array of its first texts, so no row is made per pair."""
    rank = Window.partitionBy("key").orderBy("node")
    firsts = placed.withColumn("rank", F.row_number().over(rank)).where(
        F.col("rank") <= width).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("node", "label", "n"))).alias("firsts"))
    fit = F.filter("firsts", lambda f: (f["label"] != F.col("label")) & (
        F.least(f["n"], F.col("n")) >= similarity * F.greatest(f["n"], F.col("n"))))
    drawn = placed.join(firsts, "key").select("key", "node", fit.alias("fit")).where(
        F.size("fit") > 0).select(
        "node", F.try_element_at("fit", (F.pmod(
            F.xxhash64("node", "key"), F.size("fit")) + 1).cast("int"))["node"].alias("first"))
    order = F.struct(F.xxhash64("node", "first", F.lit(width)).alias("order"), "first")
    chosen = drawn.groupBy("node").agg(
        F.slice(F.sort_array(F.collect_set(order)), 1, few).alias("chosen")).select(
        "node", F.explode("chosen.first").alias("first"))
    return chosen.select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b"))


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs that are alike by their whole sets."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return reliable_checkpoint(both.where(
        common >= F.lit(similarity) * (F.size("x") + F.size("y") - common)).select("a", "b"))


def _rounds(members: DataFrame, sets: DataFrame, marks: DataFrame,
            similarity: float, coordinates: int) -> DataFrame:
    """Classes (``node, label``) of the members of buckets (``key, node, n``).

    The first rounds compare every text with a few of the first texts of its buckets
    that are of another class; that joins most copies. The last one takes
    the buckets that still hold several classes, and there all pairs of different
    classes, by their signatures first. Every link found is checked on the whole sets.
    """
    labels = reliable_checkpoint(members.select("node", F.col("node").alias("label")).distinct())
    for width, few in (*FIRST_ROUNDS, (0, 0)):
        placed = members.join(labels, "node")
        several = placed.groupBy("key").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"),
            F.sum("n").alias("shingles")).where("low <> high").select("key", "size", "shingles")
        placed = reliable_checkpoint(placed.join(several, "key"))
        if placed.isEmpty():
            return labels
        if few:
            labels = merged(labels, _checked(
                _drawn(placed, width, few, similarity), sets, similarity))
        members = placed.select("key", "node", "n")
    salt, failed = 0, True
    while failed:  # a link by 32 bits that the whole sets deny could hide another one
        links = reliable_checkpoint(_blocked(
            placed.drop("label").join(labels, "node"), marks, sets, similarity, coordinates, salt))
        good = _checked(links, sets, similarity)
        labels, salt = merged(labels, good), salt + 1
        failed = links.count() > good.count()
    return labels


def _classes(docs: DataFrame, similarity: float, width: int, bands: int, rows: int,
             counted: bool) -> tuple[DataFrame, DataFrame]:
    """The signed rows of ``docs``, and ``text_key, text_id, own, label`` for every text
    with words: the id and the key of the row that stands for it, and its class."""
    signed = reliable_checkpoint(docs.select("doc_id", "text", row_key().alias("own")).mapInArrow(
        _sign(width, bands, rows, counted),
        "doc_id long, own binary, text_key binary, n long, bands array<long>, marks binary",
    ).withColumn("row", F.monotonically_increasing_id()))
    # One row stands for a text: with the smallest id, known ids before null ones.
    texts = reliable_checkpoint(signed.where("text_key is not null").groupBy("text_key").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "own", "row")).alias("pick")).select(
        "text_key", F.col("pick.doc_id").alias("text_id"), F.col("pick.own").alias("own"),
        F.col("pick.row").alias("row"),
        F.monotonically_increasing_id().alias("node")))
    keys = signed.select("row", "n", "bands").join(texts.select("row", "node"), "row").select(
        F.explode("bands").alias("key"), "node", "n")
    shared = keys.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key")
    members = reliable_checkpoint(keys.join(shared, "key", "left_semi"))
    wanted = reliable_checkpoint(members.select("node").distinct().join(texts, "node").select(
        "text_id", "text_key", "node"))
    chosen = wanted.select(F.col("text_id").alias("doc_id")).distinct()
    sets = docs.select("doc_id", "text").join(chosen, "doc_id", "left_semi")
    if not wanted.where("text_id is null").isEmpty():
        sets = sets.unionByName(docs.select("doc_id", "text").where("doc_id is null"))
    sets = reliable_checkpoint(sets.mapInArrow(
        _sets(width), "text_key binary, set array<long>").dropDuplicates(["text_key"]).join(
        wanted.select("text_key", "node"), "text_key").select("node", "set"))
    marks = signed.select("row", "marks").join(wanted.join(
        texts.select("node", "row"), "node").select("row", "node"), "row").select("node", "marks")
    labels = _rounds(members, sets, marks, similarity, bands * rows)
    return signed, texts.join(labels, "node", "left").select(
        "text_key", "text_id", "own", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE,
                    bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> DataFrame:
    """``doc_id, class_id, text_id``: one row per row of ``docs``.

    ``class_id`` is the smallest ``doc_id`` of the documents linked to this one,
    directly or through others, by a Jaccard similarity of word shingles of at least
    ``similarity``; ``text_id`` the smallest with exactly its shingles. Candidates
    share a band of the signature (30 bands of 5 miss a pair at 0.8 seven times in a
    million); each link is checked on the whole sets. With ``counted`` the
    signature weighs shingles by how often they occur, for texts compared so.

    Documents without words (null, empty) are classes of their own. Null ids have
    the class of their text, which is null if no other id is in it. Repeated rows
    are copies. Other columns are ignored; an empty table gives an empty result.
    """
    signed, classes = _classes(docs, similarity, width, bands, rows, counted)
    smallest = classes.groupBy("label").agg(F.min("text_id").alias("class_id"))
    classes = classes.join(smallest, "label").select("text_key", "text_id", "class_id")
    return signed.select("doc_id", "text_key").join(classes, "text_key", "left").select(
        "doc_id",
        F.when(F.col("text_key").isNull(), F.col("doc_id")).otherwise(
            F.col("class_id")).alias("class_id"),
        F.when(F.col("text_key").isNull(), F.col("doc_id")).otherwise(
            F.col("text_id")).alias("text_id"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE,
                bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> DataFrame:
    """One document of each class, with all columns: the one with the smallest id, or
    one without an id where the class has no other. Of different texts of the class
    under that id one stays; another class keeps its own, whatever its ids are.
    Documents without words all stay."""
    _, classes = _classes(docs, similarity, width, bands, rows, counted)
    kept = classes.groupBy("label").agg(
        F.min(F.struct(F.col("text_id").isNull(), "text_id", "own")).alias("pick")).select(
        F.col("pick.own").alias("__own"))
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    # Only whole repeats of a kept row share its key.
    chosen = docs.where(worded).withColumn("__own", row_key()).join(
        kept, "__own", "left_semi").dropDuplicates(["__own"]).drop("__own")
    return chosen.unionByName(docs.where(~F.coalesce(worded, F.lit(False))))
