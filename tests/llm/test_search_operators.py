"""Spelling variants, hard negatives and benchmark matches against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightlens.llm import decontaminate, negatives, spelling
from freightlens.session import ship_package

EXTRA = "word string, n long, prefix string, block long, spans string, items string, label2 int"
EXTRAS = ["x", 1, "x", 1, "x", "x", 1]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def table(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl).repartition(3)


# Spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(docs, least_letters, least_count):
    counts = Counter()
    for doc_id, text in docs:
        run = ""
        for c in (text or "") + " ":
            c = c.lower() if c.isascii() else c
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 199 == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                counts[run] += 1
                run = ""
    words = {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_count}
    rows, forms = [], {}
    for w, n in words.items():
        close = sorted((-words[v], v) for v in words if near(w, v))
        if close and -close[0][0] >= 5 * n:
            forms[w] = close[0][1]
        rows.append((w, n, len(close)))
    out = set()
    for w, n, n_near in rows:
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n, n_near, words[forms[w]] if w in forms else None))
    return out


@pytest.mark.parametrize("letters", [8, 60, 10**6])
def test_spelling_equals_all_pairs(spark, letters):
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    docs = [(i, " ".join(rng.choices(words, weights=range(1, 121), k=120)).title() + ".", *EXTRAS)
            for i in range(60)]
    docs += docs[:5] + [(None, "abab abab abab", *EXTRAS), (7, None, *EXTRAS), (8, "", *EXTRAS)]
    got = spelling.group_variants(
        table(spark, docs, "doc_id long, text string, " + EXTRA), 2, 3, slip=True, letters=letters)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == variants([d[:2] for d in docs], 2, 3)


def test_spelling_follows_forms_and_very_long_runs(spark):
    long = "ab" * 20_000
    text = " ".join(
        ["kettle"] * 1 + ["kettel"] * 5 + ["kettell"] * 25 + ["ketteell"] * 125 + [long, long[:-1]])
    got = {r.word: r for r in spelling.group_variants(
        table(spark, [(1, text)], "doc_id long, text string"), least_count=1, letters=30).collect()}
    assert got["kettel"].root == "ketteell" and got["kettel"].form == "kettell"
    assert got[long].n_near == got[long[:-1]].n_near == 1 and got[long].form is None
    none = table(spark, [(1, None)], "doc_id long, text string").where("false")
    assert spelling.group_variants(none).count() == 0


def test_spelling_starts_without_pairs_of_partitions(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    words = spark.createDataFrame(
        [(f"word{i:04}", 5) for i in range(400)], "word string, n long").repartition(16)
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        assert spelling.partitions(words).rdd.getNumPartitions() <= 3 * 16
    finally:
        spark.conf.set(key, before)


# Hard negatives


def mined(rows):
    """Rows are (vec_id, label, components); all of them usable."""
    dims = max((len(v) for *_, v in rows), default=0)
    m = np.array([list(v) + [0] * (dims - len(v)) for *_, v in rows], np.int64).reshape(len(rows), dims)
    out = []
    for a, (anchor, label, _) in enumerate(rows):
        if anchor % 5:
            continue
        order = sorted((-int(m[a] @ m[b]), rows[b][0], b) for b in range(len(rows)) if b != a)
        for score, positive, _ in [x for x in order if rows[x[2]][1] == label][:5]:
            fit = [x for x in order if rows[x[2]][1] != label
                   and 50 * -score <= 100 * -x[0] <= 95 * -score][:3]
            out += [(anchor, positive, k, x[1], -score, -x[0]) for k, x in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_negatives_equal_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 40)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 16)
    monkeypatch.setattr(negatives, "CHUNK", 7)
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 30, (4, 12))
    rows = []
    for i in range(240):
        c = i % 4
        v = np.floor(centres[c] * rng.uniform(0.2, 3) + rng.normal(0, 20, 12))
        rows.append((i, c if i % 3 else (c + 1) % 4, [float(x) for x in v]))
    rows += [(300, 0, rows[0][2])] * 30 + [(305, 1, rows[0][2])] * 30  # ties and repeated rows
    rows += [(310, 0, [0.0] * 12), (315, 0, [5.0] * 3), (316, 9, [7.0] * 12), (320, 9, [])]
    odd = [(330, None, [1.0] * 12), (335, 1, None), (340, 1, [1.0, None] * 6),
           (345, 1, [float("nan")] * 12), (350, 1, [float("inf")] * 12), (None, 1, [1.0] * 12)]
    df = table(spark, [(*r, *EXTRAS) for r in rows + odd],
               "vec_id long, label int, embedding array<double>, " + EXTRA)
    got = negatives.mine(df, F.col("vec_id") % 5 == 0)
    want = mined(rows)
    assert len(want) > 300
    assert sorted(map(tuple, got.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score",
        "negative_score").collect())) == want
    assert negatives.mine(df.where("false"), F.col("vec_id") % 5 == 0).count() == 0


def test_index_omits_dimensions_and_loses_nothing():
    rng = np.random.default_rng(5)
    points = np.floor(rng.normal(0, 40, (300, 16)) * np.linspace(3, 0.1, 16))
    anchors = points[:20]
    index = negatives.Index(points)
    thresholds = 0.6 * (anchors * anchors).sum(axis=1)
    depths = index.depths((thresholds / index.norms(anchors)[:, 0]).min())
    assert depths.mean() < 12
    i, j, score = index.join(anchors, thresholds)
    every = anchors @ points.T
    assert set(zip(i, j)) == set(zip(*np.nonzero(every >= thresholds[:, None])))
    assert (score == every[i, j]).all()


def test_floored_keeps_no_odd_vector(spark):
    df = spark.createDataFrame(
        [([0.5, -0.001],), ([float("nan")],), ([None],), (None,)], "v array<float>")
    got = [r[0] for r in df.select(negatives.floored(F.col("v"), 256)).collect()]
    assert got == [[128.0, -1.0], None, None, None]


# Benchmark matches


def leaks(docs, items, width):
    windows = defaultdict(set)
    split = lambda t: "".join(
        c.lower() if c.isascii() and c.isalnum() else c if c > "\x7f" else " "
        for c in t or "").split(" ")
    split_ = lambda t: [w for w in split(t) if w]
    for item, text in items:
        w = split_(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, names = split_(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i:i + n])):
                    hit |= set(range(i, i + n))
                    names |= found
        out.append((doc, len(w), len(hit), sorted(str(x) for x in names if x is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("octets", [700, 10**7])
def test_matches_equal_all_windows(spark, octets):
    rng = random.Random(4)
    word = lambda: rng.choice("A b cé d7 e".split())
    text = lambda n: rng.choice([" ", "--", "\n"]).join(word() for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 6, 20]))) for i in range(12)]
    items += [(40, "only one here"), (40, "and under the same id"), (None, "nobody's words"), (41, None),
              (42, "?!"), (43, "word " * 300)]
    docs = [(i, text(rng.choice([0, 2, 9, 40])) + " zz " + (rng.choice(items)[1] or "")[:60].upper()
             if i % 3 and i != 2 else "q q " + "r " * i) for i in range(1, 40) if i % 13]
    docs += [docs[0], docs[0], (None, "nobody s words"), (50, None), (51, ""),
             (52, "x " * 3_000 + "word " * 3_000)]
    ddl = "doc_id long, text string, " + EXTRA
    df = table(spark, [(*d, *EXTRAS) for d in docs], ddl)
    bench = table(spark, [(*x, 1) for x in items], "item_id long, text string, n_words int")
    got = decontaminate.find(df, bench, width=4, octets=octets).collect()
    want = leaks(docs, items, 4)
    assert sum(1 for w in want if w[3]) > 5
    assert sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"]))
                   for r in got), key=str) == want
    clean = decontaminate.decontaminate(df, bench, width=4, octets=octets)
    assert clean.schema == df.schema
    hit = Counter(str(w[0]) for w in want if w[2])
    assert Counter(str(r.doc_id) for r in clean.collect()) == Counter(
        str(d) for d, _ in docs) - hit


def test_longest_matches(spark):
    words = [f"w{i}" for i in range(60)]
    bench = table(spark, [(1, " ".join(words)), (2, "a b c"), (3, "never met")],
                  "item_id long, text string")
    docs = table(spark, [
        (5, "x y " + " ".join(words[10:25]) + " z"), (6, " ".join(words[20:50])),
        (7, " ".join(words[20:50])), (8, "c a b c a b c")], "doc_id long, text string")
    got = {r.item_id: tuple(r)[1:] for r in decontaminate.longest_matches(docs, bench).collect()}
    assert got.keys() == {"1", "2"}
    assert got["1"] in ((30, 20, 6, 0), (30, 20, 7, 0)) and got["2"] in ((3, 0, 8, 1), (3, 0, 8, 4))


def test_no_items_and_no_documents(spark):
    docs = table(spark, [(1, "a b"), (2, None)], "doc_id long, text string")
    bench = table(spark, [(1, "a b")], "item_id long, text string")
    none = decontaminate.find(docs, bench.where("false")).collect()
    assert [(r.doc_id, r.n_words, r.spans) for r in sorted(none)] == [(1, 2, []), (2, 0, [])]
    assert decontaminate.find(docs.where("false"), bench).count() == 0
