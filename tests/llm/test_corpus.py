"""The corpus operators on small tables, against plain Python and in their odd cases."""

import gc
import hashlib
import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from freightlens.llm import (
    chat, language, mixing, neardup, neighbours, packing, quality, scoring, substrings, urls,
)
from freightlens.llm.queries import URL_RULES, tokenizer_path
from freightlens.llm.words import chunks
from freightlens.session import ship_package

# Extra columns with names that the operators use inside.
EXTRA = "bucket string, node string, row string, batch string, hashes string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def passage(seed, n):
    return " ".join(f"w{seed}x{i}" for i in range(n))


ROWS = [
    (1, passage(1, 200), "en", "b"),
    (2, passage(1, 200), "en", "b"),
    (3, passage(2, 60) + "\n" + passage(1, 80), "en", "a"),
    (4, passage(1, 190) + " new words here", None, None),
    (5, None, "en", "a"),
    (6, "", "de", "a"),
    (7, "1234 ?!", "de", "a"),
    (8, "one", "de", None),
    (9, "same line\nsame line\nsame line " * 3, None, "c"),
    (None, passage(1, 200), "en", "b"),
    (1, passage(1, 200), "en", "b"),
    (10, passage(3, 3000) + "  x  y\t z <|endoftext|>", "de", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return spark.createDataFrame(
        [(*r, len(r[1] or ""), *["x"] * 5) for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def words(text):
    return (text or "").encode().split()


def test_language(docs, none):
    text = {"en": "the thing that was with this other", "fr": "les eaux des anciens oiseaux"}
    rows = docs.sparkSession.createDataFrame(
        [(i, f"{t} {t.split()[i % 4]}", lang, i) for lang, t in text.items() for i in range(30)],
        "doc_id long, text string, lang string, score long")
    model = language.fit(rows)
    got = language.identify(rows, model).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 and not r.rejected for r in got)
    odd = {r.doc_id: r for r in language.identify(docs, model).collect()}
    for i in (5, 6, 7):
        assert (odd[i].lang_pred, odd[i].score, odd[i].rejected) == ("und", 0, True)
    assert language.identify(docs, model).count() == len(ROWS)
    assert language.identify(none, model).count() == 0
    assert language.identify(docs, language.fit(none)).where("lang_pred <> 'und'").count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    assert 50256 in tokenizer.encode(ROWS[-1][1], add_special_tokens=False).ids
    got = packing.pack(docs, tokenizer_path(), capacity=256).collect()
    made, sequences = Counter(), defaultdict(list)
    for r in got:
        made[r.doc_id, r.doc_tokens] += r.length
        sequences[r.sequence_id].append(r)
    for doc, text, *_ in ROWS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        times = sum(d == doc and t == text for d, t, *_ in ROWS)
        assert made[doc, len(ids)] == times * len(ids)
        for r in (r for r in got if r.doc_id == doc and r.doc_tokens == len(ids)):
            part = np.array(ids[r.start:r.start + r.length], "<u4")
            assert zlib.crc32(part.tobytes()) == r.ids_crc32
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert sum(made.values()) > 256 * (len(sequences) - 1)
    assert packing.pack(none, tokenizer_path()).count() == 0


class Counting:
    """A tokenizer that counts the texts it encodes."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_go_to_the_model():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    same = lambda x: plain.encode(x, add_special_tokens=False).ids
    words = ["".join(p) for p in itertools.product("abéßÿZ", repeat=4)]
    texts = [" ".join(words), ", ".join(words) + ".", "\n".join(words) + "!!\nß?"]
    chunked = packing.ChunkTokenizer(tokenizer_path())
    chunked.tokenizer = Counting(plain)
    assert [list(ids) for ids in chunked.encode(texts)] == [same(t) for t in texts]
    assert chunked.tokenizer.texts < 50
    odd = ["", " ", "\n", "a", " a", "a ", "\na", "a\n", "a  b", "a \nb", "a\n\nb", "it's don't 's x'll, 'T",
           "a1 1a a,b a.B x² ª º × ÷ Ωa aΩ, a×, a÷. a,,,, a$$$ (a) a_b _ ... a\tb a,\u00a0b a\u0301 e\u0301,",
           "x <|endoftext|> y", "a<|endoftext|>,", "a<| b", "a|>", "a< | b", "日本, 語.", "İ ı, ſ. K",
           "a\u200b, b\u2028c", "a\r\nb, c\r", "a\x85b \x1ca", "AZ[ az{ a` @a a@"]
    assert [list(ids) for ids in chunked.encode(odd)] == [same(t) for t in odd]


def test_tokenizers_go_when_a_worker_turns_to_another_operator():
    batch = pa.RecordBatch.from_pydict(
        {"doc_id": [1, 2], "text": ["a bé c", None], "row": [0, 1]})
    run = packing._pieces(tokenizer_path(), 1024, 0, 1)

    def here():
        gc.collect()
        return [id(x) for x in gc.get_objects() if type(x) is packing.ChunkTokenizer]

    old = here()
    assert [b.column("length").to_pylist() for b in run(iter([batch]))] == [[5, 1]]
    packed = here()
    list(run(iter([batch])))
    assert here() == packed and len(set(packed) - set(old)) == 1  # the next task finds it
    list(language._frequencies(iter([batch])))
    assert not set(packed) & set(here()) - set(old)


def test_chunks_count_octets():
    batch = pa.RecordBatch.from_pydict({"text": ["é" * 40, None, "", "a" * 80, "b"]})
    cut = list(chunks(iter([batch]), "text", 100, 10))
    assert [c.num_rows for c in cut] == [1, 2, 2]
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch]))


def test_dealing_balances_cost():
    lengths = np.array([600, 500, 400, 300, 200, 100, 50, 50])
    sequences = packing.deal(lengths, 1024, 1.0, 1 / 4096)
    assert len(sequences) == 3
    assert sorted(Counter({i: n for s in sequences for i, _, n in s}).values()) == sorted(lengths)


def test_mixing(docs, none):
    mix = mixing.taken_words(docs).collect()
    assert sorted(map(tuple, mix), key=str) == sorted(
        map(tuple, mixing.taken_words(docs).collect()), key=str)
    sizes = Counter()
    for _, text, _, source in ROWS:
        sizes[source] += len(words(text))
    targets = mixing.target_sizes(sizes)
    assert math.isclose(sum(targets.values()), 1.5 * sum(sizes.values()))
    assert all(targets[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert len(mix) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in mix)
    again = mixing.mixed_documents(docs)
    assert again.columns == docs.columns
    total = sum(len(words(r.text)) for r in again.collect())
    assert total == sum(r.taken for r in mix)
    assert mixing.taken_words(none).count() == 0
    assert mixing.mixed_documents(docs.where("text = ''")).count() == 0


def test_mixing_broadcasts_neither_slots_nor_sizes(docs):
    """Both grow with the corpus; only sources and sums of chunks are small."""
    mix = mixing.Mixture(docs)
    for frame in (mix.slices, mix.sizes):
        plan = frame._jdf.queryExecution().sparkPlan().toString().splitlines()
        joins = [line for line in plan if "BroadcastHashJoin" in line]
        assert not [line for line in joins if "block#" in line or "BuildLeft" in line]
    assert any("SortMergeJoin" in line and "block#" in line for line in
               mix.slices._jdf.queryExecution().sparkPlan().toString().splitlines())


def test_permutation_takes_every_index_once():
    for n in (1, 2, 3, 17, 64, 1000):
        out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(out) == list(range(n))


def removed(rows, width):
    first = {}
    for doc, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - width + 1):
            if doc is not None:
                g = tuple(w[i:i + width])
                first[g] = min(doc, first.get(g, doc))
    for doc, text, *_ in rows:
        w = words(text)
        gone = {j for i in range(len(w) - width + 1)
                if doc is not None and first[tuple(w[i:i + width])] < doc
                for j in range(i, i + width)}
        yield doc, len(w), len(gone), b" ".join(
            x for i, x in enumerate(w) if i not in gone).decode()


@pytest.mark.parametrize("width", [3, 50])
def test_substrings(docs, none, width):
    got = substrings.remove_repeats(docs, width).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in got], key=str) == sorted(
        removed(ROWS, width), key=str)
    assert all(r.n_removed == sum(s.end - s.start for s in r.spans) for r in got)
    assert substrings.remove_repeats(none).count() == 0


def test_neighbours(spark):
    ship_package(spark)
    random = np.random.default_rng(3)
    points = random.normal(size=(600, 8)).round(3)
    points[100:160] = points[100]
    rows = [(i, [float(x) for x in p], "x") for i, p in enumerate(points)]
    rows += [(1000, None, "x"), (1001, [0.0] * 8, "x"), (1002, [float("nan")] * 8, "x"),
             (1003, [None] * 8, "x"), (1004, [float("inf")] + [1.0] * 7, "x"), (5, rows[5][1], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part string")
    got = defaultdict(list)
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0).orderBy(
            "query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    exact = points.astype(np.float32).astype(float)
    unit = exact / np.linalg.norm(exact, axis=1)[:, None]
    hits = 0
    for q in range(0, 600, 20):
        near = unit @ unit[q]
        near[q] = -9
        best = np.lexsort((np.arange(600), -near.round(12)))[:5]
        hits += len(set(best) & {v for v, _ in got[q]})
        assert len(got[q]) == 5
    assert hits >= 0.9 * 5 * 30 and set(got) == set(range(0, 600, 20))
    assert [v for v, _ in got[140]] == [100, 101, 102, 103, 104]
    assert neighbours.search(table.where("false"), F.lit(True)).count() == 0
    assert neighbours.search(table.where("vec_id = 7"), F.lit(True)).count() == 0


def test_chat(spark):
    ship_package(spark)
    odd = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", odd), (-7, 1, "assistant", odd), (1, 1, "assistant", "b\\"),
            (1, 0, "us:er", None), (1, None, None, "####"), (None, 0, "assistant", "</turn>\n"),
            (1, 1, "assistant", "b\\"), (2, 0, "user", "x" * 200_000)]
    table = spark.createDataFrame(
        [(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    got = {r.conv_id: r for r in chat.digests(chat.render(table)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv),
                       key=lambda r: [(x is not None, x or 0) if i == 1 else x or ""
                                      for i, x in enumerate(r[1:4], 1)])
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        learned = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        row = got[conv]
        assert row.n_turns == len(turns)
        assert row.turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert row.loss_chars == len(learned)
        assert row.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat.digests(chat.render(table.where("false"))).count() == 0


def test_templates():
    made = chat.Template(
        "{% set a = 'x' + 'y' %}{% for m in messages %}{% if m.role == 'u' and not loop.first %}"
        "[{{ m['text'] | upper }}]{% elif 1 == 2 %}never{% else %}"
        "{% generation %}({{ m.text }}{{ a }}){% endgeneration %}{% endif %}{% endfor %}")
    shown = list(made.render({"messages": [{"role": "u", "text": "p"}, {"role": "u", "text": "q"}]}))
    assert "".join(t for t, _ in shown) == "(pxy)[Q]"
    assert "".join(t for t, learned in shown if learned) == "(pxy)"
    assert chat.folded(("+", ("const", "a"), ("const", "b"))) == ("const", "ab")
    assert "".join(t for t, _ in chat.Template("{{ x.__class__ }}").render({"x": "s"})) == ""
    for bad in ("{% for x %}", "{{ f(x) }}", "{% if x %}", "{{ x | nothing }}", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)


def test_urls(spark):
    ship_package(spark)
    cases = {
        "http://A.example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://a.com/de/": ("a.com", "/de/", "com/de/", "block"),
        "http://a.com/fr/": ("a.com", "/fr/", "com/fr/", "allow"),
        "http://a.org?x=/": ("a.org", "", None, "allow"),
        "no scheme.org/": ("", "", None, "allow"),
        None: ("", "", None, "allow"), "": ("", "", None, "allow"),
    }
    table = spark.createDataFrame([(u, "x") for u in cases], "url string, host string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(table, URL_RULES).collect()}
    assert got == cases
    assert urls.judge(table.where("false"), URL_RULES).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20000).selectExpr("cast(id as string) as key")
    listed = spark.range(0, 20000, 7).selectExpr("cast(id as string) as key")
    cascade = urls.Cascade.over(listed, universe)
    assert len(cascade.levels) > 2
    assert [str(i) in cascade for i in range(20000)] == [i % 7 == 0 for i in range(20000)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scoring(docs, none, order):
    held = F.col("doc_id") % 3 == 0
    got = scoring.score_documents(docs, held, order, strength=5.0).collect()
    texts = [(d, d is not None and d % 3 == 0,
              [b"<s>", *(w.lower() for w in words(t)), b"</s>"]) for d, t, *_ in ROWS]
    counts = Counter()
    for _, out, w in texts:
        if not out:
            counts.update(tuple(w[i:i + k]) for k in range(1, order + 1)
                          for i in range(len(w) - k + 1))
    single = {g: c for g, c in counts.items() if len(g) == 1 and g != (b"<s>",)}
    total, kinds = sum(single.values()), len(single)

    def p(gram):
        if len(gram) == 1:
            return (counts[gram] + 1) / (total + kinds + 1)
        context, lower = counts[gram[:-1]], p(gram[1:])
        return (counts[gram] + 5.0 * lower) / (context + 5.0) if context else lower

    expected = [(d, out, len(w) - 1, sum((x,) in single for x in w[1:]), total,
                 round(sum(math.log10(p((x,))) for x in w[1:]), 6),
                 round(sum(math.log10(p(tuple(w[max(0, i - order + 1):i + 1])))
                           for i in range(1, len(w))), 6)) for d, out, w in texts]
    found = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens,
              round(r.base_score, 6), round(r.score, 6)) for r in got]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert scoring.score_documents(none, held).count() == 0


def test_scoring_takes_the_strength_that_suits_the_corpus(spark, none):
    """The sum over training tokens, each left out of the counts, by plain loops."""
    random = np.random.default_rng(7)
    texts = [" ".join(f"t{x}" for x in np.minimum(random.geometric(0.2, 60), 12)) for _ in range(30)]
    counts = Counter()
    marked = [["<s>", *t.split(), "</s>"] for t in texts]
    for w in marked:
        counts.update((x,) for x in w)
        counts.update(zip(w, w[1:]))
    single = {g: c for g, c in counts.items() if len(g) == 1 and g != ("<s>",)}
    total, kinds = sum(single.values()), len(single)
    strengths = (1.0, 20.0, 400.0, 5000.0)

    def spared(m):
        return sum(math.log10((counts[a, b] - 1 + m * counts[b,] / (total + kinds))
                              / (counts[a,] - 1 + m)) for w in marked for a, b in zip(w, w[1:]))

    best = max(strengths, key=spared)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, wanted = (
        {r.doc_id: r.score for r in scoring.score_documents(docs, F.lit(False), 2, m).collect()}
        for m in (strengths, best))
    assert found == wanted and best != strengths[0]
    assert scoring.score_documents(none, F.lit(False)).count() == 0


def test_near_duplicates(docs, none):
    got = sorted(((r.doc_id, r.class_id) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 3), (4, 1), (5, 5), (6, 6), (7, 7), (8, 8),
                          (9, 9), (10, 10), (None, 1)], key=str)
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 7, 8, 9, 10]


def test_one_of_each_keeps_a_row_of_every_class(docs):
    """Null ids, and different texts under one id."""
    near = passage(21, 198) + " two more"
    rows = [(None, passage(20, 90)),
            (None, passage(21, 200)), (None, near),
            (1, passage(22, 200)), (2, passage(22, 198) + " two more"), (2, passage(23, 70)),
            (None, passage(22, 200)), (3, passage(24, 80)), (3, passage(25, 80)),
            (3, passage(25, 80)), (None, None)]
    table = docs.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in neardup.one_of_each(table).collect()]
    null_group = [r for r in kept if r in rows[1:3]]
    assert len(null_group) == 1
    assert sorted((r for r in kept if r not in null_group), key=str) == sorted(
        [rows[0], rows[3], rows[5], rows[7], rows[8], rows[10]], key=str)


def test_near_duplicates_link_as_brute_force_does(docs):
    """A large group of near copies, in which many pairs are below the bound."""
    random = np.random.default_rng(5)
    rows = []
    for i in range(120):
        w = [f"b{j}" for j in range(150)]
        for place in random.choice(150, int(random.integers(0, 7)), replace=False):
            w[place] = f"r{random.integers(10 ** 9)}"
        rows.append((i, " ".join(w)))
    table = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(t.split()[i:i + 5]) for i in range(146)} for _, t in rows]
    parent = list(range(120))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(120):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(table).collect()}
    assert got == {i: top(i) for i in range(120)}


def test_darts_estimate_weighted_similarity():
    random = np.random.default_rng(1)
    base = random.integers(1, 2**63, 400).astype(np.uint64)
    a, b = np.full(400, 2.0), np.where(np.arange(400) < 200, 2.0, 0.5)
    signed = neardup.darts(np.concatenate([base, base]), np.concatenate([a, b]),
                           np.array([0, 400]), 512)
    share = (signed[0] == signed[1]).mean()
    assert abs(share - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.08


def test_quality(docs, none):
    got = quality.judge(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.quality <= 1 for r in got)
    rows = {r.doc_id: r for r in got}
    assert (rows[5].n_words, rows[6].n_words, rows[5].word_chars) == (0, 0, 0)
    text = ROWS[8][1]
    w = text.split()
    grams = Counter(zip(w, w[1:], w[2:]))
    inside = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if x.split()]
    assert (rows[9].n_words, rows[9].n_repeat_words, rows[9].n_dup_lines, rows[9].word_chars) == (
        len(w), len(inside), len(lines) - len(set(lines)), sum(map(len, w)))
    assert quality.judge(none).count() == 0


def test_estimate_finds_the_accuracies_of_drawn_votes(spark):
    """Against expectation-maximisation row by row, and against the drawn truth."""
    random = np.random.default_rng(5)
    good, bad = [0.95, 0.9, 0.9, 0.8, 0.95], [0.7, 0.6, 0.7, 0.6, 0.5]
    truth = random.random(20000) < 0.8
    right = random.random((len(truth), 5)) < np.where(truth[:, None], good, bad)
    votes = np.where(right == truth[:, None], 1, -1) * (random.random(right.shape) < 0.8)
    names = [f"v{i}" for i in range(5)]
    table = spark.createDataFrame(
        [(*map(int, k), c) for k, c in Counter(map(tuple, votes)).items()],
        ", ".join(f"{v} int" for v in names) + ", n long")
    found = quality.estimate(table, names, rounds=30)

    prior, a, b = 0.9, np.full(5, 0.9), np.full(5, 0.4)
    for _ in range(30):
        factor = np.where(votes > 0, a / (1 - b), np.where(votes < 0, (1 - a) / b, 1.0))
        odds = prior / (1 - prior) * factor.prod(axis=1)
        p = (odds / (1 + odds))[:, None]
        yes, no = votes > 0, votes < 0
        a = ((p * yes).sum(0) + 18) / ((p * (yes | no)).sum(0) + 20)
        b = (((1 - p) * no).sum(0) + 8) / (((1 - p) * (yes | no)).sum(0) + 20)
        a = np.clip(a, 0.5, 0.95)
        b = np.minimum(0.75, np.maximum(1.01 - a, b))
        prior = (p.sum() + 18) / (len(votes) + 20)
    assert found.prior == pytest.approx(prior, abs=1e-9)
    assert found.good == pytest.approx(list(a), abs=1e-9)
    assert found.bad == pytest.approx(list(b), abs=1e-9)
    assert abs(prior - 0.8) < 0.03
    assert np.abs(a - good).max() < 0.04 and np.abs(b - bad).max() < 0.06


def test_cut_texts_return_to_their_rows(spark):
    import corpus_pipeline

    rows = [(1, passage(30, 60)), (2, passage(31, 20) + " " + passage(30, 60)),
            (2, passage(32, 30)), (None, passage(30, 60)), (3, None)]
    docs = spark.createDataFrame(
        [(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, n_chars long")
    ship_package(spark)
    got = corpus_pipeline.cut_repeated_passages(spark, docs, "").collect()
    wanted = [*rows[:1], (2, passage(31, 20)), *rows[2:]]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(wanted, key=str)


def test_pipeline(spark, folder):
    import corpus_pipeline

    documents = spark.read.parquet(f"{folder}/documents.parquet")
    ship_package(spark)
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == documents.columns, name
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert pieces and max(r.length for r in pieces) <= 1024
    empty = documents.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


def test_near_duplicates_leave_a_block_as_a_forest():
    import pyarrow as pa

    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**32, 400, dtype=np.uint32)
    sets = []
    for i in range(300):  # every other text keeps 93 % of the base, the rest is alone
        new = rng.integers(0, 2**32, 400, dtype=np.uint32)
        sets.append(np.where(rng.random(400) < (0.93 if i % 2 else 0.4), base, new))
    # Signatures agree as often as sets do; the sets decide.
    picks = [np.where(rng.random(150) < np.isin(s, base).mean(), 1, rng.integers(2, 250, 150))
             for s in sets]
    group = pa.table({
        "key": [5] * 300, "node": list(range(300)), "label": list(range(300)), "n": [400] * 300,
        "marks": [p.astype(np.uint8).tobytes() for p in picks], "keys": [[5, 9]] * 300,
        "short": [s.tobytes() for s in sets], "block": [0] * 300, "low": [0] * 300, "high": [0] * 300})
    links = neardup._linked(0.0, 0.8)(group).to_pylist()
    reach = list(range(300))
    for link in links:
        reach = [reach[link["a"]] if x == reach[link["b"]] else x for x in reach]
    alike = [[len(np.intersect1d(a, b)) / (800 - len(np.intersect1d(a, b))) >= 0.8 for b in sets]
             for a in sets]
    wanted = list(range(300))
    for i in range(300):
        for j in range(i):
            if alike[i][j]:
                wanted = [wanted[i] if x == wanted[j] else x for x in wanted]
    assert len(links) == 300 - len(set(wanted)) < 150
    assert len(set(zip(reach, wanted))) == len(set(wanted)) == len(set(reach))
    # A pair that an earlier bucket has is left to that bucket.
    later = group.set_column(5, "keys", pa.array([[3, 5]] * 300))
    assert neardup._linked(0.0, 0.8)(later).num_rows == 0


def test_cut_repeats_keeps_rows_and_their_columns(docs, none):
    clash = docs.withColumnRenamed("bucket", "own_block").withColumnRenamed("node", "block")
    got = substrings.cut_repeats(clash)
    assert got.schema == clash.schema and substrings.cut_repeats(none).count() == 0
    removed = {}
    for r in substrings.remove_repeats(docs).collect():
        if r.n_removed:
            removed.setdefault(r.doc_id, set()).add(r.text)
    want = Counter()
    for r in clash.collect():
        alone = r.doc_id not in removed
        want[(r.doc_id, r.text if alone else None, r.own_block, r.lang)] += 1
    assert len(removed) > 1 and want == Counter(
        (r.doc_id, None if r.doc_id in removed else r.text, r.own_block, r.lang)
        for r in got.collect())
    assert all(r.text in removed[r.doc_id] for r in got.collect() if r.doc_id in removed)


def test_language_sample_takes_different_texts(spark):
    ship_package(spark)
    many = [(i, "the same thing with this and that", "en") for i in range(4000)]
    other = [(i, f"quel oiseau {i} chante dans les bois de la ville", "fr") for i in range(300)]
    rows = spark.createDataFrame(many + other, "doc_id long, text string, lang string")
    model = language.fit(rows, sample_rows=100)
    got = language.identify(rows, model)
    assert got.where("rejected or lang_pred <> lang").count() == 0


def test_stages_keep_columns_of_any_name(docs):
    import corpus_pipeline

    extra = ["score", "rejected", "lang_pred", "row_key", "cut_text", "__own", "own_block"]
    clash = docs.select("doc_id", "text", "lang", "source", "n_chars", *[
        F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c)
        for c in extra]).cache()
    for _, stage in corpus_pipeline.STAGES[:3]:
        got = stage(docs.sparkSession, clash, "")
        assert got.columns == clash.columns
        rows = got.collect()
        assert rows and all(
            r[c] == f"{c} {'-' if r.doc_id is None else r.doc_id}" for r in rows for c in extra)
