"""Quality rules combined by weak supervision, in DataFrame expressions only.

Every rule votes good (1) or bad (-1) or abstains (0), each on a fact of its own. Votes
are counted by pattern; expectation-maximisation over the patterns estimates the share
of good documents and how often each rule votes right on good and on bad ones, and a
document's posterior probability of being good decides. The patterns number at most ``3 ** rules`` whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.llm.words import WORD
from freightlens.session import reliable_checkpoint

# Fixed value: the symbols that rules count.
SYMBOLS = "#*$%&|<>"
# Fixed value: the white space between words.
SPACES = " \t\n\v\f\r"

ROUNDS = 25
START_PRIOR = 0.9
# Good documents pass most rules; a bad one fails a few of them.
START_GOOD, START_BAD = 0.9, 0.4
# Pseudo-votes that hold an accuracy, and pseudo-documents that hold the prior, near
# their start while evidence is thin.
STRENGTH = 20.0
# No rule is trusted further than this, so that none decides alone against the others.
MOST_GOOD, MOST_BAD = 0.95, 0.75


def occurrences(column: str, characters: str) -> Column:
    """How often any of some characters occurs; ``replace`` is a search of bytes."""
    return sum((F.length(column) - F.length(F.replace(F.col(column), F.lit(c), F.lit("")))
                for c in characters), F.lit(0))


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts the rules read, from whole texts.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` (lines with a word
    that equal an earlier line), ``n_lines`` (lines with a word), ``n_repeat_words``
    (words inside three-word windows found twice or more), ``n_ends`` (sentence
    marks). Windows are compared by 64-bit hashes inside one text. Null and empty
    texts have zeros.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    hashed = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.transform(words, lambda w: F.xxhash64(w)).alias("w"),
        lines.alias("lines"))
    n = F.size("w")
    # (hash, place) of every window, sorted: equal windows become neighbours.
    windows = F.sort_array(F.transform(
        F.slice("w", F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(
            x, F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i"))))
    counted = hashed.select(
        "doc_id", n.cast("long").alias("n_words"),
        (F.length("text") - occurrences("text", SPACES)).cast("long").alias("word_chars"),
        occurrences("text", SYMBOLS).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        occurrences("text", ".!?").cast("long").alias("n_ends"),
        windows.alias("s"))
    same = lambda i, j: F.get("s", i).h == F.get("s", j).h
    repeated = F.sort_array(F.transform(
        F.filter("s", lambda x, i: F.coalesce(same(i, i + 1), F.lit(False))
                 | F.coalesce((i > 0) & same(F.greatest(i - 1, F.lit(0)), i), F.lit(False))),
        lambda x: x.i))
    placed = counted.withColumn("r", repeated).drop("s")
    covered = F.aggregate(
        F.transform("r", lambda x, i: F.least(
            F.lit(3), F.coalesce(F.get("r", i + 1) - x, F.lit(3)))),
        F.lit(0), lambda total, x: total + x)
    return placed.withColumn("n_repeat_words", covered.cast("long")).drop("r")


def default_rules() -> dict[str, Column]:
    """Votes by name: 1 good, -1 bad, 0 abstains. Figures are per hundred words."""
    n = F.col("n_words")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "length": vote(n < 20, n >= 50),
        "word_length": vote(
            (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n),
            F.col("word_chars").between(4 * n, 8 * n)),
        "symbols": vote(10 * F.col("n_symbols") > n, 50 * F.col("n_symbols") <= n),
        "lines": vote(10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
                      10 * F.col("n_dup_lines") <= F.col("n_lines")),
        "repeats": vote(100 * F.col("n_repeat_words") > 40 * n,
                        100 * F.col("n_repeat_words") <= 10 * n),
        "sentences": vote(
            (F.col("n_ends") == 0) & (n >= 20), 100 * F.col("n_ends") >= 2 * n),
    }


@dataclass(frozen=True)
class Estimate:
    """The share of good documents, and how often each rule's vote is right on good
    and on bad documents."""

    prior: float
    good: list[float]
    bad: list[float]


def posterior(votes: Sequence[str], found: Estimate) -> Column:
    """Probability of good, given the votes of independent rules; abstentions say
    nothing. The factors are one array, so that the expression stays the same while
    they change."""
    factors = F.lit([found.prior / (1 - found.prior)] + [
        x for a, b in zip(found.good, found.bad) for x in (a / (1 - b), (1 - a) / b)])
    odds = F.get(factors, F.lit(0))
    for i, name in enumerate(votes):
        odds = odds * F.when(F.col(name) > 0, F.get(factors, F.lit(2 * i + 1))).when(
            F.col(name) < 0, F.get(factors, F.lit(2 * i + 2))).otherwise(1.0)
    return odds / (1 + odds)


def estimate(patterns: DataFrame, votes: Sequence[str], rounds: int = ROUNDS) -> Estimate:
    """Prior and accuracies from counted patterns (``n``).

    Each round is one aggregation to two sums per rule and vote. A rule is held to vote
    bad more often on bad documents than on good ones, so that "good" keeps its meaning.
    """
    rules = range(len(votes))
    found = Estimate(START_PRIOR, [START_GOOD for _ in rules], [START_BAD for _ in rules])

    def share(right: float, wrong: float, start: float) -> float:
        return (right + STRENGTH * start) / (right + wrong + STRENGTH)

    p, n = F.col("p"), F.col("n")
    for _ in range(rounds):
        row = patterns.select("*", posterior(votes, found).alias("p")).agg(
            F.sum(p * n).alias("good"), F.sum(n).alias("n"),
            *[F.sum(F.when(F.col(v) == sign, of * n).otherwise(0.0)).alias(f"{i}{name}{sign}")
              for i, v in enumerate(votes) for sign in (1, -1)
              for name, of in (("g", p), ("b", 1 - p))]).first()
        if not row["n"]:
            break
        prior = (row["good"] + STRENGTH * START_PRIOR) / (row["n"] + STRENGTH)
        good = [min(MOST_GOOD, max(0.5, share(row[f"{i}g1"], row[f"{i}g-1"], START_GOOD)))
                for i in rules]
        bad = [min(MOST_BAD, max(1.01 - good[i], share(row[f"{i}b-1"], row[f"{i}b1"], START_BAD)))
               for i in rules]
        found = Estimate(min(0.999, max(0.001, prior)), good, bad)
    return found


def judge(docs: DataFrame, rules: dict[str, Column] | None = None,
          threshold: float = 0.5) -> DataFrame:
    """The measures of every row, the vote of each rule (``vote_<name>``), ``quality``
    (posterior probability of being good) and ``accepted`` (at least ``threshold``).

    Null and empty texts have zero counts and are voted on as such. Repeated rows
    are judged alike and counted each. Other columns are ignored; an empty table
    gives an empty result.
    """
    rules = rules or default_rules()
    measured = measures(docs)
    names = [f"vote_{name}" for name in rules]
    voted = reliable_checkpoint(measured.select(
        "*", *[v.cast("int").alias(n) for n, v in zip(names, rules.values())]))
    patterns = reliable_checkpoint(voted.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1))
    found = estimate(patterns, names)
    return voted.withColumn("quality", posterior(names, found)).withColumn(
        "accepted", F.col("quality") >= threshold)

