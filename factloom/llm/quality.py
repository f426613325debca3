"""Quality rules as weak supervision: rules vote or abstain, and expectation-maximisation weighs their votes.

A rule votes -2 or -1 (junk, at a hard and at a soft threshold), 1 (good) or abstains (0).
Rules that look at the same thing form a family, whose joint vote has one joint weight.
Junk comes in kinds that one family sees and the others take for prose, so the hidden
class of a text is good or one kind of junk for each family.  The estimate gives the
share of each class and how often each joint vote occurs in it; the quality of a text
is the posterior probability of the good class.

All work on rows is DataFrame expressions.  The driver sees only how often each
combination of votes occurs (at most 4 ** rules rows; some hundreds in practice).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import beside, doc_key, doc_out, written

SEPARATORS = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text that isn't null."""
    bare = F.btrim(text, F.lit(SEPARATORS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t\\n\\x0B\\f\\r]+"))


def repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more.

    Windows are compared by a 64-bit hash within one text.  Only a text that has a
    repeated window is sorted: windows that are equal then stand side by side, and
    the places of those that have an equal neighbour are merged.
    """

    def covered(pairs: Column) -> Column:
        n = F.size(pairs)
        same = lambda x, i: F.when((i >= 0) & (i < n), F.get(pairs, i)["h"] == x["h"]).otherwise(False)
        places = F.sort_array(F.transform(F.filter(pairs, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
        gaps = lambda p: F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3)))
        return let(places, lambda p: F.aggregate(gaps(p), F.lit(0).cast("long"), lambda s, x: s + x))

    def of_hashes(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, covered))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(hashes, of_hashes))

    return let(words, of_words)


def features(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base figures, those of the rules, and the columns ``keep`` as one struct ``_kept``; a null text has no words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("int")
    base = docs.select(doc_key(), kept.alias("_kept"), text.alias("_text")).withColumn("_words", words_of(F.col("_text")))
    t, w = F.col("_text"), F.col("_words")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    figures = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
        let(lines, lambda x: F.size(x).cast("long")).alias("n_lines"),
        count(SYMBOLS + "+").alias("n_marks"),
        count("\\p{Lu}").alias("n_upper"),
        count("!").alias("n_exclaim"),
        count("[.?!;:,\\u3002\\uff01\\uff1f]").alias("n_stops"),
        count("[.?!\\u3002\\uff01\\uff1f](?=\\s|$)").alias("n_ends"),
    )
    return base.select("doc_id", "_kept", F.inline(F.array(figures)))  # a generator: what reads the figures can't compute them again


@dataclass(frozen=True)
class Rule:
    """Votes -2 where ``hard`` holds, else -1 where ``soft`` holds, else 1 where ``good`` holds, else abstains."""

    name: str
    hard: str
    soft: str
    good: str


VOTES = (-2, -1, 0, 1)

#: Families of rules; all rules abstain on a text without words.
FAMILIES: tuple[tuple[Rule, ...], ...] = (
    (Rule("length", "n_words < 20", "n_words < 50", "n_words >= 50"),),
    (Rule("word_size", "word_chars not between 2 * n_words and 20 * n_words", "word_chars not between 3 * n_words and 12 * n_words", "word_chars <= 9 * n_words"),),
    (
        Rule("symbols", "3 * n_symbols > n_words", "20 * n_symbols > n_words", "100 * n_symbols <= n_words"),
        Rule("marks", "4 * n_marks > n_words", "20 * n_marks > n_words", "100 * n_marks <= n_words"),
    ),
    (
        Rule("lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines", "n_lines >= 4 and 5 * n_dup_lines > n_lines", "n_dup_lines = 0"),
        Rule("repeats", "10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words > n_words", "20 * n_repeat_words <= n_words"),
    ),
    (
        Rule("capitals", "10 * n_upper > 3 * word_chars", "10 * n_upper > word_chars", "20 * n_upper <= word_chars"),
        Rule("shouting", "10 * n_exclaim > 3 * n_words", "20 * n_exclaim > n_words", "100 * n_exclaim <= n_words"),
    ),
    (
        Rule("stops", "200 * n_stops < n_words", "50 * n_stops < n_words", "20 * n_stops >= n_words"),
        Rule("ends", "100 * n_ends < n_words", "50 * n_ends < n_words", "25 * n_ends >= n_words"),
    ),
)

#: Prior: the share of good texts; how much likelier a vote is in prose for each step of its mean (as a power of e); and
#: what the prior counts for, as a share of the texts (so that the estimate is the same at every size of the corpus).
PRIOR_GOOD, LEAN, STRENGTH = 0.8, 3.0, 0.05


def vote(rule: Rule) -> Column:
    return F.expr(f"case when n_words = 0 then 0 when {rule.hard} then -2 when {rule.soft} then -1 when {rule.good} then 1 else 0 end").alias(f"v_{rule.name}")


def code_of(votes: tuple[int, ...]) -> int:
    """The place of a family's joint vote in the tables of shares."""
    code = 0
    for v in votes:
        code = len(VOTES) * code + v - VOTES[0]
    return code


def _leaning(rules: int, lean: float) -> np.ndarray:
    """Shares of a family's joint votes that grow with the mean vote."""
    weight = np.exp([lean * sum(t) / rules for t in product(VOTES, repeat=rules)])
    return weight / weight.sum()


@dataclass
class VoteModel:
    """Shares of the classes (the first is good, then one kind of junk for each family), and in each the shares of each family's joint votes."""

    share: np.ndarray
    #: given[family][class, code_of(joint vote)]
    given: list[np.ndarray]

    def posterior(self, votes: tuple[tuple[int, ...], ...]) -> float:
        """Probability of the good class given the joint vote of each family."""
        log = np.log(self.share) + sum(np.log(g[:, code_of(v)]) for g, v in zip(self.given, votes, strict=True))
        return float(1 / np.exp(log - log[0]).sum())


def prior_model(sizes: tuple[int, ...], good: float = PRIOR_GOOD, lean: float = LEAN) -> VoteModel:
    """What is held before any vote is seen.

    Prose votes lean to good.  A kind of junk leans to junk in its own family; in the
    others it looks like prose, but for one text in as many as there are families.
    """
    n = len(sizes)
    prose, junk = [_leaning(s, lean) for s in sizes], [_leaning(s, -lean) for s in sizes]
    given = [np.stack([p] + [j if kind == f else p + (j - p) / n for kind in range(n)]) for f, (p, j) in enumerate(zip(prose, junk, strict=True))]
    return VoteModel(np.array([good] + [(1 - good) / n] * n), given)


def fit(patterns: dict[tuple[tuple[int, ...], ...], int], sizes: tuple[int, ...], prior: VoteModel | None = None, strength: float = STRENGTH, rounds: int = 1000, tolerance: float = 1e-6) -> VoteModel:
    """Expectation-maximisation over the counts of vote combinations, from ``prior`` and with it.

    ``sizes`` are the numbers of rules in the families.  The prior of a class counts for
    ``strength`` of the texts that are in it, and as many as are expected to be.  A joint
    vote that no other family supports or denies carries no information on its class,
    so the prior decides it; all others are decided by the counts.  It ends when no
    share of a class moves by ``tolerance``, or after ``rounds``.
    """
    prior = prior or prior_model(sizes)
    total = sum(patterns.values())
    if not total:
        return prior
    combinations = sorted(patterns)
    n = np.array([patterns[v] for v in combinations], dtype=float)
    codes = np.array([[code_of(t) for t in v] for v in combinations])
    classes, worth = len(prior.share), strength * total
    model = prior
    for _ in range(rounds):
        log = np.log(model.share) + sum(np.log(g[:, codes[:, f]]).T for f, g in enumerate(model.given))
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        weight *= (n / weight.sum(axis=1))[:, None]
        mass = weight.sum(axis=0)
        pseudo = (strength * mass + worth * prior.share)[:, None]
        given = []
        for f, first in enumerate(prior.given):
            counts = np.stack([np.bincount(codes[:, f], weights=weight[:, c], minlength=first.shape[1]) for c in range(classes)])
            given.append((counts + pseudo * first) / (mass[:, None] + pseudo))
        share = (mass + worth * prior.share) / (total + worth)
        moved = float(np.abs(share - model.share).max())
        model = VoteModel(share, given)
        if moved < tolerance:
            break
    return model


def posterior_column(model: VoteModel, families: tuple[tuple[Rule, ...], ...]) -> Column:
    """``VoteModel.posterior`` of the vote columns: one look-up in an array of constants for each family and kind of junk."""
    against = F.lit(0.0)
    for kind in range(1, len(model.share)):
        log = F.lit(float(np.log(model.share[kind] / model.share[0])))
        for f, family in enumerate(families):
            code = F.lit(0)
            for rule in family:
                code = code * len(VOTES) + F.col(f"v_{rule.name}") - VOTES[0]
            log = log + F.get(F.array(*[F.lit(float(x)) for x in np.log(model.given[f][kind] / model.given[f][0])]), code)
        against = against + F.exp(log)
    return 1 / (1 + against)


OWN = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def judge(docs: DataFrame, keep: tuple[str, ...] = (), threshold: float = 0.5, families: tuple[tuple[Rule, ...], ...] = FAMILIES, strength: float = STRENGTH) -> DataFrame:
    """Figures, base verdict, posterior probability of good quality and the verdict of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, quality (the posterior), the votes, and the columns in
    ``keep``.  The only shuffle is that of the vote counts.  The figures are computed
    once and written, with the columns in ``keep``, to the shared folder.  ``kept`` is
    false where base_failed (n_words < 50, or more than half of the words in repeated
    windows), else whether the posterior reaches ``threshold``.

    A null or empty text has no words, all rules abstain and it fails by its length.
    Texts of any length are judged whole.  Each input row gives one row, also where
    rows repeat; null ids come back as null.  No documents: no rows.  Columns that
    aren't in ``keep`` are ignored; one in ``keep`` that has the name of a column of
    the result comes back as ``in_<name>``.
    """
    spark = docs.sparkSession
    rules = [r for family in families for r in family]
    votes = [f"v_{r.name}" for r in rules]
    voted = written(spark, features(docs, keep), "quality").select("*", *[vote(r) for r in rules])
    patterns: dict[tuple[tuple[int, ...], ...], int] = {}
    for row in voted.groupBy(*votes).agg(F.count("*").alias("n")).collect():
        seen = iter(row)
        patterns[tuple(tuple(next(seen) for _ in family) for family in families)] = row["n"]
    model = fit(patterns, tuple(map(len, families)), strength=strength)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = voted.withColumn("quality", posterior_column(model, families)).withColumn("base_failed", failed)
    kept = [F.col("_kept").getField(c).alias(name) for c, name in beside(keep, (*OWN, *votes)).items()]
    return scored.select(doc_out(), *OWN[1:7], (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), "quality", *votes, *kept)
