"""Quality by weak supervision: rules vote or abstain, expectation maximisation weighs them.

Each rule looks at one property of a document and votes good, bad or abstains; rules err, on good documents too. How
reliable each rule is comes from the documents, without labels: an expectation-maximisation over the vote patterns
estimates, per rule, how often it votes good or bad on either kind of document. The posterior probability of good quality
replaces a list of filters that all have to pass: a document with a bad vote stays where the other rules outweigh it.
Two base limits of the caller fail a document whatever the posterior, and what they fail teaches nothing.

Scale: texts are read once and stay where they are; only numbers leave the task. The patterns are counted with a
map-side combine: there are at most 3**rules of them (`PATTERNS`), which bounds what the estimation sees, on the driver,
whatever the corpus. The posterior is an expression again, evaluated in place.

Cases: null text has no words and fails the base limit; blank texts too; a rule without enough to judge by abstains; a
document on which every rule abstains has the prior as its posterior; repeated rows count as rows; an empty table gives
an empty result (the estimates stay at their start); other columns pass through `keep_good` untouched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import boxed, whole

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stutter", "n_stops", "n_letters")
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS, UPPER, STOPS = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:"
_SPACES = " \t\n\x0b\x0c\r"
_EVERY = bytes(range(256))
#: ASCII letters and the first byte of every longer character.
LETTERS = UPPER + UPPER.lower() + bytes(range(0xC0, 0x100))
_BUT = {marks: bytes(set(_EVERY) - set(marks)) for marks in (SYMBOLS, UPPER, STOPS, LETTERS)}


def text_stats(text: str) -> tuple[int, ...]:
    """The numbers of `STATS` of one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # ASCII white space only
    if not words:
        return (0,) * len(STATS)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    symbols, upper, stops, letters = (len(data.translate(None, _BUT[marks])) for marks in (SYMBOLS, UPPER, STOPS, LETTERS))
    return (len(words), len(text) - sum(map(text.count, _SPACES)), symbols, dup, repeated_words(words), lines, upper,
            sum(map(eq, words, islice(words, 1, None))), stops, letters)


def repeated_words(words: list[bytes]) -> int:
    """Words inside any window of five words that the text holds twice or more."""
    if len(words) <= WINDOW:
        return 0
    windows = list(zip(*(words[at:] for at in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    often = {window for window, times in Counter(windows).items() if times > 1}
    marks = np.zeros(len(words) + 1, np.int64)
    for at, window in enumerate(windows):
        if window in often:
            marks[at] += 1
            marks[min(at + WINDOW, len(words))] -= 1
    return int((np.cumsum(marks[:-1]) > 0).sum())


def stats(text: Column) -> Column:
    """A struct of `STATS` for each text, in the columns `text` comes from."""
    @F.arrow_udf(", ".join(f"{name} long" for name in STATS))
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = np.array([text_stats(t or "") for t in batch.to_pylist()], np.int64).reshape(-1, len(STATS))
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(column)) for column in rows.T], list(STATS))
    return of(text)


@dataclass(frozen=True)
class Rule:
    """Votes bad (0) where `bad` holds, else good (1) where `good` holds, else abstains (null). Predicates are SQL over
    the statistics."""

    name: str
    bad: str
    good: str

    @property
    def vote(self) -> Column:
        return F.when(F.expr(self.bad), 0).when(F.expr(self.good), 1)


RULES = (
    Rule("symbols", "n_symbols > 0.1 * n_words", "n_symbols <= 0.01 * n_words"),
    Rule("letters", "n_words >= 20 AND n_letters < 0.92 * word_chars", "n_letters >= 0.95 * word_chars"),
    Rule("capitals", "n_words >= 30 AND n_upper > 0.03 * word_chars", "n_upper < 0.025 * word_chars"),
    Rule("lines", "n_dup_lines > 0.1 * n_lines", "n_lines >= 3 AND n_dup_lines = 0"),
    Rule("repeats", "n_repeat_words > 0.04 * n_words", "n_words >= 50 AND n_repeat_words = 0"),
    Rule("stutter", "n_stutter > 0.02 * n_words", "n_words >= 50 AND n_stutter < 0.008 * n_words"),
    Rule("length", "n_words >= 30 AND word_chars NOT BETWEEN 4.5 * n_words AND 6 * n_words", "word_chars BETWEEN 4.6 * n_words AND 5.8 * n_words"),
    Rule("stops", "n_words >= 50 AND n_stops NOT BETWEEN 0.085 * n_words AND 0.22 * n_words", "n_words >= 50 AND n_stops BETWEEN 0.1 * n_words AND 0.19 * n_words"),
)
BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"


@dataclass(frozen=True)
class Model:
    """`prior`: share of good documents. Per rule the chance of a bad vote, where it votes, on a good and on a bad document."""

    prior: float
    bad_on_good: tuple[float, ...]
    bad_on_bad: tuple[float, ...]

    def weights(self) -> list[tuple[float, float]]:
        """Per rule what a bad and what a good vote adds to the log-odds of good quality."""
        return [(math.log(g / b), math.log((1 - g) / (1 - b))) for g, b in zip(self.bad_on_good, self.bad_on_bad)]

    def posterior(self, rules: tuple[Rule, ...] = RULES) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule, (bad, good) in zip(rules, self.weights()):
            odds = odds + F.coalesce(F.when(rule.vote == 0, F.lit(bad)).when(rule.vote == 1, F.lit(good)), F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


#: Where the estimation starts: errors of a rule on good documents, its finds among bad ones, the share of good documents.
START_ON_GOOD, START_ON_BAD, START_PRIOR = 0.05, 0.4, 0.9
#: No rule is taken to be surer than this, whatever it was seen to do.
FLOOR = 0.01


def estimate(patterns: list[tuple[tuple[int | None, ...], int]], rules: int, rounds: int = 200, strength: float = 0.002) -> Model:
    """Expectation maximisation over (votes, number of documents).

    An abstention says nothing. Estimates lean on the start as if that had been seen on `strength` of all documents, and
    one more. A rule found to vote alike on good and bad documents weighs nothing, so its bad vote costs no document.
    """
    prior = START_PRIOR
    counts = np.array([n for _, n in patterns], float)
    votes = np.array([[np.nan if v is None else v for v in pattern] for pattern, _ in patterns], float).reshape(-1, rules)
    said_bad, said = votes == 0, ~np.isnan(votes)
    on_good, on_bad = np.full(rules, START_ON_GOOD), np.full(rules, START_ON_BAD)
    lean = strength * counts.sum() + 1
    for _ in range(rounds if len(patterns) else 0):
        odds = np.log(prior / (1 - prior)) + (np.where(said_bad, np.log(on_good / on_bad), 0)
                                              + np.where(said & ~said_bad, np.log((1 - on_good) / (1 - on_bad)), 0)).sum(axis=1)
        good = counts / (1 + np.exp(-odds))
        bad = counts - good
        on_good = np.clip((good @ said_bad + lean * START_ON_GOOD) / (good @ said + lean), FLOOR, 1 - FLOOR)
        on_bad = np.clip((bad @ said_bad + lean * START_ON_BAD) / (bad @ said + lean), FLOOR, 1 - FLOOR)
        prior = float(np.clip((good.sum() + lean * START_PRIOR) / (counts.sum() + lean), 0.5, 1 - FLOOR))
    return Model(prior, tuple(map(float, on_good)), tuple(map(float, on_bad)))


def fit(numbers: DataFrame, rules: tuple[Rule, ...] = RULES) -> Model:
    """The model of the rows of `numbers` (columns `STATS`) that the base limits leave. The driver gets a row per vote
    pattern, 3**rules at most."""
    votes = [rule.vote.alias(rule.name) for rule in rules]
    patterns = numbers.filter(f"NOT ({BASE_FAILED})").groupBy(*votes).count().collect()
    return estimate([(tuple(row)[:-1], row["count"]) for row in patterns], len(rules))


def judged(numbers: DataFrame, model: Model, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """`numbers` with base_failed, p_good and kept."""
    return (numbers.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("p_good", model.posterior(rules))
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """(doc_id, the base statistics, base_failed, p_good, kept) of each row."""
    numbers = cut_lineage(docs.select("doc_id", stats(whole()).alias("stats")).select("doc_id", "stats.*"))
    return judged(numbers, fit(numbers, rules), rules, threshold).select("doc_id", *STATS[:5], "base_failed", "p_good", "kept")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns. The statistics are made twice, for the model and for the
    verdict, which moves no text anywhere."""
    numbers = cut_lineage(docs.select(stats(whole()).alias("stats")).select("stats.*"))
    held = boxed(docs, stats=stats(whole())).select("doc", "stats.*")
    return judged(held, fit(numbers, rules), rules, threshold).filter("kept").select("doc.*")
