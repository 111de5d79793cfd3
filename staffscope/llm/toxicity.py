"""Toxicity by a learned lexicon in a trie, misspellings by Levenshtein automata, and the context of each hit.

The lexicon holds words and stems (a stem matches every word that starts with it) that labelled toxic documents use far
more often than chance allows. The automaton of all words within a term's number of edits is intersected with the trie:
a state is a set of (trie node, edits so far), made when first reached and remembered, so reading a word costs a lookup
per letter and most words end after a few. Characters that look like a letter are read as it without an edit. Each hit is
judged in a window of words around it: quoted or reported, turned at somebody, or plain. What a term counts for, per
number of edits, and what each context counts for, is learned from the labels; misspellings nobody labelled inherit a
part of their term's weight, and those that clean documents use lose it.

Scale: at most `SAMPLE` labelled rows, chosen by a hash, are learned from; they are sent to the documents (12 bytes each,
a proven bound), so no text is shuffled. Words are counted by Spark; the driver gets at most `CANDIDATES` terms and
the counts of evidence levels. Every document is scored in place, whole. The model holds at most `TERMS` terms.

Copies are not evidence of their own: of texts with one min-hash of five-word shingles, one teaches.

Cases: labels that are null or of a null `doc_id` teach nothing, a document labelled twice is toxic if one label says so,
and of documents with one `doc_id` one teaches; null and empty texts have no evidence and score the base rate; rows
without `doc_id` are scored, not held out; repeated rows are scored alike; without labels there are no terms, and every
document gets the same low score; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import whole

#: Labelled rows learned from, terms looked at and kept, and lengths of stems.
SAMPLE, CANDIDATES, TERMS, STEMS = 20_000, 20_000, 2_000, (3, 4, 5, 6, 7)
THRESHOLD, SEED, LEAST, GATHERED, SHINGLE = 0.3, 11, 3, 1_000_000, 5
#: Words on either side of a hit, and the strongest evidence of a context.
WINDOW, STRONGEST = 6, 12.0
#: Share of a term's weight that the next edit inherits where no label says more.
INHERITED = 0.75
PLAIN, DIRECTED, QUOTED = range(3)

_WORD = re.compile(r"[\w@$*]+")
#: Characters that are read as a letter.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Quotation marks that open and that close, words that report somebody's speech, words that address somebody.
OPENING, CLOSING = "\"“„«‘", "\"”“»’"
REPORTING = frozenset("said says wrote called calls quote quoted word term sagte schrieb wort zitat dit écrit mot dijo escribió palabra".split())
ADDRESS = frozenset("you your youre du dich dein ihr tu te toi vous usted eres".split())


def edits(term: str, stem: bool) -> int:
    """How many edits a term allows."""
    return int(len(term) >= 6) if stem else (len(term) >= 5) + (len(term) >= 9)


class Matcher:
    """The lexicon trie and the automaton over it; `find` gives (edits, -length, term) of the nearest, longest term."""

    DEAD, REMEMBERED = 1, 50_000

    def __init__(self, terms: Sequence[tuple[str, bool]]):
        self._lengths = [len(term) for term, _ in terms]
        self._allowed = [edits(term, stem) for term, stem in terms]
        self._children: list[dict[str, int]] = [{}]
        self._word, self._stem, self._room = [-1], [-1], [0]
        for number, (term, stem) in enumerate(terms):
            node = 0
            self._room[0] = max(self._room[0], self._allowed[number])
            for letter in term:
                if letter not in self._children[node]:
                    self._children[node][letter] = len(self._children)
                    self._children.append({})
                    self._word.append(-1)
                    self._stem.append(-1)
                    self._room.append(0)
                node = self._children[node][letter]
                self._room[node] = max(self._room[node], self._allowed[number])
            (self._stem if stem else self._word)[node] = number
        self._forget()

    def _forget(self) -> None:
        self._names: dict[frozenset, int] = {}
        self._sets, self._steps, self._ends, self._stems = [], [], [], []
        self._name(self._skipping({0: 0}))
        if not self._children[0]:
            self._sets[0] = {}
        self._name({})  # DEAD

    def _skipping(self, state: dict[int, int]) -> dict[int, int]:
        """Letters of a term that the word leaves out."""
        open_nodes = list(state)
        while open_nodes:
            node = open_nodes.pop()
            done = state[node] + 1
            for child in self._children[node].values():
                if done <= self._room[child] and done < state.get(child, 99):
                    state[child] = done
                    open_nodes.append(child)
        return state

    def _name(self, state: dict[int, int]) -> int:
        key = frozenset(state.items())
        if key not in self._names:
            self._names[key] = len(self._sets)
            self._sets.append(state)
            self._steps.append({})
            for at, out in ((self._word, self._ends), (self._stem, self._stems)):
                out.append(min(((done, -self._lengths[at[node]], at[node]) for node, done in state.items()
                                if at[node] >= 0 and done <= self._allowed[at[node]]), default=None))
        return self._names[key]

    def _step(self, state: int, letter: str) -> int:
        read = letter + LOOKALIKES.get(letter, "")
        found: dict[int, int] = {}
        for node, done in self._sets[state].items():
            if done < self._room[node] and done + 1 < found.get(node, 99):
                found[node] = done + 1  # a letter too many
            for other, child in self._children[node].items():
                cost = done + (other not in read)
                if cost <= self._room[child] and cost < found.get(child, 99):
                    found[child] = cost
        return self._name(self._skipping(found)) if found else self.DEAD

    def find(self, word: str) -> tuple[int, int, int] | None:
        if len(self._sets) > self.REMEMBERED:
            self._forget()
        state, best, steps, stems = 0, None, self._steps, self._stems
        for letter in word:
            after = steps[state].get(letter)
            if after is None:
                after = steps[state][letter] = self._step(state, letter)
            state = after
            if state == 1:
                return best
            stem = stems[state]
            if stem is not None and (best is None or stem < best):
                best = stem
        end = self._ends[state]
        return end if end is not None and (best is None or end < best) else best


def context(text: str, words: list[re.Match], at: int) -> int:
    """Whether the hit at word `at` is quoted or reported, turned at somebody, or neither."""
    first, last = max(0, at - WINDOW), min(len(words) - 1, at + WINDOW)
    start, end = words[at].span()
    before, after = text[words[first].start():start], text[end:words[last].end() + 1]
    opened = any(mark in before for mark in OPENING) or text[max(0, words[first].start() - 1):words[first].start()] in (*OPENING,)
    if opened and any(mark in after for mark in CLOSING):
        return QUOTED
    if any(words[n].group() in REPORTING for n in range(max(0, at - 3), at)):
        return QUOTED
    near = range(max(0, at - 3), min(len(words), at + 4))
    return DIRECTED if any(words[n].group() in ADDRESS for n in near) or after[:1] == "!" else PLAIN


def hits(text: str, matcher: Matcher) -> list[tuple[int, int, int]]:
    """(term, edits, context) of each distinct word that is near a term, once per context it stands in."""
    text = text.lower()
    found = {}
    for word in set(_WORD.findall(text)):
        hit = matcher.find(word.strip("*_"))
        if hit is not None:
            found[word] = hit
    if not found:
        return []
    words = list(_WORD.finditer(text))
    met = dict.fromkeys((m.group(), context(text, words, at)) for at, m in enumerate(words) if m.group() in found)
    return [(found[word][2], found[word][0], where) for word, where in met]


@dataclass(frozen=True)
class Model:
    """`terms`: (letters, whether a stem). `weights`: per term, what it counts for with 0, 1 and 2 edits. `base` and `slopes`
    (per context) turn evidence into log-odds."""

    terms: tuple[tuple[str, bool], ...] = ()
    weights: tuple[tuple[float, float, float], ...] = ()
    base: float = -3.0
    slopes: tuple[float, float, float] = (1.0, 1.1, 0.25)

    def evidence(self, found: list[tuple[int, int, int]]) -> list[float]:
        """Per context what the words there count for."""
        sums = [0.0, 0.0, 0.0]
        for term, done, where in found:
            sums[where] += self.weights[term][done]
        return [min(value, STRONGEST) for value in sums]

    def probability(self, evidence: list[float]) -> float:
        return 1 / (1 + math.exp(-self.base - sum(slope * value for slope, value in zip(self.slopes, evidence))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most `sample` labelled documents that are not held out. Written once."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of a number and a label
    texts = (docs.select("doc_id", whole().alias("text")).join(F.broadcast(cut_lineage(chosen)), "doc_id").dropDuplicates(["doc_id"])
             .select("text", F.col("toxic").cast("int").alias("toxic")))
    return cut_lineage(texts.mapInArrow(_named_alike, "text string, toxic int, alike long").dropDuplicates(["alike"]).select("text", "toxic"))


def _named_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the least hash of their shingles: copies and most near copies have the same, so that a text told a
    hundred times does not teach its own words as if a hundred people had used them."""
    import xxhash
    for batch in batches:
        names = []
        for text in batch.column("text").to_pylist():
            words = text.lower().split()
            shingles = (" ".join(words[at:at + SHINGLE]) for at in range(max(1, len(words) - SHINGLE + 1)))
            names.append(min(xxhash.xxh64_intdigest(one.encode("utf-8", "surrogatepass"), SEED) for one in shingles) >> 1)
        yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic"), pa.array(names, pa.int64())], ["text", "toxic", "alike"])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label per word (ended by a line feed) and per stem."""
    counts = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        terms = list(counts[0].keys() | counts[1].keys())
        made = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([count[t] for t in terms], pa.int64()) for count in counts)],
                                          ["term", "clean", "toxic"])
        counts[0].clear(), counts[1].clear()
        return made
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            terms = set()
            for word in set(_WORD.findall(text.lower())):
                word = word.strip("*_")
                if STEMS[0] <= len(word) <= 30:
                    terms.add(word + "\n")
                    terms.update(word[:size] for size in STEMS if size <= len(word))
            counts[toxic > 0].update(terms)
            if len(counts[0]) + len(counts[1]) > GATHERED:
                yield out()
    yield out()


def lexicon(texts: DataFrame, toxic: int, clean: int, limit: int = TERMS) -> list[tuple[str, bool]]:
    """Terms that toxic documents use more often than chance allows, among all terms tested.

    A stem stays only where no single longer term explains most of its documents; a longer term only where no stem that
    stays says as much.
    """
    if not toxic or not clean:
        return []
    counts = cut_lineage(texts.mapInArrow(_count_terms, "term string, clean long, toxic long").groupBy("term")
                         .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.col("toxic") >= LEAST))
    share = toxic / (toxic + clean)
    number = F.col("toxic") + F.col("clean")
    p = F.col("toxic") / number
    # the chance of so many toxic ones among its documents is at most exp(-surprise)
    rest = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0)
    surprise = number * (p * F.log(p / share) + rest)
    tested = max(counts.count(), 1)
    found = (counts.withColumn("surprise", surprise).filter((p > share) & (F.col("surprise") > math.log(2 * tested)))
             .orderBy(F.desc("surprise"), "term").limit(CANDIDATES).collect())
    held = {row.term: (row.toxic, _weight(row.toxic / toxic, row.clean / clean, 1 / toxic, 0.5), row.surprise) for row in found}
    explained = Counter()
    for term, (number, _, _) in held.items():
        for size in STEMS:
            if size < len(term):
                explained[term[:size]] = max(explained[term[:size]], number)
    stays = {term for term, (number, _, _) in held.items() if term.endswith("\n") or explained[term] < 0.8 * number}

    def covered(term: str) -> bool:
        return any(size < len(term) and term[:size] in stays and held[term[:size]][1] >= held[term][1] - 0.7 for size in STEMS)
    kept = sorted((term for term in stays if not covered(term)), key=lambda term: (-held[term][2], term))[:limit]
    return [(term.rstrip("\n"), not term.endswith("\n")) for term in kept]


def _weight(toxic: float, clean: float, unit: float, prior: float) -> float:
    """Log-odds of a toxic document by the shares of either kind that hold a term; `unit` is the weight of the prior."""
    precision = (toxic + unit * prior) / (toxic + clean + unit)
    return max(0.0, min(8.0, math.log(precision / (1 - precision)))) if precision < 1 else 8.0


def weigh(found: DataFrame, terms: list[tuple[str, bool]], toxic: int, clean: int) -> list[tuple[float, float, float]]:
    """Per term and number of edits what it counts for, from (toxic, spellings: array of term * 3 + edits)."""
    rows = found.select("toxic", F.explode("spellings").alias("spelling")).groupBy("spelling", "toxic").count().collect()
    met = Counter({(row.spelling, row.toxic > 0): row["count"] for row in rows})
    out = []
    for number in range(len(terms)):
        weights, prior = [], 0.5
        for done in range(3):
            weights.append(_weight(met[number * 3 + done, True] / toxic, met[number * 3 + done, False] / clean, 1 / toxic, prior))
            prior = 1 / (1 + math.exp(-INHERITED * weights[-1]))
        out.append(tuple(weights))
    return out


def calibrate(levels: list[tuple[int, int, int, int, int]]) -> tuple[float, tuple[float, float, float]]:
    """Base and slopes by logistic regression over (evidence per context, toxic, number), leaning on a prior: quoted
    evidence counts little, directed evidence more, until labels say otherwise."""
    lean, spread = np.array([-3.0, 1.0, 1.1, 0.25]), np.array([2.0, 0.3, 0.3, 0.2])
    x = np.array([[1, *level[:3]] for level in levels], float).reshape(-1, 4)
    y, n = np.array([level[3] for level in levels], float), np.array([level[4] for level in levels], float)
    found = lean.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ found, -30, 30)))
        slope = x.T @ (n * (y - p)) - (found - lean) / spread ** 2
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(1 / spread ** 2)
        step = np.linalg.solve(curve, slope)
        found = found + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(found[0]), tuple(float(max(0.0, v)) for v in found[1:])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, given: Sequence[str] = ()) -> Model:
    """The model of the labelled documents that are not held out; `given` are words to know besides the learned ones."""
    texts = labelled(docs, labels, sample)
    count = {row.toxic: row["count"] for row in texts.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    toxic, clean = count.get(True, 0), count.get(False, 0)
    terms = lexicon(texts, toxic, clean)
    terms += [(word.lower(), False) for word in given if (word.lower(), False) not in terms]
    if not terms or not toxic or not clean:
        return Model()
    blank = Model(tuple(terms), ((0.0,) * 3,) * len(terms))
    found = cut_lineage(texts.mapInArrow(_met(blank), "toxic int, spellings array<int>, hits array<int>"))
    model = Model(blank.terms, tuple(weigh(found, terms, toxic, clean)))
    levels = found.mapInArrow(_levels(model), "a int, b int, c int, toxic int").groupBy("a", "b", "c", "toxic").count().collect()
    base, slopes = calibrate([tuple(row) for row in levels])
    return Model(model.terms, model.weights, base, slopes)


def _met(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms)
        for batch in batches:
            found = [hits(text, matcher) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                pa.array([int(toxic > 0) for toxic in batch.column("toxic").to_pylist()], pa.int32()),
                pa.array([sorted({term * 3 + done for term, done, _ in some}) for some in found], pa.list_(pa.int32())),
                pa.array([[(term * 3 + done) * 3 + where for term, done, where in some] for some in found], pa.list_(pa.int32()))],
                ["toxic", "spellings", "hits"])
    return run


def _levels(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[round(v) for v in model.evidence([(code // 9, code // 3 % 3, code % 3) for code in some])] for some in batch.column("hits").to_pylist()]
            columns = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([*(pa.array(column, pa.int32()) for column in columns), batch.column("toxic")], ["a", "b", "c", "toxic"])
    return run


def score(text: Column, model: Model) -> Column:
    """A struct of score, n_hits and n_quoted for each text."""
    @F.arrow_udf("score double, n_hits long, n_quoted long")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(model.terms)
        for batch in texts:
            found = [hits(text or "", matcher) for text in batch.to_pylist()]
            yield pa.StructArray.from_arrays([
                pa.array([model.probability(model.evidence(some)) for some in found], pa.float64()), pa.array([len(some) for some in found], pa.int64()),
                pa.array([sum(where == QUOTED for _, _, where in some) for some in found], pa.int64())], ["score", "n_hits", "n_quoted"])
    return of(text)


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_hits, n_quoted) of each row."""
    scored = docs.select("doc_id", score(whole(), model).alias("found"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.score",
                         (F.col("found.score") >= threshold).cast("int").alias("predicted"), "found.n_hits", "found.n_quoted")
