"""Toxicity: the automaton against edit distances, contexts, learning on made documents, held-out accuracy."""

import random
import zlib

import pytest

from staffscope.llm import toxicity
from staffscope.llm.queries import QUERIES


def distance(term, word):
    """Edits, where a letter that looks like another is that letter."""
    row = list(range(len(word) + 1))
    for i, x in enumerate(term, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(word, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x not in y + toxicity.LOOKALIKES.get(y, "")))
    return row[-1]


def plain_find(terms, word):
    found = []
    for number, (term, stem) in enumerate(terms):
        done = min(distance(term, word[:end]) for end in range(len(word) + 1)) if stem else distance(term, word)
        if done <= toxicity.edits(term, stem):
            found.append((done, -len(term), number))
    return min(found, default=None)


def test_automaton_is_the_edit_distance():
    rng = random.Random(2)
    terms = [("idiot", False), ("idle", False), ("worthless", False), ("scum", False), ("lowei", True), ("vermin", True), ("dios", False), ("réeux", True)]
    matcher = toxicity.Matcher(terms)
    words = ["", "i", "idiot", "1d10t", "idiiot", "diot", "worthles", "wrthlss", "$cum", "scums", "loweischaft", "verminous", "vrminous", "réeuxment"]
    for _ in range(4000):
        word = list(rng.choice(terms)[0] + rng.choice(["", "", "s", "schaft"]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            rng.choice([lambda: word.insert(at, rng.choice("abeiost1@")), lambda: word.pop(min(at, len(word) - 1)) if word else None,
                        lambda: word.__setitem__(min(at, len(word) - 1), rng.choice("abeiost0$")) if word else None])()
        words.append("".join(word))
    for word in words:
        assert matcher.find(word) == plain_find(terms, word), word
    assert toxicity.Matcher([]).find("idiot") is None


@pytest.mark.parametrize("text, want", [
    ("what an idiot that is", toxicity.PLAIN), ("you are an idiot", toxicity.DIRECTED), ("idiot! go", toxicity.DIRECTED),
    ('he said "what an idiot" and left', toxicity.QUOTED), ("she called them idiot", toxicity.QUOTED), ("„ein idiot“ stand da", toxicity.QUOTED),
    ('a "good" day, idiot', toxicity.PLAIN), ("idiot", toxicity.PLAIN), ("“you idiot”", toxicity.QUOTED)])
def test_context(text, want):
    assert [where for _, _, where in toxicity.hits(text, toxicity.Matcher([("idiot", False)]))] == [want]


def made(number, seed=1):
    """(doc_id, text, toxic): insults are words or share a stem."""
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ther", "ond", "ist", "ash", "ing", "ort") for b in ("er", "ing", "el", "ou", "est", "al")]
    bad = ["blorft", "skwander", *(f"grumph{end}" for end in ("er", "ing", "al", "ou", "est", "el", "on"))]
    for n in range(number):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        toxic = int(rng.random() < 0.2)
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        yield n, " ".join(words), toxic


@pytest.fixture(scope="module")
def learned(spark):
    rows = list(made(900))
    docs = spark.createDataFrame([(n, text, "x", 1) for n, text, _ in rows], "doc_id long, text string, found string, score int").repartition(4)
    labels = spark.createDataFrame([(n, toxic, 1) for n, _, toxic in rows] + [(None, 1, 1), (5, None, 0)], "doc_id long, toxic int, quality int")
    return rows, docs, labels, toxicity.fit(docs, labels)


def test_learns_words_and_stems(learned):
    rows, docs, _, model = learned
    assert dict(model.terms).get("blorft") is False and any(stem and term.startswith("grum") for term, stem in model.terms)
    assert sum(not "blorft skwander grumph".count(term) for term, _ in model.terms) <= 2
    got = {r.doc_id: r for r in toxicity.judge(docs, model).collect()}
    for n, _, toxic in rows:
        assert got[n].held_out == (zlib.crc32(str(n).encode()) % 4 == 2)
        assert 0 <= got[n].score <= 1 and got[n].predicted == (got[n].score >= 0.3)
    wrong = [n for n, _, toxic in rows if got[n].predicted != toxic]
    assert len(wrong) <= 9


def test_misspelt_and_quoted(spark, learned):
    model = learned[3]
    texts = ["these are blorft things", "these are bl0rft things", "these are blorfft things", 'he wrote "these are blorft things" then', "these are things", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0]), (0, texts[0])], "doc_id long, text string")
    rows = toxicity.judge(docs, model).collect()
    got = {r.doc_id: r for r in rows}
    assert [got[n].predicted for n in range(7)] == [1, 1, 1, 0, 0, 0, 0]
    assert got[0].score > got[3].score > got[4].score == got[5].score == got[6].score
    assert got[None].held_out is False and got[None].predicted == 1 and len(rows) == 9


def test_held_out_labels_and_other_columns_teach_nothing(spark, learned):
    rows, docs, _, model = learned
    flipped = spark.createDataFrame([(n, 1 - toxic if zlib.crc32(str(n).encode()) % 4 == 2 else toxic, 0) for n, _, toxic in rows], "doc_id long, toxic int, quality int")
    assert toxicity.fit(docs.withColumn("lang", docs.doc_id), flipped) == model


def test_nothing_to_learn_from(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    assert toxicity.judge(none, toxicity.fit(none, labels)).count() == 0
    assert len({(r.score, r.predicted) for r in toxicity.judge(docs, toxicity.fit(docs, labels)).collect()}) == 1
    given = toxicity.Model((("nitwit", False),), ((4.0, 3.0, 1.0),))
    assert [r.predicted for r in toxicity.judge(spark.createDataFrame([(1, "you n1twit")], "doc_id long, text string"), given).collect()] == [1]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op13_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit >= 0.9 * sum(r.toxic for r in got) and hit >= 0.95 * sum(r.predicted for r in got)
