"""Growing tables, derives that stop and go on, and stored answers."""

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from staffscope.operators import derive as ops
from staffscope.plans.derive import Derived, derive, derive_stored
from staffscope.schema import STORED
from staffscope.sources.answers import AnswerCache, checked_vectors
from staffscope.sources.store import Corpus, PublishConflict, publish


def segments(spark, versions):
    """One segment per version given (None: never derived): outside jobs with a description."""
    rows = [{f: None for f in STORED["experience"].names} | {
        "id": f"s{n:02d}", "emp_id": str(n % 3), "kind": "external", "unemployed": n % 7 == 6, "company": "Acme", "title": f"title {n % 4}",
        "seq_l1": "", "seq_l2": "", "seq_l3": "", "description": f"did {n}" if n % 2 else "", "months": 3, "content_key": f"s{n:02d}",
        "seq_inferred_l1": "", "seq_inferred_l2": "", "derived_identity": version, "unanswered": False} for n, version in enumerate(versions)]
    return spark.createDataFrame(rows, STORED["experience"])


def corpus_of(spark, versions):
    experience = segments(spark, versions)
    live = experience.filter("derived_identity is not null")
    phrase, edges = ops.build_dictionary(ops.phrases_of(live, spark.createDataFrame([], "experience_id string, items array<struct<text:string,engagement:string>>")))
    return Corpus({**{name: spark.createDataFrame([], schema) for name, schema in STORED.items()}, "experience": experience, "phrase": phrase, "experience_phrase": edges})


class Answers:
    """Extractions and alignments of segments; `fail_at` counts the calls that die."""

    def __init__(self, fail_at=()):
        self.asked, self.calls, self.fail_at = [], 0, fail_at

    def __call__(self, rows):
        self.calls += 1
        if self.calls in self.fail_at:
            raise ConnectionError("nobody answers")
        self.asked += [r.id for r in rows.select("id").collect()]
        items = F.array(F.struct(F.concat(F.lit("skill "), F.substring("id", 3, 1)).alias("text"), F.lit("主导").alias("engagement")))
        return (rows.filter("id < 's20'").select(F.col("id").alias("experience_id"), items.alias("items")),
                rows.filter("title <> 'title 3'").select(F.col("id").alias("experience_id"), F.lit("A").alias("seq_l1"), F.lit("B").alias("seq_l2")))


def state(corpus):
    return (sorted(map(tuple, corpus["experience"].select("id", "derived_identity", "seq_inferred_l1", "unanswered").collect())),
            sorted(map(repr, corpus["experience_phrase"].collect())), sorted(map(repr, corpus["phrase"].collect())))


def whole(spark, versions):
    """What one derive of everything gives."""
    corpus = corpus_of(spark, versions)
    return state(derive(corpus, *Answers()(corpus["experience"]), "v2"))


def test_a_table_that_grew_is_written_in_part(spark, tmp_path):
    root = str(tmp_path)
    publish(corpus_of(spark, ["v1", "v1"]), root)
    first = Corpus.at(spark, root)
    more = spark.createDataFrame([("p", "more")], "id string, text string")
    publish(first.grow(phrase=more.filter("id = 'p'")).grow(phrase=more.withColumn("id", F.lit("q"))), root)
    second = Corpus.at(spark, root)
    assert second.folders["phrase"][:1] == first.folders["phrase"] and len(second.folders["phrase"]) == 2
    assert second.folders["experience"] == first.folders["experience"]
    assert second["phrase"].count() == first["phrase"].count() + 2 == Corpus.at(spark, root, 1)["phrase"].count() + 2
    publish(second.grow(phrase=more).replace(phrase=more), root)  # replacing takes what grew along
    assert Corpus.at(spark, root)["phrase"].count() == 1
    with pytest.raises(PublishConflict):
        publish(first.grow(phrase=more), root)


def test_an_interrupted_derive_goes_on_where_it_was(spark, tmp_path):
    root, versions = str(tmp_path), ["v1"] * 12 + [None] * 8 + ["v2"] + ["v1"] * 4
    publish(corpus_of(spark, versions), root)
    live, answers = state(Corpus.at(spark, root)), Answers(fail_at=(3,))
    assert derive_stored(spark, root, "v2", answers, slice_rows=5, slices=1) == Derived(5, 19, True)
    with pytest.raises(ConnectionError):
        derive_stored(spark, root, "v2", answers, slice_rows=5)
    corpus = Corpus.at(spark, root)
    assert state(corpus)[:2] == live[:2]  # searches still read what they read
    assert corpus["experience_next"].count() == 10 and ops.underived(corpus["experience"], corpus["experience_next"], "v2").count() == 14
    assert derive_stored(spark, root, "v2", answers, slice_rows=5) == Derived(14, 0, False)
    assert sorted(answers.asked) == sorted(set(answers.asked)) and len(answers.asked) == 24  # nobody is asked twice
    done = Corpus.at(spark, root)
    want = whole(spark, versions)
    assert state(done) == want and done["experience_next"].isEmpty() and done["experience_phrase_next"].isEmpty()
    assert derive_stored(spark, root, "v2", Answers(fail_at=(1,))) == Derived(0, 0, False)


def test_without_another_standard_slices_go_live(spark, tmp_path):
    root, versions = str(tmp_path), [None] * 11 + ["v2"]
    publish(corpus_of(spark, versions), root)
    assert derive_stored(spark, root, "v2", Answers(), slice_rows=4, slices=2) == Derived(8, 3, False)
    half = Corpus.at(spark, root)
    assert half["experience"].filter("derived_identity = 'v2'").count() == 9 and half["experience_next"].isEmpty()
    assert derive_stored(spark, root, "v2", Answers(), slice_rows=4) == Derived(3, 0, False)
    assert state(Corpus.at(spark, root)) == whole(spark, versions)


def test_results_of_a_standard_nobody_waits_for_go(spark, tmp_path):
    root, versions = str(tmp_path), ["v1"] * 6
    publish(corpus_of(spark, versions), root)
    derive_stored(spark, root, "v9", Answers(), slice_rows=2, slices=2)
    assert derive_stored(spark, root, "v2", Answers(), slice_rows=4, slices=1) == Derived(4, 2, True)
    assert {r.derived_identity for r in Corpus.at(spark, root)["experience_next"].collect()} == {"v2"}
    derive_stored(spark, root, "v2", Answers())
    assert state(Corpus.at(spark, root)) == whole(spark, versions)


def test_segments_that_went_while_a_derive_waited(spark, tmp_path):
    root = str(tmp_path)
    publish(corpus_of(spark, ["v1"] * 6), root)
    derive_stored(spark, root, "v2", Answers(), slice_rows=4, slices=1)
    corpus = Corpus.at(spark, root)
    publish(corpus.replace(experience=corpus["experience"].filter("id not in ('s01', 's05')")), root)
    assert derive_stored(spark, root, "v2", Answers()) == Derived(1, 0, False)
    done = Corpus.at(spark, root)
    assert done["experience"].count() == 4
    assert done["experience_phrase"].join(done["experience"].select(F.col("id").alias("experience_id")), "experience_id", "left_anti").isEmpty()


def test_somebody_else_publishing_stops_a_derive(spark, tmp_path):
    root = str(tmp_path)
    publish(corpus_of(spark, ["v1"] * 6), root)

    def answer(rows):
        current = Corpus.at(spark, root)
        publish(current.replace(term=current["term"]), root)
        return Answers()(rows)
    with pytest.raises(PublishConflict):
        derive_stored(spark, root, "v2", answer, slice_rows=3)
    assert derive_stored(spark, root, "v2", Answers(), slice_rows=3) == Derived(6, 0, False)


# --- stored answers -------------------------------------------------------------------------------------------
def says(word, useless=()):
    def answer(batches):
        for rows in batches:
            yield rows.assign(answer=["?" if text in useless else None if text == "silent" else f"{word} {text}" for text in rows["text"]])
    return answer


def refuses():
    def answer(batches):
        for rows in batches:
            if len(rows):
                raise AssertionError(f"asked again: {list(rows['text'])}")
            yield rows.assign(answer=pd.Series([], dtype=object))
    return answer


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "text string")


def test_answers_outlive_the_session(spark, tmp_path):
    cache = AnswerCache(spark, str(tmp_path / "c"), buckets=4)
    got = lambda df: {r.text: r.answer for r in df.collect()}
    assert got(cache.ask(texts(spark, "a", "b", "b", None, "silent"), "m1", says("first"))) == {"a": "first a", "b": "first b", "silent": None}
    cache.close()
    again = AnswerCache(spark, str(tmp_path / "c"), buckets=4)
    assert got(again.ask(texts(spark, "a", "b"), "m1", refuses())) == {"a": "first a", "b": "first b"}
    assert got(again.ask(texts(spark, "a", "c"), "m1", says("second"))) == {"a": "first a", "c": "second c"}
    assert got(again.ask(texts(spark, "a"), "m2", says("other"))) == {"a": "other a"}
    again.close()


def test_the_cache_is_never_shuffled(spark, tmp_path):
    cache = AnswerCache(spark, str(tmp_path), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    cache.ask(texts(spark, *map(str, range(100))), "m", says("x"))
    asked = texts(spark, "1", "200").withColumn("digest", F.sha2("text", 256))
    for df, exchanges in ((cache.entries("m"), 0), (cache.look_up(asked, "m")[0], 1), (cache.look_up(asked, "m")[1], 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == exchanges and "Bucketed: true" in plan
    cache.close()


def test_first_write_wins_and_a_batch_replaces_itself(spark, tmp_path):
    cache = AnswerCache(spark, str(tmp_path), buckets=2)
    rows = lambda *pairs: spark.createDataFrame(pairs, "digest string, answer string")
    cache.write("m", rows(("a", "late")), "two", 20)
    cache.write("m", rows(("a", "early"), ("b", "lost")), "one", 10)
    cache.write("m", rows(("a", "early"), ("b", "kept")), "one", 10)
    cache.write("other", rows(("a", "else")), "one", 1)
    entries = lambda: {r.digest: r.answer for r in cache.entries("m").collect()}
    assert entries() == {"a": "early", "b": "kept"} and cache.stored("m").count() == 3
    cache.compact("m")
    assert entries() == {"a": "early", "b": "kept"} and cache.stored("m").count() == 2 and len(cache.batches("m")) == 1
    assert cache.batches("other") == ["one"]
    cache.compact("nobody")
    with pytest.raises(ValueError):
        cache.write("m", rows(), "../up")
    cache.close()


def test_answers_that_are_no_use_are_asked_again(spark, tmp_path):
    cache, valid = AnswerCache(spark, str(tmp_path), buckets=2), F.col("answer") != "?"
    got = lambda df: {r.text: r.answer for r in df.collect()}
    assert got(cache.ask(texts(spark, "a", "b"), "m", says("first", {"b"}), valid)) == {"a": "first a", "b": None}
    assert got(cache.ask(texts(spark, "a", "b"), "m", says("second"), valid)) == {"a": "first a", "b": "second b"}
    cache.compact("m", valid)
    assert {r.answer for r in cache.stored("m").collect()} == {"first a", "second b"}
    cache.close()


def test_vectors_of_another_size_are_asked_again(spark, tmp_path):
    cache = AnswerCache(spark, str(tmp_path), "array<float>", buckets=2)

    def embed(size):
        def answer(batches):
            for rows in batches:
                yield rows.assign(answer=[[float(len(text))] * size for text in rows["text"]])
        return answer
    cache.ask(texts(spark, "a", "bb"), "m", embed(2), checked_vectors(2))
    got = {r.text: r.answer for r in cache.ask(texts(spark, "a", "bb"), "m", embed(3), checked_vectors(3)).collect()}
    assert got == {"a": [1.0] * 3, "bb": [2.0] * 3}
    got = {r.text: r.answer for r in cache.ask(texts(spark, "a", "bb"), "m", refuses(), checked_vectors(2)).collect()}
    assert got == {"a": [1.0] * 2, "bb": [2.0] * 2}
    cache.close()


def test_a_derive_asks_through_the_cache(spark, tmp_path):
    """A slice that was answered and then lost is not asked again."""
    root, cache = str(tmp_path / "corpus"), AnswerCache(spark, str(tmp_path / "answers"), buckets=2)
    publish(corpus_of(spark, ["v1"] * 6), root)
    said, lost = says("v2"), []

    def answer(rows):
        told = cache.ask(rows.filter("description <> ''").select(F.col("description").alias("text")), "v2", said)
        if not lost:
            lost.append(True)
            raise ConnectionError("lost")
        items = F.array(F.struct(F.col("answer").alias("text"), F.lit("做过").alias("engagement")))
        read = rows.join(told, rows["description"] == told["text"]).select(F.col("id").alias("experience_id"), items.alias("items"))
        return read, rows.select(F.col("id").alias("experience_id"), F.lit("").alias("seq_l1"), F.lit("").alias("seq_l2"))
    with pytest.raises(ConnectionError):
        derive_stored(spark, root, "v2", answer)
    said = refuses()
    assert derive_stored(spark, root, "v2", answer) == Derived(6, 0, False)
    digest = hashlib.md5(b"v2 did 1").hexdigest()
    assert Corpus.at(spark, root)["experience_phrase"].filter((F.col("phrase_id") == digest) & (F.col("route") == "skill")).count() == 1
    cache.close()
