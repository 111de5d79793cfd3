"""Reading until nobody is open."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from staffscope.checks.search import CRITERION
from staffscope.operators.hits import criterion_key
from staffscope.plans import reading
from staffscope.plans.query import Condition, Query, Seek
from staffscope.plans.search import Search

SEGMENT = ("id string, emp_id string, kind string, start_date date, end_date date, months int, company string, company_tag string, main_industries array<string>, "
           "department string, title string, seq_l1 string, seq_l2 string, skills array<string>, content string")
PERSON = "emp_id string, level_band string, level_rank int, recruitment string, education string, education_rank int, school_tier string, overseas string"


def searched(spark, *conditions):
    day = date(2000, 1, 1)
    segments = [(f"s{n}", f"p{n % 4}", "external", day, None, 12, "c", None, None, None, "smith", None, None, [], f"s{n}") for n in range(9)]
    edges = [(f"s{n}", "skill", "w" if n % 3 else "a", None) for n in range(9)]
    views = {
        "experience": spark.createDataFrame(segments, SEGMENT),
        "person": spark.createDataFrame([(f"p{n}", "L1", n, None, None, None, None, None) for n in range(4)], PERSON),
        "edge": spark.createDataFrame(edges, "experience_id string, route string, phrase_id string, engagement string"),
        "phrase": spark.createDataFrame([("w", "widget"), ("a", "anvil")], "id string, text string"),
        "term": spark.createDataFrame([("widget", "widget"), ("anvil", "anvil")], "word string, canonical string")}
    edges = views["edge"].join(views["phrase"], F.col("phrase_id") == F.col("id")).drop("id")
    views["edge"] = edges.drop("text")
    none = spark.createDataFrame([], "criterion_key string, content string, fits boolean")
    return Search(views, Query(conditions), date(2002, 1, 1), none), views["experience"].select("id", "content", F.col("id").alias("text"))


def condition(word, mode):
    return Condition(word, word, mode, "experience", seek=Seek.words(word, criterion=CRITERION))


def judge(fits):
    return lambda criterion, texts: range(1, len(texts) + 1) if fits else []  # made here, so that workers get it by value


@pytest.mark.parametrize("fits", [False, True])
@pytest.mark.parametrize("modes, most", [(("must", "exclude"), 1), (("must", "boost"), 2)])
def test_rounds_end_with_what_is_open(spark, monkeypatch, fits, modes, most):
    """All that is open is read in a round, boosts in one more; none is spent to find nothing."""
    rounds, plan = [], reading.plan_batches
    monkeypatch.setattr(reading, "plan_batches", lambda *args: rounds.append(1) or plan(*args))
    search, texts = searched(spark, condition("widget", modes[0]), condition("anvil", modes[1]))
    said = reading.read_until_done(search, texts, judge(fits))
    assert len(rounds) <= most
    after = Search(search.views, search.query, search.now, said.filter(F.col("criterion_key") == criterion_key(CRITERION)))
    assert after.reading_list().count() == 0
    assert said.select("content").distinct().count() == said.count() > 0


def test_a_cap_goes_on_round_by_round(spark):
    search, texts = searched(spark, condition("widget", "must"), condition("anvil", "exclude"))
    assert reading.read_until_done(search, texts, judge(True), cap=2).count() == 2
    every = reading.read_until_done(search, texts, judge(True)).count()
    assert reading.read_until_done(search, texts, judge(True), cap=100).count() == every


def test_hits_keep_only_what_is_asked_of_them(spark):
    search, _ = searched(spark, condition("widget", "must"), condition("anvil", "exclude"))
    assert "content" not in search.segments.columns
    assert set(search.segments.columns) < {*search.all_facts.columns}


def test_the_reading_list_is_in_reading_order(spark):
    """Level first, no level last; then depth, person, condition and segment."""
    search, _ = searched(spark, condition("widget", "must"), condition("anvil", "must"))
    levels = {"p0": None, "p1": 2, "p2": 1, "p3": 2}
    depths = {"p0": 0.9, "p1": 0.1, "p2": 0.8, "p3": 0.5}
    rows = [(cond, f"s{n}", person, levels[person], depths[person]) for n, person in enumerate(["p0", "p1", "p2", "p3"] * 2) for cond in (1, 0)]
    search.pending = spark.createDataFrame(rows, "cond int, id string, emp_id string, level_rank int, depth double").withColumn("boost", F.lit(False))
    got = sorted(search.reading_list().collect(), key=lambda row: row.place)
    assert [row.place for row in got] == [*range(1, 17)]
    wanted = sorted(rows, key=lambda row: (row[3] is None, -(row[3] or 0), -row[4], row[2], row[0], row[1]))
    assert [(row.cond, row.id) for row in got] == [(row[0], row[1]) for row in wanted]
