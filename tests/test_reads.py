"""How often a step reads what it is given."""

import pytest
from pyspark.sql import functions as F

from staffscope.checks import lifecycle
from staffscope.operators import corpus as corpus_ops, derive
from staffscope.plans import derive as derive_plan


@pytest.fixture
def counted(spark):
    """A DataFrame as it comes, and how many of its rows were made."""
    def make(df):
        made = spark.sparkContext.accumulator(0)

        def rows(batches):
            for batch in batches:
                made.add(len(batch))
                yield batch
        return df.mapInPandas(rows, df.schema), made
    return make


def test_constraints_read_a_table_once(spark, counted):
    term, made = counted(spark.createDataFrame([("a", "a", None, False), ("b", "a", "x", True), ("b", "b", "b", False), (None, None, None, None)],
                                               "word string, canonical string, parent string, excluded boolean"))
    found = {(row.table, row.constraint): row.violations for row in corpus_ops.check_constraints({"term": term}).collect()}
    assert found == {("term", "parent_on_canonical"): 2, ("term", "excluded_alone"): 2, ("term", "key"): 1, ("term", "parent in term"): 1}
    assert made.value == 4


def test_texts_of_an_answer_go_to_python_in_one_call(spark):
    """And a word is found in the list of its answer: no window deals or sorts single words."""
    wide = '{"items":[{"text":"Ｇｏ","depth":"做过"},{"text":"go；","depth":null},{"text":"Go","depth":"主导"}]}'
    answers = spark.createDataFrame([("s", "", wide), ("s", "", wide), ("t", "ｇ", '{"items":[]}'), ("u", None, "[1]"), ("v", "", '{"items"'), (None, "", wide)],
                                    "experience_id string, company string, answer string")
    found = derive.conform_extractions(answers)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Window" not in plan
    got = sorted((row.experience_id or "", [tuple(item) for item in row["items"]]) for row in found.collect())
    assert got == [("", []), ("s", [("Go", "主导"), ("go", None)]), ("s", [("Go", "主导"), ("go", None)]), ("t", [])]


@pytest.mark.parametrize("ready, last", [(30, "039"), (95, "099")])
def test_a_slice_starts_at_the_first_segment_without_a_result(spark, counted, ready, last):
    """What has its results before that is not compared with them row by row once more."""
    left, _ = counted(spark.range(ready, 100).select(F.format_string("%03d", "id").alias("id")))
    rows, until = derive_plan.next_slice(left, None, 10)
    assert until == last and sorted(row.id for row in rows.collect()) == [f"{n:03d}" for n in range(ready, int(last) + 1)]
    assert f">= {ready:03d}" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_segments_that_lie_in_parts_are_not_dealt_before_they_arrive(spark, monkeypatch, tmp_path):
    segments = spark.range(0, 100, 1, 8).selectExpr(
        *[f"cast(id as string) as {c}" for c in ("id", "kind", "title", "seq_l1", "seq_l2", "seq_l3", "description")], "false as unemployed")

    def dealt(*_):
        raise AssertionError("rows are dealt")
    monkeypatch.setattr(type(segments), "repartition", dealt)
    lifecycle._arriving(spark, segments, str(tmp_path / "in"), 2)
    assert spark.read.parquet(str(tmp_path / "in")).count() == 200
