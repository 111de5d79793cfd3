"""Get-or-compute caches, extraction answers, reading batches and scope on small rows."""

import pandas as pd
from pyspark.sql import functions as F

from staffscope.operators import derive, reading, scope


def test_only_missing_texts_are_asked_once(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "text string")
    cache = texts.filter("text = 'a'").select(F.lit("v1").alias("identity"), derive.text_sha(F.col("text")).alias("text_sha"), F.lit("old").alias("payload"))

    def answer(batches):
        for rows in batches:
            yield rows.assign(payload=[None if t == "c" else f"new {t}" for t in rows["text"]])

    answers, fresh = derive.cached_answers(texts, cache, "v1", answer)
    assert {r["text"]: r["payload"] for r in answers.collect()} == {"a": "old", "b": "new b", "c": None}
    assert [r["payload"] for r in fresh.collect()] == ["new b"]
    assert {r["payload"] for r in derive.cached_answers(texts, cache, "v2", answer)[1].collect()} == {"new a", "new b"}


def test_vectors_of_another_size_are_asked_again(spark):
    texts = spark.createDataFrame([("a",), ("b",)], "text string")
    cache = texts.select(F.lit("m").alias("identity"), derive.text_sha(F.col("text")).alias("text_sha"),
                         F.when(F.col("text") == "a", F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(1.0))).cast("array<float>").alias("embedding"))

    def embed(batches):
        for rows in batches:
            yield rows.assign(embedding=[[9.0, 9.0]] * len(rows))

    got = {r["text"]: list(r["embedding"]) for r in derive.cached_embeddings(texts, cache, "m", embed, 2)[0].collect()}
    assert got == {"a": [1.0, 2.0], "b": [9.0, 9.0]}


def test_reading_stops_at_the_thirtieth_word(spark):
    import json
    items = [{"text": f"w{n}", "depth": "提到"} for n in range(30)] + [{"text": "w0", "depth": "主导"}, {"text": "late", "depth": "主导"}]
    early = [{"text": "w0", "depth": "做过"}, {"text": "w0", "depth": "主导"}, {"text": "ＡＣＭＥ labs", "depth": "主导"}, {"text": "x" * 17}]
    rows = [("long", "", json.dumps({"items": items})), ("early", "ACME", json.dumps({"items": early})), ("text", "", json.dumps({"items": "Python"})), ("bad", "", "[1")]
    df = spark.createDataFrame(rows, "experience_id string, company string, answer string")
    got = {r["experience_id"]: [(i["text"], i["engagement"]) for i in r["items"]] for r in derive.conform_extractions(df).collect()}
    assert len(got["long"]) == 30 and got["long"][0] == ("w0", "提到") and got["early"] == [("w0", "主导")]
    assert got["text"] == [] and "bad" not in got


def test_batches_keep_within_bytes(spark):
    rows = [(0, 0, n, f"s{n}", "x" * size) for n, size in enumerate([10, 10, 500, 10, 10], 1)]
    df = spark.createDataFrame(rows, "cond int, batch long, n int, id string, text string")
    parts = {r["id"]: r["part"] for r in reading.pack_by_bytes(df, 160, {0: 40}).collect()}
    assert parts == {"s1": 0, "s2": 0, "s3": 1, "s4": 2, "s5": 2}
    tight = {r["id"]: r["part"] for r in reading.pack_by_bytes(df, 160, {0: reading.request_head("x" * 60, "y" * 40)}).collect()}
    assert tight == {"s1": 0, "s2": 1, "s3": 2, "s4": 3, "s5": 4}


def test_scope_uses_whole_levels(spark):
    people = spark.createDataFrame([("1", "A>B"), ("2", "A>BC"), ("3", "A"), ("4", "")], "emp_id string, cur_dept_path string")
    accounts = spark.createDataFrame([("u", "A > B"), ("v", "A"), ("v", "A>B"), ("w", " > "), ("w", "A")], "user_id string, org_path string")
    scopes = scope.normalise_scopes(accounts)
    assert sorted(tuple(r) for r in scopes.collect()) == [("u", "A>B"), ("v", "A")]
    members = scope.scope_members(people, scopes)
    assert sorted(tuple(r) for r in members.collect()) == [("u", "1"), ("v", "1"), ("v", "2"), ("v", "3")]
    assert scope.visible(people, scopes, "nobody").isEmpty() and scope.visible(people, scopes, None).count() == 4
    seen = scope.visible(people, scopes, "u")
    assert scope.all_visible(seen, ["1", "1"]) and not scope.all_visible(seen, ["1", "2"])


def test_bad_items_of_an_answer_are_dropped_alone(spark):
    said = ['{"items":[{"text":5},{"text":"Go"}]}', '{"items":[{"text":{"a":1}}]}', '{"items":["Python",{"text":"Go","depth":3}]}', '{"items":7}', '[1]', 'no', '{}']
    df = spark.createDataFrame([(str(n), "", text) for n, text in enumerate(said)], "experience_id string, company string, answer string")
    got = {r["experience_id"]: [(i["text"], i["engagement"]) for i in r["items"]] for r in derive.conform_extractions(df).collect()}
    assert got == {"0": [("Go", None)], "1": [], "2": [("Go", None)], "3": [], "6": []}
