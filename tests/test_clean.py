"""Cleaning rules on literal rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from staffscope.functions.dates import duration_months, gap_months, parse_date
from staffscope.functions.text import contains_ci, literal_pattern, org_path, org_prefixes, tag, trim_unicode, words_in
from staffscope.operators import clean, segments

AS_OF = date(2025, 6, 30)


def values(df):
    return sorted(tuple(row) for row in df.collect())


@pytest.mark.parametrize("text,state,value", [
    ("", "absent", None), ("　", "absent", None), ("2024-02-29", "value", date(2024, 2, 29)), ("2024/03/01 00:00:00", "value", date(2024, 3, 1)),
    ("2024-03-01Tx", "value", date(2024, 3, 1)), ("2024-2-3", "invalid", None), ("2023-02-29", "invalid", None), ("2024-13-01", "invalid", None),
    ("2024-03-01x", "invalid", None), ("0099-01-01", "invalid", None), ("soon", "invalid", None)])
def test_parse_date(spark, text, state, value):
    row = spark.createDataFrame([(text,)], "t string").select(parse_date(F.col("t")).alias("d")).first()["d"]
    assert (row["state"], row["value"]) == (state, value)


def test_text_functions(spark):
    row = spark.createDataFrame([("﻿　 a b ", " A >  > B> ", "Ｇｏ　Lang，", "50%_off", "人才库里的词表")], "a string, p string, t string, l string, w string").select(
        trim_unicode("a").alias("a"), org_path(F.col("p")).alias("p"), tag(F.col("t")).alias("t"), contains_ci(F.col("l"), "%_O").alias("l"),
        contains_ci(F.col("l"), "5_%").alias("m"), words_in(F.col("w"), ["库里", "词表"], ["人才库"]).alias("w"), org_prefixes(F.lit("A>B>C")).alias("x")).first()
    assert row["a"] == "a b" and row["p"] == "A>B" and row["t"] == "Go Lang" and row["l"] and not row["m"]
    assert row["w"] == ["词表"] and row["x"] == ["A", "A>B", "A>B>C"]


@pytest.mark.parametrize("word,text,hit", [("Java", "JavaScript", False), ("Java", "java 开发", True), ("BI", "mobile", False), ("C++", "c++17", True),
                                           ("数据", "大数据平台", True), ("Go", "Go语言", True)])
def test_literal_pattern(spark, word, text, hit):
    assert spark.range(1).select(F.lit(text).rlike("(?iu)" + literal_pattern(word)).alias("h")).first()["h"] is hit


def test_duration_and_gap(spark):
    rows = spark.createDataFrame([(date(2024, 1, 1), date(2024, 1, 1)), (date(2024, 1, 1), date(2024, 12, 31)), (date(2020, 1, 31), None)], "s date, e date")
    got = rows.select(duration_months(F.col("s"), F.coalesce("e", F.lit(AS_OF))).alias("m"), gap_months(F.col("e"), AS_OF).alias("g")).collect()
    assert [tuple(r) for r in got] == [(1, 17), (12, 6), (65, 0)]


def _assignments(spark, rows):
    columns = "emp_id start_date end_date department department_path title level seq_l1 seq_l2 seq_l3 segment_key".split()
    full = [tuple({**dict.fromkeys(columns, ""), **row}[c] for c in columns) for row in rows]
    return spark.createDataFrame(full, ", ".join(f"{c} string" for c in columns))


def test_internal_rules_apply_in_order(spark):
    df = _assignments(spark, [
        {"emp_id": "1", "start_date": "bad"}, {"emp_id": "1", "start_date": "", "end_date": "2024-01-01"},
        {"emp_id": "1", "start_date": "2026-01-01", "end_date": "2025-01-01"}, {"emp_id": "1", "start_date": "2024-01-01", "end_date": "2026-01-01"},
        {"emp_id": "1", "start_date": "2024-01-02", "end_date": "2024-01-01"}, {"emp_id": "1", "start_date": "2024-01-01", "end_date": ""}])
    good, bad = clean.clean_internal(df, AS_OF)
    assert values(bad) == sorted([("invalid_date", 1), ("missing_start", 1), ("start_in_future", 1), ("end_in_future", 1), ("inverted", 1)])
    assert good.count() == 1


def test_external_open_end_closes_at_hire(spark):
    columns = "emp_id start_date end_date company title description company_tag nature".split()
    df = spark.createDataFrame([("1", "2020-01-01", "", "C", "t", "d", "", "", True), ("2", "2020-01-01", "", "C", "t", "d", "A", "", False),
                                ("1", "2020-01-01", "2021-02-01", "C", "t", "d", "", "", False)],
                               ", ".join(f"{c} string" for c in columns) + ", unemployed boolean")
    hires = spark.createDataFrame([("1", date(2021, 1, 1)), ("2", None)], "emp_id string, hire_date date")
    good, bad = clean.clean_external(df, hires, AS_OF)
    row = good.first()
    assert (row["title"], row["description"], row["end_date"], row["company_meta"]) == ("待业", "", date(2021, 1, 1), None)
    assert values(bad) == [("end_after_hire", 1), ("no_end_and_no_hire_date", 1)]


def test_merge_adjacent(spark):
    row = lambda key, start, end: {"emp_id": "1", "segment_key": key, "title": "t", "start_date": start, "end_date": end}
    df, _ = clean.clean_internal(_assignments(spark, [
        row("k", "2024-01-01", "2024-01-31"), row("k", "2024-02-01", "2024-02-10"), row("k", "2024-02-05", "2024-02-06"),  # touch, overlap
        row("k", "2024-02-12", "2024-03-01"),  # a day apart from the 10th
        row("k", "2025-01-01", ""), row("k", "2025-03-01", "2025-04-01"),  # open swallows what follows
        row("", "2024-01-01", "2024-01-31"), row("", "2024-01-01", "2024-01-31")]), AS_OF)
    got = values(segments.merge_adjacent(df, AS_OF).select("segment_key", F.col("start_date").cast("string"), F.col("end_date").cast("string"), "rows"))
    assert got == sorted([("k", "2024-01-01", "2024-02-10", 3), ("k", "2024-02-12", "2024-03-01", 1), ("k", "2025-01-01", None, 2),
                          ("", "2024-01-01", "2024-01-31", 1), ("", "2024-01-01", "2024-01-31", 1)], key=str) or \
        sorted(got, key=str) == sorted([("k", "2024-01-01", "2024-02-10", 3), ("k", "2024-02-12", "2024-03-01", 1), ("k", "2025-01-01", None, 2),
                                        ("", "2024-01-01", "2024-01-31", 1), ("", "2024-01-01", "2024-01-31", 1)], key=str)


def test_revisions(spark):
    d = date
    rows = [("a", d(2024, 1, 1), d(2024, 6, 30), "B", d(2024, 7, 1)), ("a", d(2024, 1, 1), d(2024, 6, 30), "A", d(2024, 7, 9)),  # latest wins
            ("b", d(2024, 1, 1), d(2024, 6, 30), "B", None), ("b", d(2024, 1, 1), d(2024, 6, 30), "A", d(2024, 7, 9)),  # one is undated
            ("c", d(2024, 1, 1), d(2024, 6, 30), "B", d(2024, 7, 9)), ("c", d(2024, 1, 1), d(2024, 6, 30), "A", d(2024, 7, 9)),  # tie
            ("e", d(2024, 1, 1), d(2024, 6, 30), "B", None), ("e", d(2024, 1, 1), d(2024, 6, 30), "B", None),  # exact repeat
            ("f", d(2024, 1, 1), None, "B", None)]
    df = spark.createDataFrame([(e, "s", s, t, v, r) for e, s, t, v, r in rows],
                               "emp_id string, stream string, period_start date, period_end date, value string, recorded_at date")
    kept, report = clean.dedup_revisions(df)
    assert values(kept.select("emp_id", "value")) == [("a", "A"), ("e", "B"), ("f", "B")]
    assert tuple(report.first()) == (3, 2)


def test_contradicting_levels_refuse_the_run(spark):
    df = spark.createDataFrame([("P6", "senior", "3"), ("P6", "junior", "2")], "level string, band string, rank string")
    with pytest.raises(clean.CorpusError, match="level_in_two_bands"):
        clean.level_bands(df)
    with pytest.raises(clean.CorpusError, match="incomplete"):
        clean.level_bands(spark.createDataFrame([("P6", "senior", "03")], "level string, band string, rank string"))
