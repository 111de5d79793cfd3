"""What keeps the work of the shared steps in proportion to the rows."""

from pyspark.sql import functions as F

from staffscope.checks import lifecycle
from staffscope.functions.text import nfkc
from staffscope.operators import companies, derive as ops
from staffscope.operators.catalog import experience_view
from staffscope.plans import derive
from staffscope.session import laid_by


def _companies(spark):
    raw = spark.createDataFrame([("Acme", "G")] * 5 + [("Bolt", "")], "name string, group_name string")
    owned = raw.select(F.col("name").alias("company"), F.lit("steel").alias("industry"), F.lit(True).alias("main"))
    circles = raw.select(F.col("name").alias("company"), F.lit("c").alias("circle"))
    above = spark.createDataFrame([("steel", "steel")], "name string, ancestor string")
    return companies.company_arrays(raw, owned, circles, above)


def test_a_company_told_several_times_is_one_row(spark):
    found = _companies(spark).orderBy("name").collect()
    assert [(r.name, r.group_name, r.industries) for r in found] == [("Acme", "G", ["steel"]), ("Bolt", "Bolt", ["steel"])]


def test_a_segment_meets_its_company_once(spark):
    row = ("s", "p", "external", False, "Acme")
    segment = spark.createDataFrame([row], "id string, emp_id string, kind string, unemployed boolean, company string").selectExpr(
        "*", "date'2000-01-01' as start_date", "date'2001-01-01' as end_date", "12 as months", "'' as department", "'' as department_path",
        "'t' as title", "'' as level", "'' as seq_l1", "'' as seq_l2", "'' as seq_inferred_l1", "'' as seq_inferred_l2",
        "cast(null as struct<company_tag:string,nature:string>) as company_meta", "'k' as content_key", "cast(null as string) as derived_identity")
    alias = spark.createDataFrame([("Acme", "Acme")], "raw_name string, company string")
    skills = spark.createDataFrame([], "id string, skills array<string>")
    assert [r["company_group"] for r in experience_view(segment, alias, _companies(spark), skills).collect()] == ["G"]


def test_edges_lie_where_the_links_were_joined(spark):
    segments = spark.createDataFrame([("s", "external", False, "t", "d")], "id string, kind string, unemployed boolean, title string, description string")
    segments = segments.selectExpr("*", "'' as seq_l1", "'' as seq_l2", "'' as seq_l3")
    read = spark.createDataFrame([("s", [("ring", "做过"), ("ring", "主导")])], "experience_id string, items array<struct<text:string,engagement:string>>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = ops.build_dictionary(ops.phrases_of(segments, read))[1]
        plan = edges._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # the two sides of the join, and no more
        assert {(r["route"], r["engagement"]) for r in edges.collect()} == {("title", None), ("skill", "主导")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_what_is_laid_by_segment_is_joined_where_it_lies(spark):
    segments = spark.createDataFrame([(i, "external", False, "t", "d") for i in ("s", "s", "u", None)], "id string, kind string, unemployed boolean, title string, description string")
    segment = laid_by(segments.selectExpr("*", "'' as seq_l1", "'' as seq_l2", "'' as seq_l3"), "id")
    assert sorted(str(r["id"]) for r in segment.collect()) == ["None", "s", "s", "u"]
    read = segment.filter("id = 'u'").select(F.col("id").alias("experience_id"), F.expr("array(struct('ring' as text, '主导' as engagement))").alias("items"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = ops.spelled_edges(ops.phrases_of(segment, read))
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        edges = laid_by(made, "experience_id", dealt=True)
        found = edges.join(segment.select("id", "kind"), F.col("experience_id") == F.col("id"))
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["id"], r["route"], r["text"]) for r in found.collect()) == [
            ("s", "description", "d")] * 2 + [("s", "title", "t")] * 2 + [("u", "skill", "ring"), ("u", "title", "t")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_slice_ends_without_its_ids_on_the_driver(spark, monkeypatch):
    due = spark.range(100).select(F.format_string("%03d", "id").alias("id"))

    def skipping(*_):
        raise AssertionError("rows are skipped on the driver")
    monkeypatch.setattr(type(due), "offset", skipping)
    rows, last = derive.next_slice(due, "009", 30)
    assert (rows.count(), last) == (30, "039")
    assert derive.next_slice(due, "089", 30)[1] == "099"
    assert derive.next_slice(due, "099", 30) is None


def test_only_texts_beyond_ascii_are_normalised_in_python(spark):
    rows = spark.createDataFrame([("a b",), ("ＡＢ",), ("",), (None,), ("ab\u2028",)], "t string").select("t", nfkc(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in rows.collect()} == {"a b": "a b", "ＡＢ": "AB", "": "", None: None, "ab\u2028": "ab\u2028"}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "octet_length" in plan or "CASE WHEN" in plan


def test_answers_are_dealt_once(spark):
    answers = spark.createDataFrame([("s", "", '{"items":[{"text":"ring","depth":"做过"},{"text":"ring","depth":"主导"}]}')], "experience_id string, company string, answer string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ops.conform_extractions(answers)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert [tuple(i) for i in found.collect()[0]["items"]] == [("ring", "主导")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_segments_arrive_in_files_for_all_tasks(spark, tmp_path):
    segments = spark.range(100).selectExpr(*[f"cast(id as string) as {c}" for c in ("id", "kind", "title", "seq_l1", "seq_l2", "seq_l3", "description")], "false as unemployed")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        lifecycle._arriving(spark, segments, str(tmp_path / "in"), 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 12
    assert spark.read.parquet(str(tmp_path / "in")).count() == 200
