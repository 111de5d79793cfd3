"""Sources, publishing, and the way from CSV files to a reviewed corpus."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from staffscope.operators.numbering import numbered, page
from staffscope.plans.derive import assert_searchable, derive
from staffscope.plans.query import Condition, Query, Seek
from staffscope.plans.review import review_round
from staffscope.plans.search import Search
from staffscope.plans.sync import sync
from staffscope.operators.catalog import catalog
from staffscope.sources.contract import ContractError, load_source, read_contract_dir, register_source
from staffscope.sources.cases import CaseError, read_cases
from staffscope.sources.store import Corpus

FILES = {
    "employees": "﻿emp_id, name ,hire_date,education_level,school,school_tier,overseas_educated,recruitment,extra\n"
                 "1,Ann,2020-01-01,本科,X,985,是,campus,z\n 2 ,Bo,,硕士,Y,,,social,z\n\n3,Cy,2020-01-01,本科,X,,0,social,z\n3,Cyd,2020-01-01,本科,X,,0,social,z\n",
    "assignments": "emp_id,start_date,end_date,department,department_path,title,level,seq_l1,seq_l2,seq_l3\n"
                   "1,2020-01-01,2021-12-31,Dev,Co > Dev,Engineer,P6,Tech,Backend,\n1,2022-01-01,,Dev,Co>Dev,Engineer,P6,Tech,Backend,\n"
                   "2,2023-01-01,,Ops,Co>Ops,Operator,P9,Ops,,\n9,2023-01-01,,Ops,Co>Ops,Operator,P6,Ops,,\n",
    "external": 'emp_id,start_date,end_date,company,title,description,company_tag,nature,unemployed\n'
                '1,2015-01-01,2018-12-31,ACME ltd,Developer,"wrote Go services\nand ""tools""",big,,no\n1,2019-01-01,,, , ,,,1\n',
    "levels": "level,band,rank\nP6,senior,2\n",
    "streams": "stream,kind,label,period,notes\nperf,rating,Performance,half,\n",
    "scales": "stream,value,rank\nperf,A,2\nperf,B,1\n",
    "records": "emp_id,stream,period_start,period_end,value,recorded_at\n1,perf,2024-01-01,2024-06-30,B,2024-07-01\n1,perf,2024-01-01,2024-06-30,A,2024-08-01\n"
               "1,perf,2024-07-01,2024-12-31,C,2025-01-01\n",
    "industries": "name,parent\nsoftware,\ncloud,software\n", "companies": "name,group_name\nAcme,\n",
    "company_industries": "company,industry,main\nAcme,cloud,true\n", "company_aliases": "raw_name,company\n acme LTD,Acme\n",
}
AS_OF = date(2025, 6, 30)


@pytest.fixture()
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    return tmp_path


def test_from_files_to_a_search(spark, folder, tmp_path):
    root = str(tmp_path / "corpus")
    bundle = read_contract_dir(spark, str(folder))
    assert "extra" not in bundle["employees"].columns and bundle["company_circles"].count() == 0
    version, report, counts = sync(root, bundle, AS_OF)
    seen = {(r["table"], r["what"]): r["rows"] for r in report.collect()}
    assert seen[("employees", "conflicting_people")] == 1 and seen[("employees", "population")] == 2
    assert seen[("assignments", "not_in_population")] == 1 and seen[("assignments", "merged_rows")] == 1
    assert seen[("records", "rating_off_scale")] == 1 and seen[("records", "revised")] == 1
    assert seen[("employees", "levels_without_band")] == 1 and seen[("companies", "resolved")] == 1
    corpus = Corpus.at(spark, root)
    assert corpus.version == version == 1
    ann = corpus["employee"].filter("emp_id = '1'").first()
    assert (ann["cur_dept_path"], ann["cur_level_band"], ann["cur_level_rank"], ann["overseas_educated"]) == ("Co>Dev", "senior", 2, True)
    assert corpus["company"].first()["industries"] == ["cloud", "software"]

    again, _, same = sync(root, read_contract_dir(spark, str(folder)), AS_OF)
    assert again == 2 and tuple(same.first())[0] == 0 and tuple(same.first())[2] == 0  # a second run changes nothing

    outside = corpus["experience"].filter("kind = 'external' and not unemployed")
    items = F.array(F.struct(F.lit("Go").alias("text"), F.lit("主导").alias("engagement")), F.struct(F.lit("Golang").alias("text"), F.lit(None).cast("string").alias("engagement")))
    answers = outside.select(F.col("id").alias("experience_id"), items.alias("items"))
    aligned = outside.select(F.col("id").alias("experience_id"), F.lit("Tech").alias("seq_l1"), F.lit("Backend").alias("seq_l2"))
    derived = derive(Corpus.at(spark, root), answers, aligned, "v1")
    assert_searchable(derived)
    routes = {(r["route"], r["text"]) for r in derived["experience_phrase"].join(derived["phrase"].withColumnRenamed("id", "phrase_id"), "phrase_id").collect()}
    assert routes == {("role", "Tech · Backend｜Engineer"), ("role", "Ops｜Operator"), ("title", "Developer"), ("skill", "Go"), ("skill", "Golang")}

    vectors = spark.createDataFrame([("Go", [1.0, 0.0]), ("Golang", [1.0, 0.1]), ("Developer", [0.0, 1.0])], "word string, embedding array<float>")

    def judge(rows):
        same_as = F.to_json(F.struct(F.lit("").alias("why"), F.lit("同一件事").alias("kind"), F.lit("Go").alias("target")))
        alone = F.to_json(F.struct(F.lit("").alias("why"), F.lit("自成一项").alias("kind"), F.lit("").alias("target")))
        return rows.select("id", F.when(F.col("word") == "Golang", same_as).otherwise(alone).alias("judgment"))

    reviewed = review_round(derived, vectors, "g1", datetime(2025, 7, 1), judge)
    terms = {r["word"]: r["canonical"] for r in reviewed["term"].collect()}
    assert terms == {"Go": "Go", "Golang": "Go", "Developer": "Developer"}
    assert reviewed["review_word"].count() == 0
    views = catalog(reviewed.tables)
    segment = views["experience"].filter("company is not null").first()
    assert segment["skills"] == ["Go"] and segment["company_name"] == "Acme" and segment["main_industries"] == ["cloud", "software"]
    golang = Condition("go", "Golang", "must", "experience", seek=Seek.words("golang"))
    rows = Search(views, Query((golang,)), AS_OF).roster().collect()
    assert [r["emp_id"] for r in rows] == ["1"] and 0 < rows[0]["depth"] < 1


def test_contract_errors(spark, folder):
    (folder / "levels.csv").write_text("level,level ,rank\n", encoding="utf-8")
    with pytest.raises(ContractError, match="duplicated"):
        read_contract_dir(spark, str(folder))
    (folder / "levels.csv").write_text("level,band\nP6,x\n", encoding="utf-8")
    with pytest.raises(ContractError, match="missing columns rank"):
        read_contract_dir(spark, str(folder))
    (folder / "levels.csv").write_text(FILES["levels"], encoding="utf-8")
    (folder / "external.csv").write_text(FILES["external"].replace(",no\n", ",perhaps\n"), encoding="utf-8")
    with pytest.raises(ContractError, match="perhaps"):
        read_contract_dir(spark, str(folder))
    (folder / "external.csv").unlink()
    with pytest.raises(ContractError, match="external.csv is missing"):
        read_contract_dir(spark, str(folder))


def test_custom_source(spark, folder):
    with pytest.raises(ContractError):
        register_source("bad", None)
    register_source("files", lambda s: read_contract_dir(s, str(folder)))
    assert load_source(spark, "files")["levels"].count() == 1


def test_a_pinned_version_does_not_move(spark, tmp_path):
    from staffscope.sources.store import publish
    root = str(tmp_path / "c")
    one = spark.createDataFrame([("a", None)], "name string, parent string")
    publish(Corpus({"industry": one}), root)
    pinned = Corpus.at(spark, root)
    publish(Corpus({"industry": one.limit(0)}), root)
    assert pinned["industry"].count() == 1 and Corpus.at(spark, root)["industry"].count() == 0


def test_unchanged_tables_stay_and_two_publishers_cannot_both_win(spark, tmp_path):
    from staffscope.sources.store import PublishConflict, _write_manifest, publish
    root = str(tmp_path / "c")
    one = spark.createDataFrame([("a", None)], "name string, parent string")
    alias = spark.createDataFrame([("a", "b")], "raw_name string, company string")
    publish(Corpus({"industry": one, "company_alias": alias}), root)
    mine, other = Corpus.at(spark, root), Corpus.at(spark, root)
    assert publish(mine.replace(industry=one.limit(0)), root) == 2
    now = Corpus.at(spark, root)
    assert now.folders["company_alias"] == mine.folders["company_alias"] and now.folders["industry"] != mine.folders["industry"]
    assert now["industry"].count() == 0 and now["company_alias"].count() == 1 and mine["industry"].count() == 1
    with pytest.raises(PublishConflict):
        publish(other.replace(company_alias=alias.limit(0)), root)
    with pytest.raises(PublishConflict):
        _write_manifest(spark, root, 2, {})
    assert Corpus.at(spark, root).version == 2 and Corpus.at(spark, root, 1)["industry"].count() == 1
    with pytest.raises(FileNotFoundError):
        Corpus.at(spark, root, 9)


def test_numbering_a_hot_group(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("g"), (F.col("id") * 7919 % 1000).alias("v"))
    got = numbered(df, [F.col("v")], ["g"]).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("l")).collect()
    for row in got:
        assert [x["n"] for x in row["l"]] == list(range(1, len(row["l"]) + 1))
    rows, at = page(df, [F.col("v")], 99, 300)
    assert at == {"page": 4, "pages": 4, "total": 1000, "from": 901} and rows.count() == 100


def test_cases(spark, tmp_path):
    import json
    good = [{"name": "a", "query": "q", "expect": ["1"], "reject": ["2"]}]
    (tmp_path / "a.json").write_text(json.dumps(good))
    assert read_cases(spark, str(tmp_path / "a.json"), "search").count() == 1
    (tmp_path / "b.json").write_text(json.dumps([{**good[0], "reject": ["1"]}]))
    with pytest.raises(CaseError, match="expected and rejected"):
        read_cases(spark, str(tmp_path / "b.json"), "search")
