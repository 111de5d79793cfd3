"""The read relations conditions are written against: person, experience, rating, status, scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import blank_to_null
from ..session import LazyTables, cut_lineage, laid_by
from .scope import scoped
from .terms import term_closure

NOTHING = "array<string>"


def person_view(employee: DataFrame) -> DataFrame:
    """One row per person, blanks as NULL. Names and the current place ride along for the roster."""
    text = lambda source, name: blank_to_null(F.col(source)).alias(name)
    abroad = F.when(F.col("overseas_educated"), "是").when(~F.col("overseas_educated"), "否")
    return employee.select(
        "emp_id", "name", text("cur_level_band", "level_band"), F.col("cur_level_rank").alias("level_rank"),
        text("education_level", "education"), "education_rank", text("school", "school"), text("school_tier", "school_tier"),
        abroad.alias("overseas"), text("recruitment", "recruitment"), "hire_date", text("cur_dept", "cur_dept"),
        text("cur_dept_path", "cur_dept_path"), text("cur_title", "cur_title"), text("cur_level", "cur_level"),
        text("cur_seq_l1", "cur_seq_l1"), text("cur_seq_l2", "cur_seq_l2"), text("cur_seq_l3", "cur_seq_l3"))


def segment_skills(edges: DataFrame, phrase: DataFrame, terms: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """(id, skills): canonical words of the skill edges and everything broader, sorted; excluded words left out.

    Each phrase is expanded once, against the vocabulary. Only the resulting short lists meet the edges; they are written
    first, so that the planner knows how many there are and, when they are few, leaves the edges where they lie.
    """
    above = term_closure(terms) if above is None else above
    used = edges.filter("route = 'skill'").select(F.col("experience_id").alias("id"), "phrase_id")  # sets below: repeats do no harm
    rows = terms.select(F.col("word").alias("text"), "canonical", "excluded")
    words = (phrase.join(rows, "text", "left").filter(~F.coalesce("excluded", F.lit(False)))
             .select(F.col("id").alias("phrase_id"), F.coalesce("canonical", "text").alias("name")))
    lists = (words.join(above.filter("depth > 0").select("name", "ancestor"), "name", "left")
             .groupBy("phrase_id", "name").agg(F.collect_set("ancestor").alias("_up"))
             .select("phrase_id", F.concat(F.array("name"), "_up").alias("_words")))
    return (used.join(cut_lineage(lists), "phrase_id").groupBy("id")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_words")))).alias("skills")))


def experience_view(experience: DataFrame, company_alias: DataFrame, company: DataFrame, skills: DataFrame) -> DataFrame:
    """One row per employed segment, with what is known about the company and the skills it carries."""
    text = lambda name: blank_to_null(F.col(name)).alias(name)
    known = company.select(F.col("name").alias("company_name"), F.col("group_name").alias("company_group"),
                           F.col("industries").alias("_i"), F.col("main_industries").alias("_m"), F.col("circles").alias("_c"))
    # written first, as its size decides whether the segments have to be shuffled by company
    spelled = cut_lineage(company_alias.join(known, company_alias["company"] == known["company_name"])
                          .select(F.col("raw_name").alias("_raw"), *known.columns))
    some = lambda c, name: F.when(F.size(c) > 0, F.col(c)).alias(name)
    seq = lambda n: blank_to_null(F.when(F.col(f"seq_l{n}") != "", F.col(f"seq_l{n}"))
                                  .otherwise(F.col(f"seq_inferred_l{n}"))).alias(f"seq_l{n}")
    # segments without a company outside get a key of their own, which no spelling has: one NULL key would be one task
    outside = F.when((F.col("kind") == "external") & (F.col("company") != ""), F.col("company")).otherwise(F.concat(F.lit("\0"), "id"))
    return (experience.filter(~F.col("unemployed"))
            .join(skills, "id", "left").join(spelled, outside == F.col("_raw"), "left")  # the lists come after the shuffle by id
            .select("id", "emp_id", "kind", "start_date", "end_date", "months", text("company"),
                    F.col("company_meta.company_tag").alias("company_tag"), F.col("company_meta.nature").alias("company_nature"),
                    "company_name", "company_group", some("_m", "main_industries"), some("_i", "industries"),
                    some("_c", "company_circles"), text("department"), text("department_path"), text("title"),
                    text("level"), seq(1), seq(2), F.coalesce("skills", F.array().cast(NOTHING)).alias("skills"),
                    F.concat("content_key", F.coalesce("derived_identity", F.lit(""))).alias("content")))


def rating_view(records: DataFrame, streams: DataFrame, scale: DataFrame) -> DataFrame:
    ratings = streams.filter("kind = 'rating'").select("stream")
    return (records.join(ratings, "stream", "left_semi")
            .join(scale.withColumnRenamed("rank", "value_rank"), ["stream", "value"], "left")
            .select("emp_id", "stream", "period_start", "period_end", "value", "value_rank"))


def status_view(records: DataFrame, streams: DataFrame) -> DataFrame:
    states = streams.filter("kind = 'status'").select("stream")
    return records.join(states, "stream", "left_semi").select(
        "emp_id", "stream", "value", F.col("period_start").alias("valid_from"), F.col("period_end").alias("valid_to"))


RELATIONS = ("person", "experience", "rating", "status", "scale")


def catalog(tables, people: DataFrame | None = None, store: bool = False) -> LazyTables:
    """The relations over stored tables, restricted to `people` once so that every count sees the same ones.

    `store` writes the experience relation when it is first read: company knowledge and skills are then joined once
    per corpus version and vocabulary instead of once per search, and each search reads only the columns it uses.
    """
    if people is not None:
        tables = scoped(tables, people)
    t = tables
    keep = (lambda df: laid_by(df, "id", dealt=True)) if store else (lambda df: df)  # joined by id, and read by it
    return LazyTables({
        "person": lambda: person_view(t["employee"]),
        "experience": lambda: keep(experience_view(
            t["experience"], t["company_alias"], t["company"],
            segment_skills(t["experience_phrase"], t["phrase"], t["term"]))),
        "rating": lambda: rating_view(t["employee_record"], t["record_stream"], t["scale"]),
        "status": lambda: status_view(t["employee_record"], t["record_stream"]),
        "scale": lambda: t["scale"],
        "edge": lambda: t["experience_phrase"], "phrase": lambda: t["phrase"], "term": lambda: t["term"],
    })


def register(spark, relations: dict[str, DataFrame], prefix: str = "") -> None:
    for name in RELATIONS:
        relations[name].createOrReplaceTempView(prefix + name)
