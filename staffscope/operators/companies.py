"""Company knowledge: industry closure, alias resolution, company arrays, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import trim_unicode
from ..session import with_scalars
from .clean import CorpusError
from .trees import closure, validate_tree


def name_key(col: Column) -> Column:
    return F.lower(trim_unicode(col))


def _single(df: DataFrame, key: str, target: str, prefix: str) -> DataFrame:
    """key → its only target, NULL when there are several."""
    return df.groupBy(F.col(key).alias("_key")).agg(
        F.when(F.count_distinct(target) == 1, F.min(target)).alias(f"_{prefix}"),
        F.lit(True).alias(f"_has_{prefix}"))


def employed_outside(experience: DataFrame) -> DataFrame:
    return experience.filter((F.col("kind") == "external") & ~F.col("unemployed") & (F.col("company") != ""))


def resolve_spellings(spellings: DataFrame, aliases: DataFrame, companies: DataFrame) -> DataFrame:
    """(company, resolved): distinct written names and the one company each stands for, NULL if undecided.

    An alias decides alone: where a spelling has aliases but not exactly one target, the canonical names are
    not consulted.
    """
    by_alias = _single(aliases.select(name_key(F.col("raw_name")).alias("k"), trim_unicode(F.col("company")).alias("c")),
                       "k", "c", "alias")
    by_name = _single(companies.select(name_key(F.col("name")).alias("k"), trim_unicode(F.col("name")).alias("c")),
                      "k", "c", "name")
    written = spellings.select("company").distinct().withColumn("_key", name_key(F.col("company")))
    return (written.join(by_alias, "_key", "left").join(by_name, "_key", "left")
            .select("company", F.when(F.col("_has_alias"), F.col("_alias")).otherwise(F.col("_name")).alias("resolved")))


def resolve_company(experience: DataFrame, aliases: DataFrame, companies: DataFrame) -> DataFrame:
    """company_alias: the spellings that resolve."""
    found = resolve_spellings(employed_outside(experience), aliases, companies)
    return found.filter("resolved is not null").select(F.col("company").alias("raw_name"),
                                                       F.col("resolved").alias("company"))


def check_company_knowledge(companies, company_industries, company_circles, aliases, industries) -> None:
    """Names present and unique, every reference declared; anything else refuses the run."""
    names = companies.select(trim_unicode(F.col("name")).alias("name"))
    one = names.agg(F.count_if(F.col("name") == "").alias("blank"),
                    (F.count("*") - F.count_distinct("name")).alias("twice")).collect()[0]
    if one["blank"] or one["twice"]:
        raise CorpusError(f"companies: {one['blank']} without a name, {one['twice']} declared twice")
    industry = industries.select(trim_unicode(F.col("name")).alias("_i"))
    for what, df in (("company_industries", company_industries), ("company_circles", company_circles),
                     ("company_aliases", aliases)):
        lost = df.join(names, trim_unicode(df["company"]) == names["name"], "left_anti").limit(1).collect()
        if lost:
            raise CorpusError(f"{what}: company {lost[0]['company']} is not declared")
    lost = company_industries.join(industry, trim_unicode(F.col("industry")) == F.col("_i"), "left_anti").limit(1).collect()
    if lost:
        raise CorpusError(f"company_industries: industry {lost[0]['industry']} is not declared")
    if not company_circles.filter(trim_unicode(F.col("circle")) == "").isEmpty():
        raise CorpusError("company_circles: a circle has no name")
    if not aliases.filter(name_key(F.col("raw_name")) == "").isEmpty():
        raise CorpusError("company_aliases: a spelling is blank")


def shaped_industries(df: DataFrame) -> DataFrame:
    parent = trim_unicode(F.coalesce("parent", F.lit("")))
    return df.select(trim_unicode(F.col("name")).alias("name"), F.when(parent != "", parent).alias("parent"))


def company_arrays(companies: DataFrame, company_industries: DataFrame, circles: DataFrame,
                   industry_closure: DataFrame) -> DataFrame:
    """Companies with their industries and main industries closed over ancestors, sorted, and circles.

    A company told several times in the same words is one row: a segment would meet each of them.
    """
    above = industry_closure.select(F.col("name").alias("_i"), "ancestor")
    marked = (company_industries.select(trim_unicode(F.col("company")).alias("name"),
                                        trim_unicode(F.col("industry")).alias("_i"), "main")
              .join(above, "_i").groupBy("name", "ancestor").agg(F.bool_or("main").alias("main")))
    lists = marked.groupBy("name").agg(
        F.sort_array(F.collect_list("ancestor")).alias("industries"),
        F.sort_array(F.collect_list(F.when(F.col("main"), F.col("ancestor")))).alias("main_industries"))
    circled = (circles.select(trim_unicode(F.col("company")).alias("name"), trim_unicode(F.col("circle")).alias("circle"))
               .groupBy("name").agg(F.sort_array(F.collect_set("circle")).alias("circles")))
    none = F.array().cast("array<string>")
    group = trim_unicode(F.coalesce("group_name", F.lit("")))
    return (companies.select(trim_unicode(F.col("name")).alias("name"), group.alias("group_name")).distinct()
            .join(lists, "name", "left").join(circled, "name", "left")
            .select("name", F.when(F.col("group_name") == "", F.col("name")).otherwise(F.col("group_name")).alias("group_name"),
                    F.coalesce("industries", none).alias("industries"),
                    F.coalesce("main_industries", none).alias("main_industries"),
                    F.coalesce("circles", none).alias("circles")))


def build_companies(experience, industries, companies, company_industries, circles, aliases):
    """(industry, company, company_alias): checked, closed, and only companies somebody worked at."""
    tree = shaped_industries(industries)
    validate_tree(tree)
    check_company_knowledge(companies, company_industries, circles, aliases, industries)
    resolved = resolve_company(experience, aliases, companies)
    worked = resolved.select(F.col("company").alias("name")).distinct()
    table = company_arrays(companies, company_industries, circles, closure(tree)).join(worked, "name", "left_semi")
    return tree, table, resolved


def resolution_report(experience: DataFrame, aliases: DataFrame, companies: DataFrame,
                      with_industry: DataFrame) -> DataFrame:
    """One row: segments that name a company, resolved ones, ones with an industry, ambiguous aliases."""
    worked = employed_outside(experience).groupBy("company").agg(F.count("*").alias("n"))
    labelled = with_industry.select(F.col("name").alias("resolved"), F.lit(True).alias("_labelled"))
    found = worked.join(resolve_spellings(worked, aliases, companies), "company").join(labelled, "resolved", "left")
    n = F.col("n")
    counts = found.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("segments"),
        F.coalesce(F.sum(F.when(F.col("resolved").isNotNull(), n)), F.lit(0)).alias("resolved"),
        F.coalesce(F.sum(F.when(F.col("_labelled"), n)), F.lit(0)).alias("labelled"))
    double = (aliases.groupBy(name_key(F.col("raw_name")).alias("k")).agg(F.count_distinct("company").alias("n"))
              .agg(F.count_if(F.col("n") > 1).alias("ambiguous_aliases")))
    return with_scalars(counts, double)


def unresolved_spellings(experience: DataFrame, aliases: DataFrame, companies: DataFrame, top: int = 30) -> DataFrame:
    worked = employed_outside(experience)
    lost = resolve_spellings(worked, aliases, companies).filter("resolved is null").select("company")
    return (worked.join(lost, "company").groupBy("company").agg(F.count_distinct("emp_id").alias("people"))
            .orderBy(F.desc("people"), "company").limit(top))


def leaf_industries(companies: DataFrame, tree: DataFrame) -> DataFrame:
    """(name, industry): main industries of a company without those that have a child in the same list."""
    rows = companies.select("name", F.explode("main_industries").alias("industry"))
    parents = (rows.join(tree.select(F.col("name").alias("industry"), F.col("parent").alias("_up")), "industry")
               .filter("_up is not null").select("name", F.col("_up").alias("industry")).distinct())
    return rows.join(parents, ["name", "industry"], "left_anti")
