"""Looking around a corpus: values, names, phrases, suggestions, coverage, people."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import contains_ci, matches, starts_ci
from ..schema import NOT_A_VALUE, SHORT_ROUTES
from .trees import closure

RANK_OF = {"level_band": "level_rank", "education": "education_rank", "value": "value_rank"}


def values_of(relation: DataFrame, column: str, stream: str | None = None) -> DataFrame:
    """(name, people, rank): the values of a finite column; arrays count each element. Sort with `values_order`."""
    rank = RANK_OF.get(column)
    rows = relation.filter(F.col("stream") == stream) if stream else relation
    is_list = dict(relation.dtypes)[column].startswith("array")
    name = F.explode(column) if is_list else F.col(column).cast("string")
    step = F.col(rank) if rank in relation.columns else F.lit(None).cast("int")
    picked = rows.select("emp_id", name.alias("name"), step.alias("rank"))
    return (picked.filter(F.col("name").isNotNull() & ~F.col("name").isin(*NOT_A_VALUE)).groupBy("name")
            .agg(F.count_distinct("emp_id").alias("people"), F.min("rank").alias("rank")))


def values_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.asc_nulls_last("rank"), F.desc("people"), "name")


# --- fixed values: dimensions with a listed vocabulary ------------------------------------------------
VOCABULARY = {"company_tag": ("experience", "company_tag"), "level": ("person", "level_band"),
              "recruitment": ("person", "recruitment"), "education": ("person", "education"),
              "school_tier": ("person", "school_tier"), "overseas": ("person", "overseas")}


def vocabularies(views) -> DataFrame:
    """(dim, name, people, rank) for the six dimensions whose values are listed: one scan of each relation."""
    by_relation: dict[str, list[tuple[str, str]]] = {}
    for dim, (relation, column) in VOCABULARY.items():
        by_relation.setdefault(relation, []).append((dim, column))
    return reduce(DataFrame.unionByName, [_listed(views[relation], dims) for relation, dims in by_relation.items()])


def _listed(relation: DataFrame, dims: list[tuple[str, str]]) -> DataFrame:
    step = lambda column: F.col(RANK_OF[column]) if RANK_OF.get(column) in relation.columns else F.lit(None)
    values = F.array(*[F.struct(F.lit(dim).alias("dim"), F.col(column).cast("string").alias("name"), step(column).cast("int").alias("rank"))
                       for dim, column in dims])
    told = relation.select("emp_id", F.explode(F.filter(values, lambda v: v["name"].isNotNull() & ~v["name"].isin(*NOT_A_VALUE))).alias("value"))
    return (told.groupBy(F.col("value.dim").alias("dim"), F.col("value.name").alias("name"))
            .agg(F.count_distinct("emp_id").alias("people"), F.min("value.rank").alias("rank")))


def _named(views, field: str) -> tuple[DataFrame, list[str], str]:
    if field == "school":
        return views["person"], ["school"], "school"
    return views["experience"], (["company"] if field == "company" else ["department", "department_path"]), field


def lookup_names(views, field: str, names: list[str], top: int = 8) -> DataFrame:
    """(query, name, people, total): spellings that contain each name, the best known `top` of them, and everybody.

    Names are few and given with the query, so each row is tested against all of them in place: no join. The
    people behind one spelling are counted before anything is ranked.
    """
    rows, columns, shown = _named(views, field)
    asked = list(dict.fromkeys(names))
    test = lambda name: reduce(lambda a, b: a | b, [F.coalesce(contains_ci(F.col(c), name), F.lit(False)) for c in columns])
    found = F.array_compact(F.array(*[F.when(test(name), F.lit(name)) for name in asked]))
    hits = rows.select("emp_id", F.col(shown).alias("name"), F.explode(found).alias("query")).distinct()
    spelled = hits.groupBy("query", "name").agg(F.count("*").alias("people"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("people"), F.asc_nulls_last("name")))
    best = spelled.withColumn("_n", place).filter(F.col("_n") <= top).drop("_n")
    totals = hits.groupBy("query").agg(F.count_distinct("emp_id").alias("total"))
    return best.join(totals, "query")


def find_phrases(edges: DataFrame, phrase: DataFrame, experience: DataFrame, patterns: list[str], top: int = 40) -> DataFrame:
    """(pattern, name, people): for each pattern the phrases it finds by people, and one row without a name that
    counts everybody; whole descriptions are left out."""
    asked = list(dict.fromkeys(patterns))
    found = F.array_compact(F.array(*[F.when(matches(F.col("text"), p), F.lit(p)) for p in asked]))
    caught = phrase.select(F.col("id").alias("phrase_id"), F.col("text").alias("name"), F.explode(found).alias("pattern"))
    who = (edges.filter("route <> 'description'").select("experience_id", "phrase_id").join(caught, "phrase_id")
           .join(experience.select(F.col("id").alias("experience_id"), "emp_id"), "experience_id")
           .select("pattern", "name", "emp_id").distinct())
    each = who.groupBy("pattern", "name").agg(F.count("*").alias("people"))
    place = F.row_number().over(Window.partitionBy("pattern").orderBy(F.desc("people"), "name"))
    best = each.withColumn("_n", place).filter(F.col("_n") <= top).drop("_n")
    everybody = who.groupBy("pattern").agg(F.count_distinct("emp_id").alias("people"))
    phrases = each.groupBy("pattern").agg(F.count("*").alias("phrases"))
    total = everybody.join(phrases, "pattern").select("pattern", F.lit(None).cast("string").alias("name"), "people", "phrases")
    return total.unionByName(best.withColumn("phrases", F.lit(None).cast("bigint")))


def suggest(views, field: str, text: str, top: int = 8) -> DataFrame:
    """(value, people, lead): completions that contain the text; prefixes first, then by people, then by name."""
    if field == "what":
        words = views["term"].select(F.col("word").alias("text"), "canonical", F.col("excluded").alias("_x"))
        named = (views["phrase"].filter(contains_ci(F.col("text"), text)).join(words, "text", "left")
                 .filter(~F.coalesce("_x", F.lit(False)))
                 .select(F.col("id").alias("phrase_id"), F.coalesce("canonical", "text").alias("value"),
                         starts_ci(F.col("text"), text).alias("_lead")))
        rows = (views["edge"].filter(F.col("route").isin(*SHORT_ROUTES)).select("experience_id", "phrase_id")
                .join(named, "phrase_id")
                .join(views["experience"].select(F.col("id").alias("experience_id"), "emp_id"), "experience_id"))
        counted = rows.groupBy("value").agg(F.count_distinct("emp_id").alias("people"), F.bool_or("_lead").alias("lead"))
    else:
        source, _, shown = _named(views, field)
        rows = source.select(F.col(shown).alias("value"), "emp_id").filter(contains_ci(F.col("value"), text))
        counted = rows.groupBy("value").agg(F.count_distinct("emp_id").alias("people"))
        counted = counted.withColumn("lead", starts_ci(F.col("value"), text))
    return counted.orderBy(F.desc("lead"), F.desc("people"), "value").limit(top)


def stream_facts(streams: DataFrame, records: DataFrame, scale: DataFrame) -> DataFrame:
    """Coverage per stream: people, periods, first and latest period, and its values in their order."""
    by_period = records.groupBy("stream", "period_start").agg(F.max("period_end").alias("period_end"))
    spans = by_period.groupBy("stream").agg(
        F.count("*").alias("periods"), F.min("period_start").alias("first"), F.max("period_start").alias("latest"),
        F.max_by("period_end", "period_start").alias("latest_end"))
    people = records.groupBy("stream").agg(F.count_distinct("emp_id").alias("people"))
    steps = scale.groupBy("stream").agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("_v"))
    states = (records.groupBy("stream", "value").agg(F.count_distinct("emp_id").alias("n"))
              .groupBy("stream").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "value"))).alias("_s")))
    values = F.when(F.col("kind") == "status", F.transform("_s", lambda v: v["value"])).otherwise(
        F.transform("_v", lambda v: v["value"]))
    return (streams.join(people, "stream", "left").join(spans, "stream", "left").join(steps, "stream", "left")
            .join(states, "stream", "left")
            .select("stream", "label", "kind", "period", F.coalesce("people", F.lit(0)).alias("people"),
                    F.coalesce("periods", F.lit(0)).alias("periods"), "first", "latest", "latest_end",
                    F.coalesce(values, F.array().cast("array<string>")).alias("values")))


def company_facts(experience: DataFrame, industry: DataFrame) -> DataFrame:
    """(name, parent, main, any, path): the industry forest with people; sort by `path` for pre-order, larger first."""
    main = values_of(experience, "main_industries").select("name", F.col("people").alias("main"))
    any_ = values_of(experience, "industries").select("name", F.col("people").alias("any"))
    nodes = (industry.join(main, "name", "left").join(any_, "name", "left")
             .select("name", "parent", F.coalesce("main", F.lit(0)).alias("main"), F.coalesce("any", F.lit(0)).alias("any")))
    step = nodes.select(F.col("name").alias("ancestor"), F.struct((-F.col("any")).alias("less"), F.col("name").alias("at")).alias("_step"))
    paths = (closure(industry).join(step, "ancestor").groupBy("name")
             .agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("from_root"), "_step"))).alias("_p"))
             .select("name", F.transform("_p", lambda p: p["_step"]).alias("path")))
    return nodes.join(paths, "name")


def company_coverage(experience: DataFrame) -> DataFrame:
    return experience.filter("kind = 'external'").agg(
        F.count("*").alias("segments"), F.count("company_name").alias("recognized"), F.count("industries").alias("labelled"))


def overview(views, names) -> DataFrame:
    """(relation, rows)."""
    return reduce(DataFrame.unionByName, [
        views[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("relation"), "rows") for name in names])


def found_people(employee: DataFrame, text: str) -> DataFrame:
    return employee.filter(contains_ci(F.col("name"), text) | contains_ci(F.col("emp_id"), text))


def list_employees(employee: DataFrame, experience: DataFrame, version: str, text: str = "", page: int = 1, size: int = 50) -> DataFrame:
    """One page of people by id with their segments and those not derived under `version`. The page is cut
    before segments are counted."""
    shown = (found_people(employee, text).select("emp_id", "name", "cur_dept", "cur_title")
             .orderBy("emp_id").offset((page - 1) * size).limit(size))
    behind = ~F.col("derived_identity").eqNullSafe(F.lit(version))
    counts = (experience.join(shown.select("emp_id"), "emp_id", "left_semi").groupBy("emp_id")
              .agg(F.count("*").alias("segments"), F.count_if(behind).alias("pending")))
    return shown.join(counts, "emp_id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("segments", "pending")})


def employee_segments(experience: DataFrame, edges: DataFrame, phrase: DataFrame, who: Column, version: str) -> DataFrame:
    """Segments of the people `who` holds for, with skills and whether they follow `version`; by start, then id."""
    own = experience.filter(who)
    said = (edges.filter("route = 'skill'").join(own.select(F.col("id").alias("experience_id")), "experience_id", "left_semi")
            .join(phrase.select(F.col("id").alias("phrase_id"), "text"), "phrase_id").groupBy(F.col("experience_id").alias("id"))
            .agg(F.array_sort(F.collect_list(F.struct("text", "engagement"))).alias("skills")))
    return own.join(said, "id", "left").withColumn("derived", F.col("derived_identity").eqNullSafe(F.lit(version)))


def employee_timeline(experience: DataFrame, company_alias: DataFrame, leaves: DataFrame, who: Column) -> DataFrame:
    """Segments with the most specific main industries of their company, by start, then id."""
    lists = (leaves.groupBy("name").agg(F.array_sort(F.collect_list("industry")).alias("main_industries")))
    known = company_alias.join(lists, company_alias["company"] == lists["name"]).select("raw_name", "main_industries")
    return (experience.filter(who).join(known, F.col("company") == F.col("raw_name"), "left").drop("raw_name"))
