"""From patterns to segments: phrase match, hits, and the predicates conditions put on segments and people."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import matches_any
from .derive import first_write

HIT = ("cond", "route", "fits", "phrase", "phrase_id", "engagement")


def match_phrases(phrase: DataFrame, terms: DataFrame, patterns: dict[int, tuple[str, ...]]) -> DataFrame:
    """(cond, phrase_id, text): phrases any pattern finds, and every other spelling of the same canonical word.

    All conditions are matched in one pass over the distinct phrases; broader and narrower words are not added.
    """
    found = F.array_compact(F.array(*[F.when(matches_any(F.col("text"), p), F.lit(cond)) for cond, p in patterns.items()]))
    caught = phrase.select("text", F.explode(found).alias("cond"))
    items = caught.join(terms.select(F.col("word").alias("text"), "canonical"), "text").select("cond", "canonical").distinct()
    same = items.join(terms.select("word", "canonical"), "canonical").select("cond", F.col("word").alias("text"))
    texts = caught.select("cond", "text").unionByName(same).distinct()
    return texts.join(phrase.select(F.col("id").alias("phrase_id"), "text"), "text").select("cond", "phrase_id", "text")


def criterion_key(criterion: str) -> str:
    return hashlib.sha256(criterion.encode()).hexdigest()


def reach(edges: DataFrame, experience: DataFrame, matched: DataFrame | None, whole: list[int]) -> DataFrame:
    """(cond, route, phrase, phrase_id, engagement) next to the segment's own columns, whatever was said about them.

    Conditions with patterns reach segments through edges; the others take every segment once.
    """
    parts = []
    if matched is not None:
        skill = F.when(F.col("route") == "skill", F.col("text"))
        through = (edges.join(matched, "phrase_id")
                   .select("cond", F.col("experience_id").alias("id"), "route", skill.alias("phrase"), "phrase_id", "engagement"))
        parts.append(through.join(experience, "id"))
    if whole:
        conds = F.explode(F.array(*[F.lit(c) for c in whole])).alias("cond")
        none = F.lit(None).cast("string")
        parts.append(experience.select("*", conds).withColumns({
            "route": F.when(F.col("kind") == "internal", "role").otherwise("title"), "phrase": none, "phrase_id": none,
            "engagement": none}))
    return reduce(DataFrame.unionByName, parts)


def judge_hits(hits: DataFrame, criteria: dict[int, str | None], verdicts: DataFrame | None) -> DataFrame:
    """What was reached with `fits`: a criterion reads the stored verdict, true keeps, false drops, none leaves `fits` NULL
    (not confirmed yet)."""
    judged = {cond: key for cond, key in criteria.items() if key}
    if not judged:
        return hits.withColumn("fits", F.lit(True))
    key = reduce(lambda chain, item: chain.when(F.col("cond") == item[0], item[1]), judged.items(), F)
    hits = hits.withColumn("criterion_key", key.otherwise(F.lit(None).cast("string")))
    if verdicts is None:
        return hits.withColumn("fits", F.when(F.col("criterion_key").isNull(), True)).drop("criterion_key")
    said = verdicts.select("criterion_key", "content", F.col("fits").alias("_fits"))
    joined = hits.join(said, ["criterion_key", "content"], "left")
    return (joined.withColumn("fits", F.when(F.col("criterion_key").isNull(), True).otherwise(F.col("_fits")))
            .filter(~F.col("fits").eqNullSafe(False)).drop("_fits", "criterion_key"))


def materialise_hits(edges: DataFrame, experience: DataFrame, matched: DataFrame | None, whole: list[int],
                     criteria: dict[int, str | None], verdicts: DataFrame | None) -> DataFrame:
    """(cond, route, fits, phrase, phrase_id, engagement) next to the segment's own columns."""
    return judge_hits(reach(edges, experience, matched, whole), criteria, verdicts)


def scoped_params(where: str, params: dict, mark: str) -> tuple[str, dict]:
    """The predicate with its named parameters renamed, so that several conditions fit in one statement."""
    renamed = {}
    for name, value in params.items():
        where = re.sub(rf"(?<![:\w]):{re.escape(name)}\b", f":{mark}_{name}", where)
        renamed[f"{mark}_{name}"] = value
    return where.replace("{", "{{").replace("}", "}}"), renamed


RELATIONS = ("person", "experience", "rating", "status", "scale")


def _sql(spark, text: str, params: dict, views: dict[str, DataFrame], **more: DataFrame) -> DataFrame:
    """Run a statement in which the catalog relations are visible by name, inside predicates too."""
    used = [name for name in RELATIONS if re.search(rf"\b{name}\b", text)]
    ctes = ", ".join(f"{name} as (select * from {{_{name}}})" for name in used)
    frames = {f"_{name}": views[name] for name in used}
    return spark.sql((f"with {ctes} " if ctes else "") + text, args=params or None, **frames, **more)


def segments_where(views, hits: DataFrame, conditions: dict[int, tuple[str, dict]]) -> DataFrame:
    """Hit rows whose condition's predicate holds, all conditions in one statement over one scan."""
    parts, params = [], {}
    for cond, (where, own) in conditions.items():
        text, renamed = scoped_params(where, own, f"c{cond}")
        params |= renamed
        parts.append(f"(h.cond = {cond})" if text == "true" else f"(h.cond = {cond} and ({text}))")
    # one row carries both sides: `e` and `h` are two names for it, so no second join is needed
    text = " or ".join(parts)
    text = re.sub(r"\bh\.", "e.", text)
    return _sql(hits.sparkSession, f"select e.* from {{_rows}} e where {text}", params, views, _rows=hits)


def conditions_met(views, relation: str, conditions: dict[int, tuple[str, dict]]) -> DataFrame:
    """Rows of `experience` or `person` that satisfy some of the predicates, with `conds`, the list of those they satisfy.

    One scan, however many conditions. What a predicate asks of other relations becomes a flag of the row (an existence
    join) before the list is made.
    """
    name = {"experience": "e", "person": "p"}[relation]
    params, cases = {}, []
    for cond, (where, own) in conditions.items():
        text, renamed = scoped_params(where, own, f"c{cond}")
        params |= renamed
        cases.append(f"case when ({text}) then {cond} end")
    text = f"select {name}.*, array_compact(array({', '.join(cases)})) as conds from {{_rows}} {name}"
    met = _sql(views[relation].sparkSession, text, params, views, _rows=views[relation])
    return met.filter(F.size("conds") > 0)


def segment_flags(views, conditions: dict[int, tuple[str, dict]]) -> DataFrame:
    """(emp_id, q<i>, m<i>): whether some segment satisfies condition i, and the months of those that do.

    All conditions are tested in one scan and share one aggregation by person, combined before its shuffle.
    """
    met = conditions_met(views, "experience", conditions)
    return met.groupBy("emp_id").agg(*[
        agg for cond in conditions for holds in [F.array_contains("conds", cond)] for agg in (
            F.bool_or(holds).alias(f"q{cond}"), F.sum(F.when(holds, F.col("months")).otherwise(0)).alias(f"m{cond}"))])


def people_where(views, conditions: dict[int, tuple[str, dict]], people: DataFrame | None = None) -> DataFrame:
    """People who satisfy every one of the predicates over `p`; an unknown outcome does not count."""
    parts, params = [], {}
    for cond, (where, own) in conditions.items():
        text, renamed = scoped_params(where, own, f"c{cond}")
        params |= renamed
        parts.append(f"({text})")
    base = views["person"] if people is None else people
    if not parts:
        return base
    return _sql(base.sparkSession, f"select p.* from {{_people}} p where {' and '.join(parts)}", params, views, _people=base)


# --- canonical conditions on periodic records -----------------------------------------------------
def rating_count_since(at_least: str, times: int, since: str, stream: str) -> tuple[str, dict]:
    """At least `times` ratings of `at_least` or better in periods that end on or after `since`."""
    return ("(select count(*) from rating r where r.emp_id = p.emp_id and r.stream = :stream "
            "and r.period_end >= to_date(:since) and r.value_rank >= (select max(s.rank) from scale s "
            "where s.stream = :stream and s.value = :least)) >= :times",
            {"stream": stream, "since": since, "least": at_least, "times": times})


def consecutive_ratings(at_least: str, stream: str) -> tuple[str, dict]:
    """Two adjacent periods both rated `at_least` or better."""
    step = "(select max(s.rank) from scale s where s.stream = :stream and s.value = :least)"
    return ("exists (select 1 from rating a join rating b on a.emp_id = b.emp_id and a.stream = b.stream "
            f"and b.period_start = date_add(a.period_end, 1) where a.emp_id = p.emp_id and a.stream = :stream "
            f"and a.value_rank >= {step} and b.value_rank >= {step})", {"stream": stream, "least": at_least})


def never_value(value: str, stream: str) -> tuple[str, dict]:
    """Has records in the stream and none of them is `value`: no record at all does not qualify."""
    return ("exists (select 1 from rating r where r.emp_id = p.emp_id and r.stream = :stream) and not exists "
            "(select 1 from rating r where r.emp_id = p.emp_id and r.stream = :stream and r.value = :value)",
            {"stream": stream, "value": value})


def in_status(value: str, stream: str, on: str) -> tuple[str, dict]:
    """In a state on a day; an open end still holds."""
    return ("exists (select 1 from status s where s.emp_id = p.emp_id and s.stream = :stream and s.value = :value "
            "and s.valid_from <= to_date(:day) and (s.valid_to is null or s.valid_to >= to_date(:day)))",
            {"stream": stream, "value": value, "day": on})


def adjacent_pairs(ratings: DataFrame, least_rank: int) -> DataFrame:
    """(emp_id, stream): two adjacent good periods, as an equi join on the day after the first one ends."""
    good = ratings.filter(F.col("value_rank") >= least_rank).select("emp_id", "stream", "period_start", "period_end").distinct()
    after = good.select("emp_id", "stream", F.date_add("period_end", 1).alias("period_start")).distinct()
    return good.join(after, ["emp_id", "stream", "period_start"], "left_semi").select("emp_id", "stream").distinct()


# --- verdicts ----------------------------------------------------------------------------------------
def save_verdicts(stored: DataFrame, new: DataFrame, order: Column) -> DataFrame:
    """Stored verdicts plus new ones; the first verdict on the same content under the same criterion stands."""
    key = ["root", "criterion_key", "content"]
    fresh = first_write(new, key, order).select(*key, "fits").join(stored.select(key), key, "left_anti")
    return stored.select(*key, "fits").unionByName(fresh)
