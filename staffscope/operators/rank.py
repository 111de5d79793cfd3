"""Ranking: what a person has on each claim, how deep it is, and the order of the roster."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import gap_months
from ..schema import (BOOST_WEIGHT, ENGAGEMENT_FACTOR, RECENCY_HALF, RESULT_PAGE, TENURE_HALF,
                      UNKNOWN_ENGAGEMENT_FACTOR)
from .numbering import numbered


def factor(route: Column, engagement: Column) -> Column:
    """How much a piece of evidence counts: only extracted skills are discounted by engagement."""
    graded = F
    for name, value in ENGAGEMENT_FACTOR.items():
        graded = graded.when(engagement == name, value)
    return F.when(route == "skill", graded.otherwise(UNKNOWN_ENGAGEMENT_FACTOR)).otherwise(1.0)


def best_hit(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (claim, segment): the most engaged hit, short phrases before whole descriptions."""
    order = [F.desc("factor"), F.col("route") == "description", F.col("route"), F.asc_nulls_last("phrase_id")]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return hits.withColumn("_n", rank).filter("_n = 1").drop("_n")


def basis(facts: DataFrame, by=("emp_id", "claim")) -> DataFrame:
    """Segments, months, latest end (NULL while one is open) and best factor per person and claim."""
    return facts.groupBy(*by).agg(
        F.count("*").alias("segments"), F.sum("months").alias("months"),
        F.when(F.bool_or(F.col("end_date").isNull()), F.lit(None)).otherwise(F.max("end_date")).cast("date").alias("end_date"),
        F.max("factor").alias("factor"))


def depth_of(factor_: Column, months: Column, end_date: Column, now: date) -> Column:
    """Engagement × saturating tenure × decaying recency."""
    tenure = months / (months + F.lit(TENURE_HALF))
    recency = F.lit(RECENCY_HALF) / (F.lit(RECENCY_HALF) + gap_months(end_date, now))
    return factor_ * tenure * recency


def claim_depth(based: DataFrame, now: date) -> DataFrame:
    return based.withColumn("depth", depth_of(F.col("factor"), F.col("months"), F.col("end_date"), now))


def enough_months(claims: list[dict]) -> Column:
    """Claims with a minimum need that many months in total; `claims` are dicts with mode and min_months."""
    ok = F.lit(True)
    for at, claim in enumerate(claims):
        if claim.get("min_months"):
            ok = ok & ((F.col("claim") != at) | (F.col("months") >= claim["min_months"]))
    return ok


def person_depth(facts: DataFrame, claims: list[dict], now: date, carry=()) -> DataFrame:
    """(emp_id, depth, complete, basis): everything about a person's claims from one aggregation by person.

    `carry` names attributes of the person; they depend on emp_id alone, so grouping by them too keeps the
    aggregation hash based.

    `complete` says whether every required claim has evidence. Claims are known when the plan is made, so each
    gets its own conditional aggregates; no row per claim is shuffled twice.
    """
    aggregates = []
    for at in range(len(claims)):
        mine = F.col("claim") == at
        aggregates += [
            F.count_if(mine).alias(f"n{at}"), F.sum(F.when(mine, F.col("months"))).alias(f"m{at}"),
            F.bool_or(mine & F.col("end_date").isNull()).alias(f"o{at}"),
            F.max(F.when(mine, F.col("end_date"))).alias(f"e{at}"), F.max(F.when(mine, F.col("factor"))).alias(f"f{at}")]
    grouped = facts.groupBy("emp_id", *carry).agg(*aggregates)
    depth, complete, bases = F.lit(1.0), F.lit(True), []
    for at, claim in enumerate(claims):
        has = F.col(f"n{at}") > 0
        if claim.get("min_months"):
            has = has & (F.col(f"m{at}") >= claim["min_months"])
        end = F.when(~F.col(f"o{at}"), F.col(f"e{at}"))
        value = depth_of(F.col(f"f{at}"), F.col(f"m{at}"), end, now)
        if claim["mode"] == "must":
            complete = complete & has
            depth = depth * value
        else:
            depth = depth * F.when(has, 1 + BOOST_WEIGHT * value).otherwise(1.0)
        bases.append(F.when(has, F.struct(F.lit(at).alias("claim"), F.col(f"n{at}").alias("segments"),
                                          F.col(f"m{at}").alias("months"), end.alias("end_date"))))
    empty = F.array().cast("array<struct<claim:int,segments:bigint,months:bigint,end_date:date>>")
    return grouped.select("emp_id", *carry, depth.alias("depth"), complete.alias("complete"),
                          (F.array(*bases) if bases else empty).alias("basis"))


def raise_by_preferences(people: DataFrame, preferences: list[str]) -> DataFrame:
    """Multiply depth once per preference flag that holds; NULL counts as no."""
    depth = F.col("depth")
    for flag in preferences:
        depth = depth * F.when(F.coalesce(F.col(flag), F.lit(False)), 1 + BOOST_WEIGHT).otherwise(1.0)
    return people.withColumn("depth", depth)


def in_order(people: DataFrame) -> DataFrame:
    return people.orderBy(F.desc("depth"), "emp_id")


def top(people: DataFrame, limit: int = RESULT_PAGE) -> DataFrame:
    """The first people of the roster: a top-k per task and one merge, never a full sort."""
    return in_order(people).limit(limit)


def numbered_page(page: DataFrame) -> DataFrame:
    """`rank` from 1 on a page that was cut already."""
    return page.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("depth"), "emp_id")))


def ranked_all(people: DataFrame) -> DataFrame:
    """`rank` from 1 over everybody, without bringing them together in one task."""
    return numbered(people, [F.desc("depth"), F.col("emp_id")], name="rank")


def ordered_evidence(facts: DataFrame, based: DataFrame, people: DataFrame) -> DataFrame:
    """Counted segments of satisfied claims for the people of a page, with their place within person and claim."""
    shown = facts.join(people.select("emp_id"), "emp_id", "left_semi").join(
        based.select("emp_id", "claim"), ["emp_id", "claim"], "left_semi")
    order = Window.partitionBy("emp_id", "claim").orderBy(F.desc("factor"), F.desc("months"), "id")
    return shown.withColumn("place", F.row_number().over(order))


def best_evidence(facts: DataFrame, based: DataFrame, people: DataFrame) -> DataFrame:
    return ordered_evidence(facts, based, people).filter("place = 1").drop("place")
