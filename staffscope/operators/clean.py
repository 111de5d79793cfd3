"""Cleaning and validation: ordered reject rules, profiles, bands, streams, scales, periodic records."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import ABSENT, INVALID, duration_months, parse_date
from ..functions.text import blank_to_null, org_path, trim_unicode
from ..session import literal_table, with_scalars
from ..schema import (COMPANY_META, EDUCATION_LADDER, EDUCATION_STREAM, LEVEL_STREAM, RECORD_KINDS,
                      UNEMPLOYED_TITLE)


class CorpusError(ValueError):
    """The source contradicts itself; the whole run is refused."""


# --- reject with report -------------------------------------------------------------------
def with_reason(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """`reject_reason`: the first rule a row breaks, NULL for a good row. One expression, one pass."""
    reason = F
    for why, bad in rules:
        reason = reason.when(F.coalesce(bad, F.lit(False)), why)
    return df.withColumn("reject_reason", reason.otherwise(F.lit(None).cast("string")))


def kept(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejects(df: DataFrame) -> DataFrame:
    return (df.filter(F.col("reject_reason").isNotNull()).groupBy("reject_reason")
            .agg(F.count("*").alias("rows")))


def reject(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    marked = with_reason(df, rules)
    return kept(marked), rejects(marked)


# --- segments from the two sources ----------------------------------------------------------
def _parsed(df: DataFrame) -> DataFrame:
    return (df.withColumn("_start", parse_date(F.col("start_date")))
            .withColumn("_end", parse_date(F.col("end_date"))))


def _unreadable() -> Column:
    return (F.col("_start.state") == INVALID) | (F.col("_end.state") == INVALID)


def mark_internal(df: DataFrame, as_of: date) -> DataFrame:
    """Assignments with trimmed text, typed dates and the first broken rule."""
    today = F.lit(as_of)
    marked = with_reason(_parsed(df), [
        ("invalid_date", _unreadable()),
        ("missing_start", F.col("_start.state") == ABSENT),
        ("start_in_future", F.col("_start.value") > today),
        ("end_in_future", F.col("_end.value") > today),
        ("inverted", F.col("_end.value") < F.col("_start.value")),
    ])
    text = [trim_unicode(F.col(c)).alias(c) for c in ("department", "title", "level", "seq_l1", "seq_l2", "seq_l3",
                                                      "segment_key")]
    return marked.select(trim_unicode(F.col("emp_id")).alias("emp_id"), F.col("_start.value").alias("start_date"),
                         F.col("_end.value").alias("end_date"), org_path(F.col("department_path")).alias("department_path"),
                         *text, "reject_reason")


def clean_internal(df: DataFrame, as_of: date) -> tuple[DataFrame, DataFrame]:
    marked = mark_internal(df, as_of)
    return kept(marked), rejects(marked)


def company_meta(tag: Column, nature: Column) -> Column:
    """The members that are present; NULL when none is."""
    members = F.struct(blank_to_null(tag).alias("company_tag"), blank_to_null(nature).alias("nature"))
    return F.when((tag != "") | (nature != ""), members).otherwise(F.lit(None).cast(COMPANY_META))


def mark_external(df: DataFrame, profiles: DataFrame, as_of: date) -> DataFrame:
    """Earlier jobs: an open end closes at the hire date, and nothing may reach past it."""
    today = F.lit(as_of)
    hires = profiles.select(F.col("emp_id").alias("_emp"), F.col("hire_date").alias("_hire"))
    joined = (_parsed(df).withColumn("emp_id", trim_unicode(F.col("emp_id")))
              .join(hires, F.col("emp_id") == F.col("_emp"), "left")
              .withColumn("_closed", F.coalesce("_end.value", "_hire")))
    marked = with_reason(joined, [
        ("invalid_date", _unreadable()),
        ("missing_start", F.col("_start.state") == ABSENT),
        ("no_end_and_no_hire_date", F.col("_closed").isNull()),
        ("inverted", F.col("_closed") < F.col("_start.value")),
        ("start_in_future", F.col("_start.value") > today),
        ("end_in_future", F.col("_closed") > today),
        ("end_after_hire", F.col("_closed") > F.col("_hire")),
    ])
    idle = F.col("unemployed")
    text = {c: trim_unicode(F.col(c)) for c in ("company", "title", "description", "company_tag", "nature")}
    return marked.select(
        "emp_id", F.col("_start.value").alias("start_date"), F.col("_closed").alias("end_date"),
        text["company"].alias("company"),
        F.when(idle, UNEMPLOYED_TITLE).otherwise(text["title"]).alias("title"),
        F.when(idle, "").otherwise(text["description"]).alias("description"),
        company_meta(text["company_tag"], text["nature"]).alias("company_meta"), "unemployed",
        duration_months(F.col("_start.value"), F.col("_closed")).alias("months"), "reject_reason")


def clean_external(df: DataFrame, profiles: DataFrame, as_of: date) -> tuple[DataFrame, DataFrame]:
    marked = mark_external(df, profiles, as_of)
    return kept(marked), rejects(marked)


# --- people ------------------------------------------------------------------------------------
def education_rank(col: Column) -> Column:
    """Position on the five-step ladder, from 1; NULL off the ladder."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in EDUCATION_LADDER]), col), F.lit(0)).cast("int")


def mark_profiles(df: DataFrame) -> DataFrame:
    """Typed profiles; `hire_unreadable` and `education_off` say what was blanked."""
    hire = parse_date(F.col("hire_date"))
    education = trim_unicode(F.col("education_level"))
    known = (education == "") | education_rank(education).isNotNull()
    shaped = df.select(
        trim_unicode(F.col("emp_id")).alias("emp_id"), trim_unicode(F.col("name")).alias("name"),
        hire["value"].alias("hire_date"), F.when(known, education).otherwise("").alias("education_level"),
        trim_unicode(F.col("school")).alias("school"), trim_unicode(F.col("school_tier")).alias("school_tier"),
        "overseas_educated", trim_unicode(F.col("recruitment")).alias("recruitment"),
        (hire["state"] == INVALID).alias("hire_unreadable"), F.when(~known, education).alias("education_off"))
    return with_reason(shaped, [("missing_emp_id", F.col("emp_id") == "")])


PROFILE_COLUMNS = ["emp_id", "name", "hire_date", "education_level", "school", "school_tier", "overseas_educated",
                   "recruitment"]


def clean_profiles(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = mark_profiles(df)
    return kept(marked).select(PROFILE_COLUMNS), rejects(marked)


def profile_report(marked: DataFrame) -> DataFrame:
    """(what, value, rows) of `mark_profiles` rows: hire dates that nobody can read, education off the ladder by what it says.

    Counted over the rows as they come, from one aggregate by off-ladder value. It is a plain aggregate, not a metric of
    the pass: a metric counts a task again that a lost executor repeats.
    """
    by_value = marked.groupBy("education_off").agg(F.count("*").alias("rows"), F.count_if("hire_unreadable").alias("hire"))
    off = F.when(F.col("education_off").isNotNull(), F.struct(F.lit("education_off_ladder").alias("what"), F.col("education_off").alias("value"), F.col("rows")))
    hire = F.struct(F.lit("hire_date_unreadable").alias("what"), F.lit(None).cast("string").alias("value"), F.col("hire").alias("rows"))
    lines = by_value.select(F.explode(F.filter(F.array(off, hire), lambda line: line.isNotNull())).alias("line"))
    return lines.groupBy("line.what", "line.value").agg(F.sum("line.rows").alias("rows"))


def profile_repeats(df: DataFrame) -> DataFrame:
    """One row: profile rows that say exactly what another one says."""
    same = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    return same.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_rows"))


def unique_profiles(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact repeats collapse; a person whose rows still differ leaves, and is listed in the second result."""
    distinct = df.dropDuplicates()
    rows = distinct.groupBy("emp_id").agg(F.count("*").alias("rows"))
    conflicts = rows.filter("rows > 1")
    return distinct.join(rows.filter("rows = 1").select("emp_id"), "emp_id", "left_semi"), conflicts


def in_population(df: DataFrame, population: DataFrame) -> DataFrame:
    """Child rows whose trimmed id belongs to the population."""
    return (df.withColumn("emp_id", trim_unicode(F.col("emp_id")))
            .join(population.select("emp_id"), "emp_id", "left_semi"))


def whole_number(col: Column) -> Column:
    """The integer a text spells canonically, else NULL."""
    text = trim_unicode(col)
    number = text.try_cast("int")
    return F.when(number.cast("string") == text, number)


def _refuse(checks: DataFrame, what: str) -> None:
    """Raise when a one-row frame of named counters has a counter above zero."""
    row = checks.collect()[0].asDict()
    broken = {name: n for name, n in row.items() if n}
    if broken:
        raise CorpusError(f"{what}: " + ", ".join(f"{name} {n}" for name, n in broken.items()))


def shaped_levels(df: DataFrame) -> DataFrame:
    return df.select(trim_unicode(F.col("level")).alias("level"), trim_unicode(F.col("band")).alias("band"),
                     whole_number(F.col("rank")).alias("rank"))


def level_problems(levels: DataFrame) -> DataFrame:
    """One row of counters: incomplete rows, levels in two bands, bands with two heights."""
    row = levels.agg(F.count_if((F.col("level") == "") | (F.col("band") == "") | F.col("rank").isNull())
                     .alias("incomplete"))
    twice = (levels.groupBy("level").agg(F.count_distinct("band", "rank").alias("n")).filter("n > 1")
             .agg(F.count("*").alias("level_in_two_bands")))
    heights = (levels.groupBy("band").agg(F.count_distinct("rank").alias("n")).filter("n > 1")
               .agg(F.count("*").alias("band_with_two_heights")))
    return with_scalars(with_scalars(row, twice), heights)


def level_bands(df: DataFrame) -> DataFrame:
    """level → band, rank; any contradiction refuses the run."""
    levels = shaped_levels(df)
    _refuse(level_problems(levels), "levels")
    return levels.dropDuplicates(["level"])


def shaped_streams(df: DataFrame) -> DataFrame:
    return df.select([trim_unicode(F.col(c)).alias(c) for c in ("stream", "kind", "label", "period", "notes")])


def record_streams(df: DataFrame) -> DataFrame:
    streams = shaped_streams(df)
    one = streams.agg(
        F.count_if((F.col("stream") == "") | (F.col("label") == "")).alias("incomplete"),
        F.count_if(F.col("stream").isin(LEVEL_STREAM, EDUCATION_STREAM)).alias("reserved"),
        F.count_if(~F.col("kind").isin(*RECORD_KINDS)).alias("unknown_kind"),
        (F.count("*") - F.count_distinct("stream")).alias("declared_twice"))
    _refuse(one, "streams")
    return streams


def ladder(spark) -> DataFrame:
    return literal_table(spark, [(EDUCATION_STREAM, v, at + 1) for at, v in enumerate(EDUCATION_LADDER)],
                                 "stream string, value string, rank int")


def scale_union(bands: DataFrame, rating_scale: DataFrame) -> DataFrame:
    """Level bands, the education ladder and the scales of the rating streams in one table."""
    levels = bands.select(F.lit(LEVEL_STREAM).alias("stream"), F.col("band").alias("value"), "rank").distinct()
    return levels.unionByName(ladder(bands.sparkSession)).unionByName(rating_scale)


def scale_rows(bands: DataFrame, streams: DataFrame, df: DataFrame) -> DataFrame:
    shaped = df.select(trim_unicode(F.col("stream")).alias("stream"), trim_unicode(F.col("value")).alias("value"),
                       whole_number(F.col("rank")).alias("rank"))
    ratings = streams.filter("kind = 'rating'").select("stream")
    undeclared = shaped.join(ratings, "stream", "left_anti").agg(F.count("*").alias("not_a_rating_stream"))
    one = shaped.agg(
        F.count_if((F.col("stream") == "") | (F.col("value") == "") | F.col("rank").isNull()).alias("incomplete"),
        (F.count("*") - F.count_distinct("stream", "value")).alias("declared_twice"))
    _refuse(with_scalars(one, undeclared), "scales")
    return scale_union(bands, shaped)


# --- periodic records -----------------------------------------------------------------------------
def mark_records(df: DataFrame, streams: DataFrame, scale: DataFrame, as_of: date) -> DataFrame:
    kinds = streams.select("stream", "kind")
    steps = scale.select("stream", F.col("value"), F.lit(True).alias("_on_scale"))
    rows = (df.select(trim_unicode(F.col("emp_id")).alias("emp_id"), trim_unicode(F.col("stream")).alias("stream"),
                      trim_unicode(F.col("value")).alias("value"), parse_date(F.col("period_start")).alias("_start"),
                      parse_date(F.col("period_end")).alias("_end"), parse_date(F.col("recorded_at")).alias("_at"))
            .join(kinds, "stream", "left").join(steps, ["stream", "value"], "left"))
    rating = F.col("kind") == "rating"
    return with_reason(rows, [
        ("unknown_stream", F.col("kind").isNull()),
        ("invalid_date", _unreadable() | (F.col("_at.state") == INVALID)),
        ("missing_start", F.col("_start.state") == ABSENT),
        ("inverted", F.col("_end.value") < F.col("_start.value")),
        ("start_in_future", F.col("_start.value") > F.lit(as_of)),
        ("rating_without_end", rating & F.col("_end.value").isNull()),
        ("rating_off_scale", rating & F.col("_on_scale").isNull()),
        ("blank_value", F.col("value") == ""),
    ]).select("emp_id", "stream", "value", F.col("_start.value").alias("period_start"),
              F.col("_end.value").alias("period_end"), F.col("_at.value").alias("recorded_at"), "reject_reason")


def clean_records(df, streams, scale, as_of) -> tuple[DataFrame, DataFrame]:
    marked = mark_records(df, streams, scale, as_of)
    return kept(marked), rejects(marked)


def revisions(df: DataFrame) -> DataFrame:
    """One row per (person, stream, period): how many revisions, and the latest one when it is decided.

    Two hash aggregations; no group is ever brought together as a list, so a person with very many revisions
    costs no more than a few partial sums per task.
    """
    period = ["emp_id", "stream", "period_start"]
    distinct = df.select(*period, "value", "period_end", "recorded_at").distinct()
    by_day = distinct.groupBy(*period, "recorded_at").agg(
        F.count("*").alias("n"), F.max("value").alias("value"), F.max("period_end").alias("period_end"))
    latest = F.max_by(F.struct("n", "value", "period_end"), F.col("recorded_at"))
    groups = by_day.groupBy(*period).agg(
        F.sum("n").alias("revisions"),
        F.sum(F.when(F.col("recorded_at").isNull(), F.col("n")).otherwise(0)).alias("undated"),
        latest.alias("_latest"),
        F.max(F.struct("n", "value", "period_end")).alias("_only"))
    single = F.col("revisions") == 1
    decided = single | ((F.col("undated") == 0) & (F.col("_latest.n") == 1))
    chosen = F.when(single, F.col("_only")).otherwise(F.col("_latest"))
    return groups.select(*period, "revisions", decided.alias("decided"),
                         F.when(decided, chosen["value"]).alias("value"),
                         F.when(decided, chosen["period_end"]).alias("period_end"))


def dedup_revisions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Final records, and a one-row report of revised and undecidable periods."""
    groups = revisions(df)
    report = groups.agg(F.count_if(F.col("revisions") > 1).alias("revised"),
                        F.count_if(~F.col("decided")).alias("ambiguous"))
    return groups.filter("decided").select("emp_id", "stream", "period_start", "period_end", "value"), report


# --- current position ---------------------------------------------------------------------------
def build_employee(profiles: DataFrame, internal: DataFrame, bands: DataFrame) -> DataFrame:
    """Profiles with the current position taken from the single open assignment, if there is just one."""
    fields = ["department", "department_path", "title", "seq_l1", "seq_l2", "seq_l3", "level"]
    open_now = internal.filter(F.col("end_date").isNull()).groupBy("emp_id").agg(
        F.count("*").alias("_open"), F.max(F.struct(*fields)).alias("_cur"))
    level = bands.select(F.col("level").alias("cur_level"), F.col("band").alias("_band"), F.col("rank").alias("_rank"))
    one = F.col("_open") == 1
    cur = {f: F.coalesce(F.when(one, F.col(f"_cur.{f}")), F.lit("")) for f in fields}
    return (profiles.join(open_now, "emp_id", "left").select(
        "emp_id", "name", cur["department"].alias("cur_dept"), cur["department_path"].alias("cur_dept_path"),
        cur["title"].alias("cur_title"), cur["seq_l1"].alias("cur_seq_l1"), cur["seq_l2"].alias("cur_seq_l2"),
        cur["seq_l3"].alias("cur_seq_l3"), cur["level"].alias("cur_level"), "hire_date", "education_level",
        education_rank(F.col("education_level")).alias("education_rank"), "school", "school_tier",
        "overseas_educated", "recruitment", (F.coalesce("_open", F.lit(0)) > 1).alias("position_conflict"))
        .join(level, "cur_level", "left")
        .withColumn("cur_level_band", F.coalesce("_band", F.lit("")))
        .withColumn("cur_level_rank", F.col("_rank")).drop("_band", "_rank"))


def unknown_levels(employee: DataFrame) -> DataFrame:
    """(level, people): present levels the level table does not have."""
    return (employee.filter((F.col("cur_level") != "") & F.col("cur_level_rank").isNull())
            .groupBy(F.col("cur_level").alias("level")).agg(F.count("*").alias("people")))


def position_report(employee: DataFrame) -> DataFrame:
    return employee.agg(
        F.count_if("position_conflict").alias("position_conflicts"),
        F.count_if((F.col("cur_level") != "") & F.col("cur_level_rank").isNull()).alias("levels_without_band"),
        F.count_if(F.col("cur_dept_path") == "").alias("people_without_path"))
