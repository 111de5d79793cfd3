"""Reconciling a stored corpus with a newly built one, and auditing its constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


# --- reconcile --------------------------------------------------------------------------------
DERIVED = ["seq_inferred_l1", "seq_inferred_l2", "derived_identity", "unanswered"]


def reconcile_experience(current: DataFrame, staged: DataFrame) -> DataFrame:
    """The next segments: same content keeps what was derived and takes the new months; the rest is new."""
    carried = current.select("content_key", *[F.col(c).alias(f"_{c}") for c in DERIVED], F.lit(True).alias("_known"))
    joined = staged.join(carried, "content_key", "left")
    kept = {c: F.when(F.col("_known"), F.col(f"_{c}")).otherwise(F.col(c)) for c in DERIVED}
    return joined.withColumns(kept).select(staged.columns)


def reconcile_counts(current: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """One row: keys that go, that stay and that are new."""
    sides = (current.select(F.col(key).alias("k"), F.lit(1).alias("old"), F.lit(0).alias("new"))
             .unionByName(staged.select(F.col(key).alias("k"), F.lit(0).alias("old"), F.lit(1).alias("new")))
             .groupBy("k").agg(F.max("old").alias("old"), F.max("new").alias("new")))
    return sides.agg(F.count_if(F.expr("old = 1 and new = 0")).alias("gone"), F.count_if(F.expr("old = 1 and new = 1")).alias("same"),
                     F.count_if(F.expr("old = 0 and new = 1")).alias("added"))


def reconcile_edges(edges: DataFrame, experience: DataFrame) -> DataFrame:
    """Edges of segments that are still there."""
    return edges.join(experience.select(F.col("id").alias("experience_id")), "experience_id", "left_semi")


# --- constraints --------------------------------------------------------------------------------
def _filled(name):
    return F.coalesce(F.col(name), F.lit("")) != ""


def _rules():
    c = F.col
    return {
        "employee": {
            "level_band_ranked": _filled("cur_level_band") == c("cur_level_rank").isNotNull(),
            "education_ranked": _filled("education_level") == c("education_rank").isNotNull(),
        },
        "experience": {
            "unanswered_derived": ~c("unanswered") | c("derived_identity").isNotNull(),
            "kind_valid": c("kind").isin("internal", "external"),
            "place_by_kind": F.when(c("kind") == "internal", c("company") == "")
                              .otherwise((c("department") == "") & (c("department_path") == "")),
            "unemployed_external": ~c("unemployed") | (c("kind") == "external"),
            "months_positive": c("months") > 0,
            "dates_ordered": c("end_date").isNull() | (c("end_date") >= c("start_date")),
        },
        "record_stream": {"kind_valid": c("kind").isin("rating", "status")},
        "employee_record": {"period_ordered": c("period_end").isNull() | (c("period_end") >= c("period_start"))},
        "term": {
            "parent_on_canonical": c("parent").isNull() | ((c("canonical") == c("word")) & (c("parent") != c("word"))),
            "excluded_alone": ~c("excluded") | ((c("canonical") == c("word")) & c("parent").isNull()),
        },
        "review_word": {"judged": c("judge").isNull() == c("judgment").isNull()},
        "experience_phrase": {
            "route_valid": c("route").isin("role", "title", "description", "skill"),
            "engagement_on_skill": c("engagement").isNull() | (c("route") == "skill"),
            "engagement_valid": c("engagement").isNull() | c("engagement").isin("主导", "做过", "提到"),
        },
        "audit_event": {
            "one_object": (c("emp_id").isNotNull().cast("int") + c("text").isNotNull().cast("int")
                           + c("account_id").isNotNull().cast("int")) == 1,
        },
        "search_turn": {"done_without_fault": ~c("attempt_done") | c("attempt_fault").isNull()},
    }


KEYS = {
    "employee": ["emp_id"], "experience": ["content_key"], "record_stream": ["stream"], "scale": ["stream", "value"],
    "employee_record": ["emp_id", "stream", "period_start"], "industry": ["name"], "company": ["name"],
    "company_alias": ["raw_name"], "phrase": ["id"], "experience_phrase": ["experience_id", "route", "phrase_id"],
    "term": ["word"], "review_word": ["word"], "experience_verdict": ["root", "criterion_key", "content"],
}
REFERENCES = [
    ("experience", "emp_id", "employee", "emp_id"), ("employee_record", "emp_id", "employee", "emp_id"),
    ("employee_record", "stream", "record_stream", "stream"), ("industry", "parent", "industry", "name"),
    ("company_alias", "company", "company", "name"), ("experience_phrase", "experience_id", "experience", "id"),
    ("experience_phrase", "phrase_id", "phrase", "id"), ("term", "parent", "term", "word"),
]


def check_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, constraint, violations) for every rule, key and reference of the tables given."""
    rules, given = _rules(), {}
    for table, df in tables.items():
        asked = [*KEYS.get(table, []), *[column for name, column, target, _ in REFERENCES if name == table and target in tables],
                 *[key for name, _, target, key in REFERENCES if target == table and name in tables]]
        broken = [(~F.coalesce(ok, F.lit(False))).alias(f"!{name}") for name, ok in rules.get(table, {}).items()]
        # read once: what is asked below is a few names and a flag for each rule
        given[table] = cut_lineage(df.select(*dict.fromkeys(asked), *broken)) if asked or broken else df
    found = []
    for table, named in rules.items():
        if table not in tables:
            continue
        counts = given[table].agg(*[F.count_if(F.col(f"`!{name}`")).alias(name) for name in named])
        pairs = ", ".join(f"'{name}', `{name}`" for name in named)
        found.append(counts.selectExpr(f"'{table}' as `table`", f"stack({len(named)}, {pairs}) as (constraint, violations)"))
    for table, key in KEYS.items():
        if table in tables:
            twice = given[table].groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
            found.append(twice.agg(F.count("*").alias("violations"))
                         .select(F.lit(table).alias("table"), F.lit("key").alias("constraint"), "violations"))
    for table, column, target, key in REFERENCES:
        if table in tables and target in tables:
            lost = (given[table].filter(F.col(column).isNotNull())
                    .join(given[target].select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti"))
            found.append(lost.agg(F.count("*").alias("violations"))
                         .select(F.lit(table).alias("table"), F.lit(f"{column} in {target}").alias("constraint"), "violations"))
    return reduce(DataFrame.unionByName, found)
