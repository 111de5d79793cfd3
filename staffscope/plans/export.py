"""The roster as a flat table: six fixed columns and one text of evidence per claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import dots
from ..schema import RESULT_PAGE
from .search import Search

# --- fixed values: labels readers see ------------------------------------------------------------
ROUTE_LABEL = {"role": "任职记录", "title": "岗位", "description": "简历原文", "skill": "技能"}
COLUMNS = ["序号", "工号", "姓名", "部门", "岗位", "职级"]


def years(months: Column) -> Column:
    """`4.5 年`; from ten years on whole years."""
    value = months / F.lit(12.0)
    return F.concat(F.when(value >= 9.95, F.round(value).cast("int").cast("string"))
                    .otherwise(F.format_string("%.1f", F.round(value, 1))), F.lit(" 年"))


def evidence_text() -> Column:
    """What counted and for how long, from the columns of evidence joined with its basis."""
    label = F.element_at(F.create_map(*[F.lit(x) for pair in ROUTE_LABEL.items() for x in pair]), F.col("route"))
    place = F.coalesce("company", "department")
    context = F.when(F.col("route") == "role", dots(F.col("seq_l1"), F.col("seq_l2"))).when(
        F.col("route") == "title", place).otherwise(dots(F.col("title"), place))
    value = (F.when(F.col("route") == "role", dots(F.col("title"), place)).when(F.col("route") == "title", F.col("title"))
             .when(F.col("route") == "skill", F.when(F.col("phrase").isNotNull(), dots(F.col("engagement"), F.col("phrase")))))
    head = F.concat_ws(" ", label, F.coalesce(value, F.when(F.col("route") != "description", context)))
    tenure = (F.when(F.col("segments") > 1, "累计").when(F.col("kind") == "external", "入职前").otherwise("公司内"))
    return dots(head, F.concat_ws(" ", tenure, years(F.col("basis_months"))))


def export_roster(search: Search, limit: int = RESULT_PAGE) -> DataFrame:
    """One row per person of the page; ids stay text, the only number is the rank."""
    page = search.roster(limit)
    rows = page.select("rank", "emp_id", "name", "cur_dept", "cur_title", "cur_level").toDF("rank", *COLUMNS[1:])
    out = rows.withColumnRenamed("rank", COLUMNS[0])
    if not search.claims:
        return out
    bases = page.select("emp_id", F.explode("basis").alias("b")).filter("b is not null").select(
        "emp_id", F.col("b.claim").alias("claim"), F.col("b.segments").alias("segments"), F.col("b.months").alias("basis_months"))
    best = search.evidence(limit).filter("place = 1").join(bases, ["emp_id", "claim"])
    texts = best.groupBy("emp_id").agg(*[
        F.max(F.when(F.col("claim") == at, evidence_text())).alias(claim["label"]) for at, claim in enumerate(search.claims)])
    return out.join(texts.withColumnRenamed("emp_id", COLUMNS[1]), COLUMNS[1], "left")
