"""Checking a query before it is offered: what cannot run, finds nobody or is worded for machines."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException, ParseException, SparkRuntimeException
from pyspark.sql import DataFrame, functions as F

from ..session import LazyTables, literal_table
from .query import Query
from .search import Search

# --- fixed values: words readers should not see, and product words that contain them ---------------
INTERNAL_WORDS = ("库里", "词表", "条件表", "空表", "端点", "查询理解", "模型", "字段", "工具", "接着说", "这一轮", "读成",
                  "查词", "核对", "敲")
PRODUCT_WORDS = ("人才库",)


def worded_for_machines(label: str) -> bool:
    for word in PRODUCT_WORDS:
        label = label.replace(word, "")
    return any(word in label for word in INTERNAL_WORDS)


def runs(search: Search, at: int) -> bool:
    """Whether Spark accepts the condition: its patterns are tried on one empty text, then its plan is
    analysed over relations without rows."""
    condition = search.query.conditions[at]
    spark = search.views["person"].sparkSession
    try:
        for pattern in condition.seek.patterns if condition.seek else ():
            literal_table(spark, [("",)], "text string").select(F.col("text").rlike(pattern)).collect()
        views = LazyTables({name: lambda name=name: search.views[name].limit(0) for name in search.views})
        alone = replace(search, views=views, query=Query((condition,)), filters=type(search.filters)(), reached=None, _kept=[])
        alone.selection().schema
        return True
    except (AnalysisException, ParseException, SparkRuntimeException):
        return False


def lint_query(search: Search, fact_limit: int | None = None) -> DataFrame:
    """(id, problem, hard). Hard problems must be fixed, soft ones only confirmed."""
    conditions = search.query.conditions
    found = []
    good = [at for at, c in enumerate(conditions) if c.off or runs(search, at)]
    for at, c in enumerate(conditions):
        if at not in good:
            found.append((c.id, "does_not_run", True))
        if worded_for_machines(c.label):
            found.append((c.id, "internal_words", True))
        if c.seek and not c.seek.criterion:
            found.append((c.id, "no_criterion", True))
    runnable = replace(search, query=Query(tuple(conditions[at] for at in good)), reached=None)
    for row in runnable.probe().filter("people = 0").collect():  # at most one row per condition
        c = runnable.query.conditions[row["cond"]]
        if c.mode != "exclude":
            found.append((c.id, "selects_nobody", False))
    if fact_limit is not None and runnable.claims:
        from .search import overflow_contributors
        for row in overflow_contributors(runnable.fact_counts(), fact_limit).collect():
            found.append((runnable.query.conditions[runnable.claims[row["claim"]]["cond"]].id, "too_broad", False))
    return literal_table(search.views["person"].sparkSession, found, "id string, problem string, hard boolean")
