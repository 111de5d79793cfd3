"""Gold cases from JSON files, refused when a case contradicts itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# --- fixed values: the four shapes -----------------------------------------------------------------
TEXTS = "array<string>"
SHAPES = {
    "search": "name string, query string, expect array<string>, reject array<string>",
    "extract": "name string, title string, company string, description string, "
               "gold array<struct<words:array<string>,depth:array<string>>>, ok array<string>, keep array<string>, reject array<string>",
    "review": "name string, words array<struct<word:string,people:bigint>>, found array<array<string>>, "
              "notFound array<array<string>>, excluded array<string>",
    "understand": "name string, say string, base string, history string, add string, drop array<string>, has string, "
                  "together string, apart string, includes array<string>, excludes array<string>, before string, evidence string",
}


class CaseError(ValueError):
    """A gold case cannot be scored."""


def _problems(kind: str):
    none = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)) <= 0
    rules = {"no name": F.coalesce(F.col("name"), F.lit("")) == ""}
    if kind == "search":
        rules["no query"] = F.coalesce(F.col("query"), F.lit("")) == ""
        rules["nobody expected"] = none("expect")
        rules["expected twice"] = F.size("expect") != F.size(F.array_distinct("expect"))
        rules["expected and rejected"] = F.coalesce(F.arrays_overlap("expect", "reject"), F.lit(False))
    if kind == "extract":
        rules["no answer"] = none("gold") & none("keep") & none("reject")
        rules["an item without words"] = F.coalesce(F.exists("gold", lambda g: F.size(g["words"]) == 0), F.lit(False))
    if kind == "review":
        rules["no words"] = none("words")
        rules["a word twice"] = F.size("words") != F.size(F.array_distinct(F.transform("words", lambda w: w["word"])))
        rules["no answer"] = none("found") & none("notFound") & none("excluded")
    if kind == "understand":
        rules["nothing said"] = F.coalesce(F.col("say"), F.lit("")) == ""
        rules["included and excluded"] = F.coalesce(F.arrays_overlap("includes", "excludes"), F.lit(False))
    return rules


def read_cases(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Cases of one kind: 'search', 'extract', 'review' or 'understand'."""
    df = spark.read.schema(SHAPES[kind]).json(path, multiLine=True)
    reason = F
    for what, bad in _problems(kind).items():
        reason = reason.when(F.coalesce(bad, F.lit(False)), what)
    wrong = df.select("name", reason.otherwise(None).alias("why")).filter("why is not null").limit(5).collect()
    if wrong:
        raise CaseError("; ".join(f"{row['name']}: {row['why']}" for row in wrong))
    twice = df.groupBy("name").count().filter("count > 1").limit(5).collect()
    if twice:
        raise CaseError("named twice: " + ", ".join(row["name"] for row in twice))
    return df
