"""Facets: for every value of eleven dimensions, how many people the roster would hold after picking it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import MIN_MONTHS_BUCKETS, NOT_A_VALUE

SEP = "\x01"


def _one(col: Column) -> Column:
    present = col.isNotNull() & ~col.isin(*NOT_A_VALUE)
    return F.when(present, F.array(col)).otherwise(F.array().cast("array<string>"))


def _many(col: Column) -> Column:
    return F.coalesce(col, F.array().cast("array<string>"))


def _buckets(months: Column) -> Column:
    steps = F.array(*[F.lit(str(b)) for b in MIN_MONTHS_BUCKETS])
    return F.when(months.isNull(), F.array().cast("array<string>")).otherwise(
        F.filter(steps, lambda b: months >= b.cast("int")))


def dimension_values() -> dict[str, Column]:
    """The values one fact carries in each dimension, in display order of the dimensions."""
    c = F.col
    pair = F.when(c("seq_l1").isNotNull() & (c("seq_l1") != "") & c("seq_l2").isNotNull() & (c("seq_l2") != ""),
                  F.array(F.concat("seq_l1", F.lit(SEP), "seq_l2"))).otherwise(F.array().cast("array<string>"))
    return {
        "seq": pair, "level": _one(c("level_band")),
        "kind": F.when(c("kind").isNull(), F.array().cast("array<string>")).otherwise(F.array("kind")),
        "min_months": _buckets(c("months")), "company_tag": _one(c("company_tag")),
        "industry": _many(c("main_industries")), "skill": _many(c("skills")), "recruitment": _one(c("recruitment")),
        "education": _one(c("education")), "school_tier": _one(c("school_tier")), "overseas": _one(c("overseas")),
    }


RANKED = {"level": "level_rank", "education": "education_rank"}


def picked(filters) -> dict[str, Column]:
    """dimension → whether a fact passes the filter on it; only dimensions that are filtered."""
    values, out = dimension_values(), {}
    for dim in values:
        chosen = getattr(filters, dim)
        if not chosen:
            continue
        if dim == "min_months":
            out[dim] = F.coalesce(F.col("months") >= int(chosen), F.lit(False))
        else:
            ids = [SEP.join(v) for v in chosen] if dim == "seq" else [chosen] if isinstance(chosen, str) else list(chosen)
            out[dim] = F.arrays_overlap(values[dim], F.array(*[F.lit(i) for i in ids]))
    return out


def passes(filters, except_dim: str | None = None) -> Column:
    ok = F.lit(True)
    for dim, holds in picked(filters).items():
        if dim != except_dim:
            ok = ok & holds
    return ok


def _entries(dim: str, values: Column, rank: Column, live: Column) -> Column:
    return F.transform(values, lambda value: F.struct(
        F.lit(dim).alias("dim"), value.alias("value"), rank.alias("rank"), live.alias("live")))


def explode_dimensions(facts: DataFrame, filters) -> DataFrame:
    """One row per fact, dimension and value; `live` is whether every other dimension's filter holds."""
    entries = []
    for dim, values in dimension_values().items():
        rank = F.col(RANKED[dim]) if dim in RANKED else F.lit(None).cast("int")
        live = passes(filters, dim)
        entries.append(_entries(dim, values, rank.cast("int"), live))
    keep = [c for c in ("emp_id", "claim", "months") if c in facts.columns]
    return facts.select(*keep, F.explode(F.flatten(F.array(*entries))).alias("d")).select(*keep, "d.*")


def facets(facts: DataFrame, claims: list[dict], filters) -> DataFrame:
    """(dim, value, n, rank) over facts (one row per claim and segment).

    A person counts for a value when the facts that have the value still complete every required claim. Values
    that never hold under the query are absent, values the filters empty out stay with zero.
    """
    must = [(at, claim.get("min_months")) for at, claim in enumerate(claims) if claim["mode"] == "must"]
    rows = explode_dimensions(facts, filters)
    sums = [F.min("rank").alias("rank")]
    for at, _ in must:
        mine = F.col("claim") == at
        sums += [F.count_if(mine).alias(f"n{at}"), F.sum(F.when(mine, F.col("months"))).alias(f"m{at}"),
                 F.count_if(mine & F.col("live")).alias(f"ln{at}"),
                 F.sum(F.when(mine & F.col("live"), F.col("months"))).alias(f"lm{at}")]
    people = rows.groupBy("dim", "value", "emp_id").agg(*sums)

    def complete(prefix):
        ok = F.lit(True)
        for at, least in must:
            ok = ok & (F.col(f"{prefix}n{at}") > 0)
            if least:
                ok = ok & (F.col(f"{prefix}m{at}") >= least)
        return F.coalesce(ok, F.lit(False))

    counted = people.groupBy("dim", "value").agg(
        F.count_if(complete("")).alias("domain"), F.count_if(complete("l")).alias("n"), F.min("rank").alias("rank"))
    return counted.filter("domain > 0").drop("domain")


def population_facets(rows: DataFrame, filters) -> DataFrame:
    """(dim, value, n, rank) over people and their segments, when no experience is required."""
    people = (explode_dimensions(rows, filters).groupBy("dim", "value", "emp_id")
              .agg(F.bool_or("live").alias("live"), F.min("rank").alias("rank")))
    return people.groupBy("dim", "value").agg(F.count_if("live").alias("n"), F.min("rank").alias("rank"))


def display_order(rows: DataFrame) -> DataFrame:
    """Dimensions in their order; ordered scales by rank, months by length, the rest by people, then name."""
    dims = F.array(*[F.lit(d) for d in dimension_values()])
    by_rank = F.when(F.col("dim").isin(*RANKED), F.coalesce("rank", F.lit(2147483647))).when(
        F.col("dim") == "min_months", F.col("value").try_cast("int"))
    by_count = F.when(~F.col("dim").isin("min_months", *RANKED), -F.col("n"))
    return rows.orderBy(F.array_position(dims, F.col("dim")), by_rank, by_count, F.collate("value", "zh_CN"))
