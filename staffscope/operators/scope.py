"""Who may see whom: organisations as whole path levels, joined by equality on every prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import contains_ci, org_path, org_prefixes
from ..schema import ORG_SEPARATOR
from ..session import cut_lineage
from .numbering import page


def scope_members(employee: DataFrame, account_scope: DataFrame) -> DataFrame:
    """(user_id, emp_id): people at an account's organisations or below them.

    Distinct department paths are expanded to their prefixes, so the prefix test is an equi join on the
    (small) set of paths and the people are joined once.
    """
    paths = employee.filter(F.col("cur_dept_path") != "").select("cur_dept_path").distinct()
    above = paths.select("cur_dept_path", F.explode(org_prefixes(F.col("cur_dept_path"))).alias("org_path"))
    seen = above.join(account_scope, "org_path").select("user_id", "cur_dept_path").distinct()
    return employee.join(seen, "cur_dept_path").select("user_id", "emp_id")


def visible(employee: DataFrame, account_scope: DataFrame, user_id: str | None) -> DataFrame:
    """People one account sees; everybody when no account is named, nobody for an unknown one."""
    if user_id is None:
        return employee.select("emp_id")
    return scope_members(employee, account_scope.filter(F.col("user_id") == user_id)).select("emp_id")


def owner_of_chain(turns: DataFrame, turn_id: str) -> str | None:
    row = turns.filter(F.col("id") == turn_id).select("owner_id").limit(1).collect()
    return row[0]["owner_id"] if row else None


def scoped(tables: dict[str, DataFrame], people: DataFrame) -> dict[str, DataFrame]:
    """The same tables with only these people's rows; edges follow their segments."""
    out = dict(tables)
    for name in ("employee", "experience", "employee_record"):
        if name in out:
            out[name] = out[name].join(people, "emp_id", "left_semi")
    if "experience_phrase" in out and "experience" in out:
        own = out["experience"].select(F.col("id").alias("experience_id"))
        out["experience_phrase"] = out["experience_phrase"].join(own, "experience_id", "left_semi")
    return out


def normalise_scopes(df: DataFrame) -> DataFrame:
    """(user_id, org_path): normal paths without repeats and without organisations another one contains.

    An account with a blank organisation has no valid scope and is left out.
    """
    paths = df.select("user_id", org_path(F.col("org_path")).alias("org_path")).distinct()
    bad = paths.filter(F.col("org_path") == "").select("user_id").distinct()
    good = paths.join(bad, "user_id", "left_anti")
    above = good.select("user_id", F.col("org_path").alias("inner"), F.explode(org_prefixes(F.col("org_path"))).alias("org_path"))
    contained = (above.filter(F.col("inner") != F.col("org_path")).join(good, ["user_id", "org_path"])
                 .select("user_id", F.col("inner").alias("org_path")).distinct())
    return good.join(contained, ["user_id", "org_path"], "left_anti")


def org_tree(employee: DataFrame) -> DataFrame:
    """(path, name, depth, people): every organisation with the people at it and below. People are counted per
    path first; only distinct paths are expanded. Sort by split(path, '>') for pre-order."""
    counts = (employee.filter(F.col("cur_dept_path") != "").groupBy("cur_dept_path").agg(F.count("*").alias("n")))
    levels = F.split(F.col("path"), ORG_SEPARATOR)
    return (counts.select(F.explode(org_prefixes(F.col("cur_dept_path"))).alias("path"), "n")
            .groupBy("path").agg(F.sum("n").alias("people"))
            .select("path", F.element_at(levels, -1).alias("name"), (F.size(levels) - 1).alias("depth"), "people"))


def pre_order(tree: DataFrame) -> DataFrame:
    return tree.orderBy(F.split("path", ORG_SEPARATOR))


def all_visible(people: DataFrame, emp_ids) -> bool:
    """Whether every one of these ids is among the visible people."""
    wanted = sorted(set(emp_ids))
    return people.filter(F.col("emp_id").isin(wanted)).distinct().count() == len(wanted)


def account_scopes(employee: DataFrame, account_scope: DataFrame) -> DataFrame:
    """(user_id, orgs, people) per account. People are counted per path first; accounts meet paths, not people."""
    at_path = employee.filter(F.col("cur_dept_path") != "").groupBy("cur_dept_path").agg(F.count("*").alias("n"))
    above = at_path.select("cur_dept_path", "n", F.explode(org_prefixes(F.col("cur_dept_path"))).alias("org_path"))
    seen = above.join(account_scope, "org_path").select("user_id", "cur_dept_path", "n").distinct()
    people = seen.groupBy("user_id").agg(F.sum("n").alias("people"))
    orgs = account_scope.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("org_path")), ",").alias("orgs"))
    return orgs.join(people, "user_id", "left").withColumn("people", F.coalesce("people", F.lit(0)))


def account_page(employee: DataFrame, account_scope: DataFrame, accounts: DataFrame, text: str = "", number: int = 1,
                 size: int = 50) -> tuple[DataFrame, dict]:
    """One page of the account table and its place: accounts whose user name or name has `text` in it, by user name, with
    their organisations and how many people these hold.

    `accounts` has (user_id, username, name). The page is cut first; paths and people are met for its accounts only.
    """
    wanted = text.strip()
    found = accounts.filter(contains_ci(F.col("username"), wanted) | contains_ci(F.coalesce("name", F.lit("")), wanted))
    shown, place = page(found.select("user_id", "username", "name"), [F.col("username"), F.col("user_id")], number, size)
    shown = cut_lineage(shown)
    mine = account_scope.join(shown.select("user_id"), "user_id", "left_semi")
    held = account_scopes(employee, mine)
    rows = shown.join(held, "user_id", "left").select(
        "user_id", "username", "name", F.coalesce("orgs", F.lit("")).alias("orgs"), F.coalesce("people", F.lit(0)).alias("people"))
    return rows.orderBy("username", "user_id"), place
