"""Search chains, task runs and the audit trail."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import contains_ci
from .trees import depths

LEASE_SECONDS = 60
HISTORY = 12


def thread(turns: DataFrame, turn_id: str) -> DataFrame:
    """The turns of one chain with `depth` from its root; sort by depth."""
    root = turns.filter(F.col("id") == turn_id).select("root_turn_id")
    chain = turns.join(root, "root_turn_id", "left_semi")
    return chain.join(depths(chain, "id", "parent_turn_id").select("id", "depth"), "id")


def last_turns(turns: DataFrame) -> DataFrame:
    """Turns nothing follows."""
    followed = turns.filter("parent_turn_id is not null").select(F.col("parent_turn_id").alias("id"))
    return turns.join(followed, "id", "left_anti")


def recent(turns: DataFrame, owner: str, size: int, after: tuple | None = None, when: str = "created_at") -> DataFrame:
    """The newest chains of one owner: last turn, its own or its parent's conditions, and the title of the root.

    `after` is the (time, id) of the last row seen. One row more than asked says whether there is a next page.
    """
    own = turns.filter(F.col("owner_id") == owner)
    rows = last_turns(own)
    if after is not None:
        rows = rows.filter((F.col(when) < F.lit(after[0])) | ((F.col(when) == F.lit(after[0])) & (F.col("id") < after[1])))
    page = rows.orderBy(F.desc(when), F.desc("id")).limit(size + 1)
    roots = own.select(F.col("id").alias("root_turn_id"), F.col("raw_text").alias("title"))
    parents = own.select(F.col("id").alias("parent_turn_id"), F.col("spec").alias("_spec"))
    return (page.join(roots, "root_turn_id").join(parents, "parent_turn_id", "left")
            .withColumn("spec", F.coalesce("spec", "_spec")).drop("_spec"))


def chains_of(turns: DataFrame, owner: str) -> DataFrame:
    return turns.filter((F.col("owner_id") == owner) & F.col("parent_turn_id").isNull()).agg(F.count("*").alias("total"))


def delete_chain(turns: DataFrame, turn_id: str, owner: str) -> DataFrame:
    """The log without the whole chain the owner's turn belongs to."""
    root = turns.filter((F.col("id") == turn_id) & (F.col("owner_id") == owner)).select("root_turn_id")
    return turns.join(root, "root_turn_id", "left_anti")


def turn_changes(turns: DataFrame, conditions: str = "conditions") -> DataFrame:
    """(id, added, removed, same): each turn against the one it follows.

    `conditions` is array<struct<key string, off boolean>>, the key holding id and content. Switching one off is
    no change, but makes it another table; so does another order.
    """
    before = turns.select(F.col("id").alias("parent_turn_id"), F.col(conditions).alias("_before"))
    joined = turns.join(before, "parent_turn_id")
    keys = lambda c: F.transform(c, lambda x: x["key"])
    return joined.select("id", F.array_except(keys(conditions), keys("_before")).alias("added"),
                         F.array_except(keys("_before"), keys(conditions)).alias("removed"),
                         (F.col(conditions) == F.col("_before")).alias("same"))


def history(turns: DataFrame, keep: int = HISTORY) -> DataFrame:
    """Per chain the first turn and the last `keep` - 1, with the number of turns left out between them.

    Both row numbers are cut to a few rows per chain before the shuffle.
    """
    first = F.row_number().over(Window.partitionBy("root_turn_id").orderBy("seq"))
    last = F.row_number().over(Window.partitionBy("root_turn_id").orderBy(F.desc("seq")))
    head = turns.withColumn("_n", first).filter("_n = 1").drop("_n")
    tail = turns.withColumn("_n", last).filter(F.col("_n") <= keep - 1).drop("_n")
    lengths = turns.groupBy("root_turn_id").agg(F.count("*").alias("_turns"))
    both = head.unionByName(tail).dropDuplicates(["id"])
    return both.join(lengths, "root_turn_id").withColumn("skipped", F.greatest(F.lit(0), F.col("_turns") - keep)).drop("_turns")


def attempt_status(now: datetime) -> Column:
    """'done', 'failed' (told or abandoned) or 'working' of a turn's current attempt."""
    beat = F.coalesce("attempt_heartbeat_at", "attempt_started_at")
    lost = beat < F.lit(now) - F.expr(f"interval {LEASE_SECONDS} seconds")
    return (F.when(F.col("attempt").isNull() | F.col("attempt_done"), "done")
            .when(F.col("attempt_fault").isNotNull() | lost, "failed").otherwise("working"))


def task_lanes(runs: DataFrame, pages: dict[str, int] | None = None, size: int = 10) -> DataFrame:
    """A page of runs per kind, newest first, with the number of runs of that kind and each run's outcome."""
    total = runs.groupBy("kind").agg(F.count("*").alias("total"))
    asked = max((pages or {}).values(), default=1)
    want = F.lit(1)
    for kind, page in (pages or {}).items():
        want = F.when(F.col("kind") == kind, page).otherwise(want)
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("started_at"), F.desc("id")))
    # the constant bound lets every task drop all but a few rows per kind before the shuffle
    newest = runs.withColumn("n", place).filter(F.col("n") <= asked * size)
    shown = newest.join(total, "kind").withColumn("page", F.least(want, F.greatest(F.lit(1), F.ceil(F.col("total") / size))))
    shown = shown.filter((F.col("n") > (F.col("page") - 1) * size) & (F.col("n") <= F.col("page") * size))
    outcome = F.when(F.col("seconds").isNull(), "running").when(F.col("error").isNotNull(), "failed").otherwise("done")
    return shown.withColumn("outcome", outcome).drop("page")


def list_audit(events: DataFrame, accounts: DataFrame, employee: DataFrame, text: str, page: int = 1, size: int = 50) -> DataFrame:
    """One page of audit rows that mention the text in any of their fields, newest first.

    Accounts and people that mention it are found first. Each way to mention it gives its newest rows, as many as the
    page reaches, by semi-joins alone; names are joined to the rows of the page.
    """
    says = lambda *columns: reduce(or_, [F.coalesce(contains_ci(F.col(c), text), F.lit(False)) for c in columns])
    known = events.join(accounts.select("user_id"), "user_id", "left_semi")
    users = accounts.filter(says("username", "display")).select("user_id")
    people = employee.filter(says("name")).select("emp_id")
    ways = [known.filter(says("emp_id", "text")), known.join(users, "user_id", "left_semi"), known.join(people, "emp_id", "left_semi"),
            known.join(users.withColumnRenamed("user_id", "account_id"), "account_id", "left_semi")]
    newest = [way.select(events.columns).orderBy(F.desc("id")).limit(page * size) for way in ways]
    shown = reduce(DataFrame.unionAll, newest).dropDuplicates(["id"]).orderBy(F.desc("id")).offset((page - 1) * size).limit(size)
    who = accounts.select("user_id", "username", F.col("display").alias("user_name"))
    target = accounts.select(F.col("user_id").alias("account_id"), F.col("username").alias("account_username"), F.col("display").alias("account_name"))
    named = employee.select("emp_id", F.col("name").alias("emp_name"))
    return shown.join(who, "user_id").join(named, "emp_id", "left").join(target, "account_id", "left").orderBy(F.desc("id"))


def audit_rows(user_id: str, action: str, at: datetime, subjects: DataFrame) -> DataFrame:
    """One row per exported or viewed person, to be appended to the trail."""
    return subjects.select(F.lit(at).cast("timestamp").alias("at"), F.lit(user_id).alias("user_id"), F.lit(action).alias("action"),
                           "emp_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("account_id"))


def audit_append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
