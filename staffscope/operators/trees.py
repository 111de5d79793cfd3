"""Forests kept as parent links: depth, ancestors, cycles.

Everything here doubles the distance covered per round, so a forest of depth d needs about log2(d) rounds.
Each round is written to the checkpoint folder, which keeps plans short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


class TreeError(ValueError):
    """A parent is missing, a name repeats or the links form a cycle."""


MAX_ROUNDS = 40  # a distance of 2^40 steps: only a cycle gets there


def closure(edges: DataFrame, node: str = "name", parent: str = "parent") -> DataFrame:
    """(name, ancestor, depth): every node with itself (depth 0) and everything above it.

    Four levels are covered by the first round, so the usual dictionary costs one write and one emptiness test.
    """
    links = cut_lineage(edges.select(F.col(node).alias("name"), F.col(parent).alias("up")).filter("name is not null"))

    def compose(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.select("name", F.col("up").alias("_mid")).join(
            b.select(F.col("name").alias("_mid"), "up"), "_mid").select("name", "up")

    def extend(pairs: DataFrame, jump: DataFrame, steps: int) -> DataFrame:
        """Pairs at distances below `steps`, plus those `steps` further up."""
        far = jump.select("name", F.col("up").alias("_mid")).join(
            pairs.select(F.col("name").alias("_mid"), "ancestor", "depth"), "_mid")
        return pairs.unionByName(far.select("name", "ancestor", (F.col("depth") + steps).alias("depth")))

    one = links.filter("up is not null")
    two = compose(one, one)
    pairs = links.select("name", F.col("name").alias("ancestor"), F.lit(0).alias("depth"))
    pairs = extend(extend(pairs, one, 1), two, 2)
    jump, steps = compose(two, two), 4
    while True:
        jump = jump if steps == 4 else cut_lineage(jump)
        if jump.isEmpty():
            return pairs
        pairs = cut_lineage(extend(pairs, jump, steps))
        if not pairs.filter("depth > 0 and name = ancestor").isEmpty():
            raise TreeError("the links form a cycle")
        jump, steps = compose(jump, jump), steps * 2


def depths(edges: DataFrame, node: str = "id", parent: str = "parent") -> DataFrame:
    """(id, root, depth) by pointer doubling; no node is ever gathered with its whole tree."""
    state = cut_lineage(edges.select(
        F.col(node).alias("id"), F.coalesce(F.col(parent), F.col(node)).alias("root"),
        F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("depth")))
    for _ in range(MAX_ROUNDS):
        up = state.select(F.col("id").alias("_at"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        moved = (state.join(up, F.col("root") == F.col("_at"), "left")
                 .select("id", F.coalesce("_root", "root").alias("root"),
                         (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
                         (F.coalesce("_depth", F.lit(0)) > 0).alias("_moved")))
        state = cut_lineage(moved)
        if state.filter("_moved").isEmpty():
            return state.drop("_moved")
        state = state.drop("_moved")
    raise TreeError("the links form a cycle")


def validate_tree(edges: DataFrame, node: str = "name", parent: str = "parent") -> None:
    """Names present and unique, parents declared, no cycle; anything else refuses the run."""
    one = edges.agg(F.count_if(F.coalesce(F.col(node), F.lit("")) == "").alias("blank"),
                    (F.count("*") - F.count_distinct(node)).alias("twice")).collect()[0]
    if one["blank"] or one["twice"]:
        raise TreeError(f"{one['blank']} nodes without a name, {one['twice']} declared twice")
    names = edges.select(F.col(node).alias("_name"))
    orphan = (edges.filter(F.col(parent).isNotNull())
              .join(names, F.col(parent) == F.col("_name"), "left_anti").limit(1).collect())
    if orphan:
        raise TreeError(f"{orphan[0][node]} names an undeclared parent {orphan[0][parent]}")
    closure(edges, node, parent)
