"""Mixing sources to target weights by fitting each source's budget exactly.

Sizes are words. Sources in the order of their names (code points, null last) get cyclic weights; targets share the
size of the whole corpus by weight and stop at a multiple of the source's own size, what is cut off going to the others
by weight until nothing is above. A source is first repeated as a whole as often as its target allows. The rest of its
budget is a subset-sum over a histogram: documents are counted by exact length, every length gives its proportional
share, and a bounded-knapsack dynamic programme over the lengths closes the remainder. Which documents of a length are
taken is decided by a seeded hash.

Scale: the texts are read once, for their sizes; what travels is narrow. The histogram is combined on the map side and
has a row per source and length, not per document: a source holding a third of the corpus, or all of it, is one
histogram like the others, with as many rows as lengths up to its longest document. One row per source meets in one
place for the targets. Documents of one length are ranked without putting them in one task
(`numbered`: ranges, then offsets).

Cases: null and blank texts have size 0, take 0 words and are never repeated; null sources are one source, the last; an
empty table gives an empty result; equal rows are ranked apart; other columns pass through `mixed`.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.numbering import numbered
from ..session import cut_lineage
from .common import WORD, chosen_rows, same_text, whole

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 7


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source_no, source, source_size, target) per source of `sizes` (source, size).

    With sources ordered by limit over weight, those that reach their limit are the first ones: the level at which the
    others share the rest follows from running sums. One row per source is all that meets here.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = cut_lineage(sources.withColumn("source_no", F.row_number().over(order) - 1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("double")
    limited = listed.withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    every = Window.partitionBy()
    rising = Window.orderBy(F.col("limit") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(rising), F.lit(0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0))))
    # the level if exactly the sources before this one stop at their limit; it holds for the first that stays below, and
    # later ones give smaller levels
    leveled = limited.withColumn("level", level)
    stays = F.when(F.col("limit") > F.col("level") * F.col("weight"), F.col("level"))
    shared = leveled.withColumn("shared", F.max(stays).over(every))
    below = F.col("limit") > F.col("shared") * F.col("weight")
    return shared.select("source_no", "source", "source_size",
                         F.when(below, F.col("shared") * F.col("weight")).otherwise(F.col("limit").cast("double")).alias("target"))


def fit_subset(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many documents of each length make up `budget` best (exactly where that is possible from what is left).

    Every length gives the proportional share, rounded down. Larger lengths then close the gap as far as they fit, and
    what is left, less than two of the longest document, is a bounded knapsack: sums are bits of an integer, counts are
    split in powers of two, and of every sum the step that first reached it is kept, so the numbers are read back from
    the nearest one. That is four bytes a word of the longest document, some three times, whatever the number of lengths.
    """
    total = sum(length * count for length, count in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    take = [count * budget // total for count in counts]
    left = budget - sum(length * n for length, n in zip(lengths, take))
    order = sorted(range(len(lengths)), key=lambda at: -lengths[at])
    kept_back = max(lengths)  # left for the knapsack, so that it has sums to choose from
    for at in order:
        more = min(counts[at] - take[at], max(0, left - kept_back) // lengths[at])
        take[at] += more
        left -= more * lengths[at]
    spare = [(at, counts[at] - take[at]) for at in reversed(order) if counts[at] > take[at]]
    if not spare or not left:
        return take
    unit = gcd(*(lengths[at] for at, _ in spare))  # no sum is between multiples of it
    exact, over = divmod(left, unit)
    wanted = exact if 2 * over <= unit else exact + 1
    top = exact + 1 + max(lengths[at] for at, _ in spare) // unit
    mask, reach, steps = (1 << top + 1) - 1, 1, []
    made_by = np.zeros(top + 1, np.int32)  # the step that first reached a sum; what it added to was reached before
    for at, free in spare:
        length, chunk = lengths[at] // unit, 1
        while free and not reach >> wanted & 1:
            part = min(chunk, free, max(1, top // length + 1))
            steps.append((at, part))
            new = reach << length * part & mask & ~reach
            if new:
                bits = np.frombuffer(new.to_bytes((top >> 3) + 1, "little"), np.uint8)
                made_by[np.flatnonzero(np.unpackbits(bits, count=top + 1, bitorder="little"))] = len(steps)
                reach |= new
            free = free - part if part == chunk else 0
            chunk *= 2
    below = (reach & (1 << exact + 1) - 1).bit_length() - 1
    above = reach >> exact + 1
    above = exact + (above & -above).bit_length() if above else None
    goal = above if above is not None and above * unit - left < left - below * unit else below
    while goal:
        at, part = steps[made_by[goal] - 1]
        take[at] += part
        goal -= lengths[at] // unit * part
    return take


def shares(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(source_no, size, again): of the documents of a source and length, how many are taken once more than the rest."""
    histogram = sizes.filter("size > 0").groupBy("source_no", "size").agg(F.count("*").alias("number"))
    rest = goals.filter("source_size > 0").select(
        "source_no", F.round(F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).cast("long").alias("budget"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size")
        frame["again"] = fit_subset(frame["size"].tolist(), frame["number"].tolist(), int(frame["budget"].iloc[0]))
        return frame[["source_no", "size", "again"]]
    return (histogram.join(rest, "source_no").groupBy("source_no")
            .applyInPandas(fit, "source_no int, size long, again long"))


def choose(rows: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """`rows` (row, key, doc_id, source, size; key: a digest of the text) with source_size, target and `copies`."""
    goals = cut_lineage(targets(rows, weights, most))
    known = rows.join(goals, rows["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    again = cut_lineage(shares(known.select("source_no", "size"), goals))
    whole_times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    drawn = known.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "key"))
    placed = numbered(drawn, [F.col("draw"), F.col("row")], by=["source_no", "size"], name="place")
    chosen = placed.join(again, ["source_no", "size"], "left")
    copies = F.when(F.col("size") > 0, whole_times + F.when(F.col("place") <= F.col("again"), 1).otherwise(0)).otherwise(0)
    return chosen.select("doc_id", "source_no", "source", "key", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row."""
    return choose(_rows(docs), weights, most, seed).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The rows of the mix with all columns of `docs`, each as often as it is taken; rows that agree in document, source
    and text share their copies, and the other columns of one of them."""
    copies = (choose(_rows(docs), weights, most, seed).filter("copies > 0").groupBy("doc_id", "source_no", "key")
              .agg(F.sum("copies").alias("copies"), F.first("source").alias("source")))
    taken = chosen_rows(docs, cut_lineage(copies.select("doc_id", "source", "key", "copies")), doc_id=F.col("doc_id"), source=F.col("source"), key=same_text())
    return taken.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc.*")


def _rows(docs: DataFrame) -> DataFrame:
    """Written once, so that the row numbers hold."""
    return cut_lineage(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", words(whole()).alias("size"),
                                   same_text().alias("key")))
