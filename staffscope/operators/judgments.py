"""Placing judgments in rounds of joins: all that do not depend on one another at a time.

Judgments hold one after the other, but most pairs of them have nothing to do with each other, and those that only put
something under the same word change nothing that the others read. Every judgment therefore names what it touches in the
table as it stands: the places it reads and writes, and the followings (who stands under a word) it goes through or adds
to. It is ready when no earlier open judgment writes what it touches, reads what it writes, adds to a following it goes
through or goes through one it adds to; adding to one following is no conflict, so a third of the queue on one hub is
one round. Ready judgments are applied by joins, the others wait for the next round.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .trees import closure

ROW = ["word", "canonical", "alias_sent_back", "parent", "excluded", "reviewed_at"]
PLACES, FOLLOWINGS = "place", "following"
READS, WRITES, ADDS = "read", "write", "add"


def _known(terms: DataFrame, name: str) -> DataFrame:
    """The table with its columns named for one part of a judgment."""
    return terms.select(F.col("word").alias(f"_{name}"), F.col("canonical").alias(f"{name}_head"), F.col("parent").alias(f"{name}_up"),
                        F.col("excluded").alias(f"{name}_barred"), F.col("alias_sent_back").alias(f"{name}_marked"),
                        F.col("reviewed_at").alias(f"{name}_at"), F.lit(True).alias(f"{name}_known"))


def _meet(judged: DataFrame, terms: DataFrame, name: str, at: str) -> DataFrame:
    return judged.join(_known(terms, name), F.col(at) == F.col(f"_{name}"), "left").drop(f"_{name}")


def _plans(terms: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each judgment would do now, and (id, ancestor): the words above the one it leads to.

    `does` is nothing, alone, excluded, under, stay (named as what it is already) or join. `old` is the head of the item
    that moves and `base` the head it comes to stand under; `round_about`: `base` stands below what moves.
    """
    said = _meet(_meet(judged, terms, "w", "word"), terms, "t", "target")
    marked = lambda name: F.coalesce(f"{name}_marked", F.lit(False))
    barred = F.coalesce("t_barred", F.lit(False))
    same, under = F.col("verdict") == "same", F.col("verdict") == "under"
    head = F.coalesce("t_head", "target")
    base = F.when(same & marked("t"), F.col("target")).when((same | under) & ~barred, head)
    said = said.withColumn("own_head", F.coalesce("w_head", "word")).withColumn("base", base).withColumn("freed", F.coalesce(same & marked("t"), F.lit(False)))
    said = said.withColumn("old", F.when(marked("w"), F.col("word")).otherwise(F.col("own_head")))
    does = (F.when(same & barred, "nothing").when(same & (F.col("old") == F.col("base")), "stay").when(same, "join")
            .when(under & ~barred, "under").when(F.col("verdict") == "excluded", "excluded").otherwise("alone"))
    said = cut_lineage(_meet(_meet(said.withColumn("does", does), terms, "o", "old"), terms, "b", "base"))
    above = closure(terms.filter("canonical = word"), "word", "parent").filter("depth > 0").select(F.col("name").alias("base"), "ancestor")
    # an alias that was sent back stands for itself and has nobody above it
    chain = cut_lineage(said.filter("base is not null and not freed").select("id", "word", "old", "does", "base").join(above, "base"))
    through = ((F.col("does") == "under") & (F.col("ancestor") == F.col("word"))) | (
        (F.col("does") == "join") & ((F.col("ancestor") == F.col("old")) | (F.col("ancestor") == F.col("word"))))
    back = chain.filter(through).select("id").distinct().withColumn("_back", F.lit(True))
    itself = (F.col("does") == "under") & (F.col("base") == F.col("word"))
    said = said.join(back, "id", "left").withColumn("round_about", F.coalesce("_back", F.lit(False)) | F.coalesce(itself, F.lit(False))).drop("_back")
    return cut_lineage(said), chain.select("id", "ancestor")


def _followers(terms: DataFrame, said: DataFrame) -> DataFrame:
    """(id, does, leader, base, member, alias, marked, member_at): who stands under a word whose following is gone through."""
    alias = F.col("canonical") != F.col("word")
    led = terms.filter(alias | F.col("parent").isNotNull()).select(
        F.when(alias, F.col("canonical")).otherwise(F.col("parent")).alias("leader"), F.col("word").alias("member"), alias.alias("alias"),
        F.col("alias_sent_back").alias("marked"), F.col("reviewed_at").alias("member_at"))
    leader = F.when(F.col("does") == "excluded", F.col("word")).when(F.col("does") == "join", F.col("old"))
    asking = said.select("id", "does", leader.alias("leader"), "base", "word").filter("leader is not null")
    own = F.col("member").eqNullSafe(F.col("base")) | (F.col("member") == F.col("word"))
    return cut_lineage(asking.join(led, "leader").filter(~own).drop("word"))


def _touched(said: DataFrame, chain: DataFrame, followers: DataFrame) -> DataFrame:
    """(id, space, name, mode): what each judgment touches."""
    does = lambda *kinds: F.col("does").isin(*kinds)
    real, joins = ~does("nothing"), does("join")
    lists = [  # (what, when, space, mode)
        ("word", real, PLACES, WRITES), ("target", F.col("target").isNotNull(), PLACES, READS), ("base", F.col("base").isNotNull(), PLACES, READS),
        ("old", joins & (F.col("old") != F.col("word")), PLACES, WRITES), ("base", joins & (F.col("freed") | F.col("round_about")), PLACES, WRITES),
        ("word", does("excluded"), FOLLOWINGS, READS), ("old", joins, FOLLOWINGS, READS),
        ("own_head", real & (F.col("own_head") != F.col("word")), FOLLOWINGS, ADDS), ("w_up", real & F.col("w_up").isNotNull(), FOLLOWINGS, ADDS),
        ("base", joins | (does("under") & ~F.col("round_about")), FOLLOWINGS, ADDS), ("o_up", joins & F.col("o_up").isNotNull(), FOLLOWINGS, ADDS),
        ("t_head", joins & F.col("freed") & (F.col("t_head") != F.col("target")), FOLLOWINGS, ADDS),
        ("b_up", joins & F.col("round_about") & F.col("b_up").isNotNull(), FOLLOWINGS, ADDS)]
    entry = lambda column, space, mode: F.struct(F.lit(space).alias("space"), F.col(column).alias("name"), F.lit(mode).alias("mode"))
    named = F.array_compact(F.array(*[F.when(when, entry(column, space, mode)) for column, when, space, mode in lists]))
    place = lambda df, column, mode: df.select("id", F.lit(PLACES).alias("space"), F.col(column).alias("name"), F.lit(mode).alias("mode"))
    own = said.select("id", F.explode(named).alias("at")).select("id", "at.space", "at.name", "at.mode")
    return own.unionByName(place(chain, "ancestor", READS)).unionByName(place(followers, "member", WRITES)).distinct()


def _waiting(touched: DataFrame) -> DataFrame:
    """(id): judgments that depend on an earlier one. Firsts per name combine on the map side, a hub's are one row."""
    first = lambda mode: F.min(F.when(F.col("mode") == mode, F.col("id"))).alias(f"first_{mode}")
    firsts = touched.groupBy("space", "name").agg(first(READS), first(WRITES), first(ADDS))
    earlier = lambda mode: F.coalesce(F.col(f"first_{mode}") < F.col("id"), F.lit(False))
    at = lambda space, mode: (F.col("space") == space) & (F.col("mode") == mode)
    conflict = ((at(PLACES, WRITES) & (earlier(READS) | earlier(WRITES))) | (at(PLACES, READS) & earlier(WRITES))
                | (at(FOLLOWINGS, READS) & earlier(ADDS)) | (at(FOLLOWINGS, ADDS) & earlier(READS)))
    return touched.join(firsts, ["space", "name"]).filter(conflict).select("id").distinct()


def _row(word: Column, canonical: Column, marked: Column, parent: Column, excluded: Column, at: Column) -> list[Column]:
    return [column.alias(name) for name, column in zip(ROW, (word, canonical, marked, parent, excluded, at))]


def _moves(terms: DataFrame, said: DataFrame, followers: DataFrame, now: Column) -> DataFrame:
    """The rows that the judgments `said` leave, each word once."""
    c, nobody, no, never = F.col, F.lit(None).cast("string"), F.lit(False), F.lit(None).cast("timestamp")
    does = lambda kind: c("does") == kind
    real, joins = said.filter("does <> 'nothing'"), said.filter("does = 'join'")
    canonical = F.when(does("join"), c("base")).when(does("stay"), c("own_head")).otherwise(c("word"))
    parent = F.when(does("under") & ~c("round_about"), c("base")).when(does("stay"), c("w_up"))
    made = [real.select(*_row(c("word"), canonical, no, parent, does("excluded"), now)),
            joins.filter("old <> word").select(*_row(c("old"), c("base"), F.coalesce("o_marked", no), nobody, no, c("o_at"))),
            joins.filter("freed").select(*_row(c("base"), c("base"), no, nobody, no, c("t_at"))),
            joins.filter("round_about and not freed").select(*_row(c("base"), c("base"), no, nobody, no, c("b_at")))]
    let_go = followers.filter("does = 'excluded'")
    moved = followers.filter("does = 'join'")
    made += [let_go.select(*_row(c("member"), c("member"), no, nobody, no, never)),
             moved.select(*_row(c("member"), F.when(c("alias"), c("base")).otherwise(c("member")), c("alias") & c("marked"),
                                F.when(~c("alias"), c("base")), no, c("member_at")))]
    new = said.filter("b_known is null and base is not null and base <> word and (does = 'join' or does = 'under' and not round_about)").select("base").distinct()
    made.append(new.select(*_row(c("base"), c("base"), no, nobody, no, never)))
    return reduce(DataFrame.unionByName, made)


def settle(terms: DataFrame, judged: DataFrame, now: datetime, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(the table, judgments still open) after at most so many rounds. `judged` has (id, word, verdict, target)."""
    stamp = F.lit(now.isoformat(sep=" ")).cast("timestamp")
    terms, judged = cut_lineage(terms.select(ROW)), cut_lineage(judged.select("id", "word", "verdict", "target"))
    for _ in range(rounds):
        if judged.isEmpty():
            break
        said, chain = _plans(terms, judged)
        followers = _followers(terms, said)
        waiting = cut_lineage(_waiting(_touched(said, chain, followers)))
        ready = said.join(waiting, "id", "left_anti")
        rows = cut_lineage(_moves(terms, ready, followers.join(waiting, "id", "left_anti"), stamp))
        terms = cut_lineage(terms.join(rows.select("word"), "word", "left_anti").unionByName(rows))
        judged = cut_lineage(judged.join(waiting, "id", "left_semi"))
    return terms, judged
