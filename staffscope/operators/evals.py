"""Scoring gold cases: search, extraction, vocabulary, and whether two conditions ask for the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import squeeze
from ..schema import ENGAGEMENTS
from ..session import cut_lineage, with_scalars
from .terms import TERM_DDL, apply_judgments, conform_judgments, rename_items, term_closure

# --- fixed values: endings that make a word an action, and endings nobody would click on ----------------
ACTION_TAIL = "(建设|搭建|制定|推动|落地|推进|改善|提升|开展)$"
UNCLICKABLE = "(能力|相关|工作|事务|方面|类$|等$)"


def eval_search(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Per case: expected, found, intruders and pass. `cases` has (name, emp_id, expected), `results` (name, emp_id, rank)."""
    joined = cases.join(results.select("name", "emp_id", "rank"), ["name", "emp_id"], "left")
    seen = F.col("rank").isNotNull()
    scored = joined.groupBy("name").agg(
        F.count_if("expected").alias("expected"), F.count_if(F.col("expected") & seen).alias("found"),
        F.count_if(~F.col("expected") & seen).alias("intruders"), F.min(F.when(F.col("expected"), F.col("rank"))).alias("best_rank"))
    return scored.withColumn("ok", (F.col("found") == F.col("expected")) & (F.col("intruders") == 0))


def totals(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("cases"), F.sum("expected").alias("expected"), F.sum("found").alias("found"),
                      F.sum("intruders").alias("intruders"), F.count_if(~F.col("ok")).alias("failed"))


def _depth(col: Column) -> Column:
    return F.array_position(F.array(*[F.lit(e) for e in ENGAGEMENTS]), col)


def eval_extract(gold: DataFrame, ok: DataFrame, items: DataFrame, keep: DataFrame, reject: DataFrame) -> DataFrame:
    """Per case, extraction scores. Words compare without width, case or spaces.

    `gold` (name, item, word, depth): the alternatives of each gold item and the depths it may have (NULL: any);
    `ok` (name, word); `items` (name, text, engagement); `keep` and `reject` (name, part).
    """
    said = items.select("name", "text", "engagement", squeeze(F.col("text")).alias("w"))
    want = gold.select("name", "item", "depth", squeeze(F.col("word")).alias("w"))
    fine = ok.select("name", squeeze(F.col("word")).alias("w"))
    pairs = want.join(said, ["name", "w"], "left")
    step = _depth(F.col("engagement"))
    right = F.col("engagement") == F.col("depth")
    two_off = F.coalesce(F.abs(step - _depth(F.col("depth"))) >= 2, F.lit(True))
    per_item = pairs.groupBy("name", "item").agg(
        F.bool_or(F.col("text").isNotNull()).alias("hit"), F.bool_or(F.col("depth").isNotNull()).alias("graded"),
        F.bool_or(F.coalesce(right, F.lit(False))).alias("right"),
        F.bool_and(F.when(F.col("text").isNotNull() & F.col("depth").isNotNull(), two_off)).alias("far"))
    judged = F.col("hit") & F.col("graded")
    recalled = per_item.groupBy("name").agg(
        F.count("*").alias("gold"), F.count_if("hit").alias("hit"), F.count_if(judged).alias("judged"),
        F.count_if(judged & F.col("right")).alias("right"),
        F.count_if(judged & ~F.col("right") & F.col("far")).alias("far"))
    allowed = want.select("name", "w").unionByName(fine).distinct().withColumn("_fine", F.lit(True))
    written = said.join(allowed, ["name", "w"], "left").groupBy("name").agg(
        F.count("*").alias("written"), F.count_if(F.coalesce("_fine", F.lit(False))).alias("fine"),
        F.count_if(F.col("text").rlike(ACTION_TAIL)).alias("action_tails"),
        F.count_if(F.char_length("text") > 8).alias("over_8"))
    inside = F.coalesce(F.contains("text", F.col("part")), F.lit(False))
    kept = (keep.join(items.select("name", "text"), "name", "left").groupBy("name", "part").agg(F.bool_or(inside).alias("k"))
            .groupBy("name").agg(F.count("*").alias("keep"), F.count_if("k").alias("kept")))
    leaks = (items.select("name", "text").join(reject, "name").filter(inside).select("name", "text").distinct()
             .groupBy("name").agg(F.count("*").alias("leaks")))
    out = recalled.join(written, "name", "full").join(kept, "name", "full").join(leaks, "name", "full")
    return out.na.fill(0)


def carries(above: DataFrame, terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """`pairs` (query, word) with `carried`: whether picking `query` brings the people who wrote `word`.

    `above` is the closure of canonical words; spellings stand for their canonical word on both sides.
    """
    head = terms.select(F.col("word").alias("_w"), F.col("canonical").alias("_c"))
    named = (pairs.join(head.select(F.col("_w").alias("query"), F.col("_c").alias("_q")), "query", "left")
             .join(head.select(F.col("_w").alias("word"), F.col("_c").alias("_t")), "word", "left")
             .withColumn("_q", F.coalesce("_q", "query")).withColumn("_t", F.coalesce("_t", "word")))
    reach = above.select(F.col("name").alias("_t"), F.col("ancestor").alias("_q"), F.lit(True).alias("_up"))
    return (named.join(reach, ["_t", "_q"], "left")
            .select("query", "word", (F.coalesce("_up", F.lit(False)) | (F.col("_q") == F.col("_t"))).alias("carried")))


def eval_review(carried: DataFrame, excluded: DataFrame, terms: DataFrame, words: DataFrame) -> DataFrame:
    """One row of vocabulary scores.

    `carried` (query, word, carried, expected); `excluded` (word): what should go; `words` (word): the case's own.
    """
    links = carried.agg(F.count_if(F.col("expected") & ~F.col("carried")).alias("missed"),
                        F.count_if(~F.col("expected") & F.col("carried")).alias("mixed"))
    gone = words.join(terms.filter("excluded").select("word"), "word", "left_semi")
    kept = excluded.join(gone, "word", "left_anti").agg(F.count("*").alias("kept"))
    dropped = gone.join(excluded, "word", "left_anti").agg(F.count("*").alias("dropped"))
    parents = terms.filter("parent is not null")
    names = parents.agg(F.count_if((F.char_length("parent") > 8) | F.col("parent").rlike(UNCLICKABLE)).alias("unclickable"),
                        F.count_distinct("parent").alias("names"))
    return with_scalars(with_scalars(with_scalars(links, kept), dropped), names)


def same_selection(selected: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(a, b, only_a, only_b, same) for pairs of conditions in a selection (cond, emp_id, id).

    The symmetric difference is counted by key, one aggregation for all pairs.
    """
    entries = F.array_compact(F.array(*[
        F.when(F.col("cond") == cond, F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(side).alias("side")))
        for a, b in pairs for cond, side in ((a, "a"), (b, "b"))]))
    rows = selected.select("emp_id", "id", F.explode(entries).alias("p")).select("emp_id", "id", "p.*")
    sides = rows.groupBy("a", "b", "emp_id", "id").agg(
        F.bool_or(F.col("side") == "a").alias("in_a"), F.bool_or(F.col("side") == "b").alias("in_b"))
    counted = sides.groupBy("a", "b").agg(F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a"),
                                          F.count_if(F.col("in_b") & ~F.col("in_a")).alias("only_b"))
    return counted.withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def roster_checks(results: DataFrame, includes=(), excludes=(), before=()) -> dict[str, list]:
    """What a roster (emp_id, rank) gets wrong; the ids come from one hand-written case."""
    named = sorted({*includes, *excludes, *[i for pair in before for i in pair]})
    rank = {row["emp_id"]: row["rank"] for row in results.filter(F.col("emp_id").isin(named)).collect()}
    return {"missing": [i for i in includes if i not in rank], "intruding": [i for i in excludes if i in rank],
            "misplaced": [pair for pair in before if not (pair[0] in rank and pair[1] in rank and rank[pair[0]] < rank[pair[1]])]}


# --- whole tables of cases ------------------------------------------------------------------------------------
OF_CASE = "\x02"


def _own(name: Column, word: Column) -> Column:
    """A word as one case's own: cases share no word, so one vocabulary holds all of them side by side."""
    return F.concat(name, F.lit(OF_CASE), word)


def _plain(word: Column) -> Column:
    return F.substring_index(word, OF_CASE, -1)


def eval_review_cases(cases: DataFrame, answers: DataFrame, now) -> DataFrame:
    """Per case: what becomes of its words once its answers are placed and its items named by their writers.

    `cases` (name, words array<struct<word, people>>, excluded array<string>, found and not_found array<array<string>>: pairs of
    a query and a word it should or should not bring); `answers` (name, at, word, near array<struct<word, people>>, judgment).
    All cases are placed in one table and one set of rounds, however many there are.
    """
    said = conform_judgments(answers.select("name", "at", "word", "near", "judgment"))
    judged = said.select(F.concat(F.lpad(F.col("at").cast("string"), 9, "0"), F.lit(OF_CASE), "name").alias("id"),
                         _own(F.col("name"), F.col("word")).alias("word"), "verdict", _own(F.col("name"), F.col("target")).alias("target"))
    empty = cases.sparkSession.createDataFrame([], TERM_DDL)
    own = cut_lineage(cases.select("name", F.explode("words").alias("w")).select("name", "w.word", "w.people"))
    writers = own.select(_own(F.col("name"), F.col("word")).alias("word"), F.col("people").alias("writers"))
    terms = cut_lineage(rename_items(apply_judgments(empty, judged, now), writers))
    pair = lambda column, expected: cases.select("name", F.explode(column).alias("p"), F.lit(expected).alias("expected"))
    pairs = pair("found", True).unionByName(pair("not_found", False)).select(
        "name", "expected", _own(F.col("name"), F.col("p")[0]).alias("query"), _own(F.col("name"), F.col("p")[1]).alias("word"))
    brought = carries(term_closure(terms), terms, pairs.select("query", "word").distinct())
    links = pairs.join(brought, ["query", "word"]).groupBy("name").agg(
        F.count_if("expected").alias("found"), F.count_if(F.col("expected") & ~F.col("carried")).alias("missed"),
        F.count_if(~F.col("expected")).alias("not_found"), F.count_if(~F.col("expected") & F.col("carried")).alias("mixed"))
    out = terms.filter("excluded").select(F.substring_index("word", OF_CASE, 1).alias("name"), _plain(F.col("word")).alias("word"))
    gone = own.select("name", "word").distinct().join(out, ["name", "word"], "left_semi").withColumn("_gone", F.lit(True))
    should = cases.select("name", F.explode(F.array_distinct("excluded")).alias("word")).withColumn("_should", F.lit(True))
    drops = should.join(gone, ["name", "word"], "full").groupBy("name").agg(
        F.count_if(F.col("_should").isNotNull()).alias("expected"), F.count_if(F.col("_gone").isNull()).alias("kept"),
        F.count_if(F.col("_should").isNull()).alias("dropped"))
    parents = terms.filter("parent is not null").select(F.substring_index("word", OF_CASE, 1).alias("name"), _plain(F.col("parent")).alias("parent"))
    named = parents.groupBy("name").agg(F.count_distinct("parent").alias("names"),
                                        F.count_if((F.char_length("parent") > 8) | F.col("parent").rlike(UNCLICKABLE)).alias("unclickable"))
    open_ = said.groupBy("name").agg(F.count_if(F.col("verdict").isNull()).alias("unanswered"))
    scored = cases.select("name")
    for part in (links, drops, named, open_):
        scored = scored.join(part, "name", "left")
    scored = scored.na.fill(0)
    faults = [F.col(c) == 0 for c in ("missed", "mixed", "kept", "dropped", "unclickable", "unanswered")]
    return scored.withColumn("ok", reduce(lambda a, b: a & b, faults))


def roster_problems(cases: DataFrame, rosters: DataFrame, evidence: DataFrame) -> DataFrame:
    """(name, problem, subject): what the rosters of a table of cases get wrong; no row, nothing wrong.

    `cases` (name, includes and excludes array<string>, before array<array<string>>: pairs of whom should stand before whom,
    evidence array<struct<emp_id, months, place>>); `rosters` (name, emp_id, rank, months: of the first claim); `evidence`
    (name, emp_id, company, department): the segments shown. All cases are checked by joins, none by itself.
    """
    listed = rosters.select("name", "emp_id", "rank", "months")
    people = lambda column: cases.select("name", F.explode(column).alias("emp_id")).distinct()
    say = lambda df, problem, subject=F.col("emp_id"): df.select("name", F.lit(problem).alias("problem"), subject.alias("subject"))
    missing = say(people("includes").join(listed, ["name", "emp_id"], "left_anti"), "missing")
    intruding = say(people("excludes").join(listed, ["name", "emp_id"], "left_semi"), "intruding")
    place = lambda name: listed.select("name", F.col("emp_id").alias(name), F.col("rank").alias(f"{name}_rank"))
    pairs = cases.select("name", F.explode("before").alias("p")).select("name", F.col("p")[0].alias("first"), F.col("p")[1].alias("then")).distinct()
    ranked = pairs.join(place("first"), ["name", "first"], "left").join(place("then"), ["name", "then"], "left")
    misplaced = say(ranked.filter(~F.coalesce(F.col("first_rank") < F.col("then_rank"), F.lit(False))), "misplaced", F.concat_ws(" before ", "first", "then"))
    wanted = cases.select("name", F.explode("evidence").alias("e")).select("name", "e.emp_id", F.col("e.months").alias("want"), "e.place")
    met = wanted.join(listed, ["name", "emp_id"], "left")
    without = say(met.filter("rank is null"), "no evidence")
    other = say(met.filter("rank is not null and want is not null and not (want <=> months)"), "other months",
                F.concat_ws(" ", "emp_id", F.coalesce(F.col("months").cast("string"), F.lit("?"))))
    at = F.when(F.coalesce("company", F.lit("")) != "", F.col("company")).otherwise(F.coalesce("department", F.lit("")))
    seen = met.filter("rank is not null and place is not null").join(evidence.select("name", "emp_id", at.alias("at")), ["name", "emp_id"])
    elsewhere = say(seen.filter(~F.contains("at", F.col("place"))).select("name", "emp_id", "at").distinct(), "elsewhere", F.concat_ws(" ", "emp_id", "at"))
    return reduce(DataFrame.unionByName, [missing, intruding, misplaced, without, other, elsewhere])
