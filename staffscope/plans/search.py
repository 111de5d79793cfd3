"""One search over one corpus version: eligible people, facts, roster, facets, evidence, reading list."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.text import name_in
from ..operators import facets as facet_ops, rank as rank_ops
from ..operators.hits import (conditions_met, criterion_key, judge_hits, match_phrases, people_where, reach, segment_flags, segments_where)
from ..operators.numbering import numbered
from ..schema import RESULT_PAGE
from ..session import cut_lineage, literal_table, with_scalars
from .query import Filters, Query

PERSON_DIMS = ["level_band", "level_rank", "recruitment", "education", "education_rank", "school_tier", "overseas"]
SEGMENT_DIMS = ["seq_l1", "seq_l2", "kind", "company_tag", "main_industries", "skills"]


def reading_order() -> list[Column]:
    """The roster goes by depth, then person."""
    return [F.desc_nulls_last("level_rank"), F.desc("depth"), F.col("emp_id"), F.col("cond"), F.col("id")]


#: What a hit is asked for once its predicate was tested.
HIT_COLUMNS = ["cond", "id", "emp_id", "route", "fits", "phrase", "phrase_id", "engagement", "start_date", "end_date", "months", "company",
               "department", "title", *SEGMENT_DIMS]


@dataclass
class Search:
    """Lazy: each property is a DataFrame; nothing runs until one of them is read.

    `views` are the catalog relations of one pinned corpus version, restricted to the reader's scope; `verdicts`
    those of this search task. `cache=True` keeps facts between the roster, the facets and the evidence;
    `close()` gives the memory back. `reached`, where given, is what `reach()` of the same query and views found, written by
    a caller who searches again with other verdicts. A query with criteria reads its hits up to six times within one result, so
    these are written to the checkpoint folder instead of being derived each time.
    """

    views: dict[str, DataFrame]
    query: Query
    now: date
    verdicts: DataFrame | None = None
    filters: Filters = field(default_factory=Filters)
    cache: bool = False
    reached: DataFrame | None = None
    _kept: list = field(default_factory=list, repr=False)

    def __post_init__(self):
        self.roles = self.query.roles()
        self.claims = [{"mode": c.mode, "min_months": c.min_months, "label": c.label, "cond": at}
                       for at in self.roles["claims"] for c in [self.query.conditions[at]]]
        self.judged = any(c.seek and c.seek.criterion and not c.off for c in self.query.conditions)
        self.has_must = any(claim["mode"] == "must" for claim in self.claims)

    def _keep(self, df: DataFrame) -> DataFrame:
        if self.cache:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._kept.append(df)
        elif self.judged:
            df = cut_lineage(df)
        return df

    def close(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()

    def _where(self, conds) -> dict[int, tuple[str, dict]]:
        return {at: (self.query.conditions[at].where, self.query.conditions[at].params) for at in conds}

    # --- hits ---------------------------------------------------------------------------------
    @cached_property
    def matched(self) -> DataFrame | None:
        patterns = {at: c.seek.patterns for at, c in enumerate(self.query.conditions)
                    if c.seek and c.seek.patterns and not c.off}
        if not patterns:
            return None
        # written first: the planner then knows how many phrases matched and, when they are few, broadcasts them
        # instead of shuffling every edge of the corpus by phrase
        return cut_lineage(match_phrases(self.views["phrase"], self.views["term"], patterns))

    def _seeking(self) -> dict:
        return {at: c.seek for at, c in enumerate(self.query.conditions) if c.seek and not c.off}

    def reach(self) -> DataFrame | None:
        """What the seeking conditions reach before anything was judged; the same in every round of reading."""
        seeking = self._seeking()
        if not seeking:
            return None
        whole = [at for at, seek in seeking.items() if not seek.patterns]
        return reach(self.views["edge"], self.views["experience"], self.matched, whole)

    @cached_property
    def hits(self) -> DataFrame | None:
        reached = self.reach() if self.reached is None else self.reached
        if reached is None:
            return None
        criteria = {at: criterion_key(seek.criterion) if seek.criterion else None for at, seek in self._seeking().items()}
        return judge_hits(reached, criteria, self.verdicts)

    @cached_property
    def segments(self) -> DataFrame | None:
        """Hits whose own predicate holds, for claims and seeking exclusions alike."""
        seeking = [at for at, c in enumerate(self.query.conditions) if c.seek and not c.off]
        if not seeking:
            return None
        held = segments_where(self.views, self.hits, self._where(seeking))
        return self._keep(held.select(*HIT_COLUMNS))  # others are neither shuffled nor written

    # --- people -------------------------------------------------------------------------------
    def _flags(self) -> DataFrame | None:
        """One aggregation for every background gate, background preference and plain exclusion."""
        conds = [at for role in ("gates", "prefer", "excludes") for at in self.roles[role]
                 if self.query.conditions[at].source == "experience" and not self.query.conditions[at].seek]
        return segment_flags(self.views, self._where(conds)) if conds else None

    def _met(self, at: int):
        least = self.query.conditions[at].min_months
        return F.coalesce(F.col(f"m{at}") >= least if least else F.col(f"q{at}"), F.lit(False))

    @cached_property
    def eligible(self) -> DataFrame:
        """People past every gate, exclusion and name filter, with one flag per preference."""
        conditions = self.query.conditions
        gates = [at for at in self.roles["gates"] if conditions[at].source == "person"]
        people = people_where(self.views, self._where(gates))
        people = self._by_names(people)
        flags = self._flags()
        if flags is not None:
            people = people.join(flags, "emp_id", "left")
        for at in self.roles["gates"]:
            if conditions[at].source == "experience":
                people = people.filter(self._met(at))
        for at in self.roles["excludes"]:
            if not conditions[at].seek:
                people = people.filter(~self._met(at))
        seeking = [at for at in self.roles["excludes"] if conditions[at].seek]
        if seeking:
            hit = self.segments.filter(F.col("cond").isin(seeking) & F.col("fits")).select("emp_id")
            people = people.join(hit, "emp_id", "left_anti")
        for at in self.roles["prefer"]:
            if conditions[at].source == "experience":
                people = people.withColumn(f"prefer{at}", self._met(at))
            else:
                yes = people_where(self.views, self._where([at])).select("emp_id", F.lit(True).alias(f"prefer{at}"))
                people = people.join(yes, "emp_id", "left")
        return people

    def _by_names(self, people: DataFrame) -> DataFrame:
        experience = self.views["experience"]
        for columns, names in ((["company"], self.filters.company), (["department", "department_path"], self.filters.department)):
            if names:
                at = experience.filter(name_in([F.col(c) for c in columns], names)).select("emp_id")
                people = people.join(at, "emp_id", "left_semi")
        return people.filter(name_in([F.col("school")], self.filters.school)) if self.filters.school else people

    # --- facts --------------------------------------------------------------------------------
    @cached_property
    def all_facts(self) -> DataFrame:
        """One row per claim and segment of an eligible person, confirmed (`fits`) or not."""
        conds = self.roles["claims"]
        claim = reduce(lambda chain, item: chain.when(F.col("cond") == item[1], item[0]), enumerate(conds), F)
        rows = self.segments.filter(F.col("cond").isin(conds)).withColumn("claim", claim)
        rows = rows.select("claim", *HIT_COLUMNS,
                           rank_ops.factor(F.col("route"), F.col("engagement")).alias("factor"))
        one = rank_ops.best_hit(rows, ["claim", "id"])
        preferences = [f"prefer{at}" for at in self.roles["prefer"]]
        return self._keep(one.join(self.eligible.select("emp_id", *PERSON_DIMS, *preferences), "emp_id"))

    @cached_property
    def open_exclusions(self) -> DataFrame | None:
        """(cond, id, emp_id): unconfirmed segments on judged exclusions, of eligible people."""
        conds = [at for at in self.roles["excludes"] if self.query.conditions[at].seek and self.query.conditions[at].seek.criterion]
        if not conds:
            return None
        rows = self.segments.filter(F.col("cond").isin(conds) & F.col("fits").isNull()).select("cond", "id", "emp_id").distinct()
        return rows.join(self.eligible.select("emp_id"), "emp_id", "left_semi")

    def _decided(self, df: DataFrame) -> DataFrame:
        open_ = self.open_exclusions
        return df if open_ is None else df.join(open_.select("emp_id"), "emp_id", "left_anti")

    @cached_property
    def facts(self) -> DataFrame:
        """Facts that count: confirmed, of people about whom no exclusion is undecided."""
        return self._decided(self.all_facts.filter("fits"))

    @cached_property
    def unconfirmed(self) -> DataFrame:
        return self.all_facts.filter(F.col("fits").isNull())

    @cached_property
    def all_population(self) -> DataFrame:
        """Eligible people with their segments; people without one stay."""
        own = self.views["experience"].select("emp_id", "id", "months", *SEGMENT_DIMS)
        preferences = [f"prefer{at}" for at in self.roles["prefer"]]
        return self.eligible.select("emp_id", *PERSON_DIMS, *preferences).join(own, "emp_id", "left")

    @cached_property
    def population(self) -> DataFrame:
        return self._decided(self.all_population)

    # --- roster -------------------------------------------------------------------------------
    def _ranked(self, facts: DataFrame | None, population: DataFrame | None, filters: Filters) -> DataFrame:
        """(emp_id, depth, basis, level_band, level_rank) of everybody on the list."""
        keep = facet_ops.passes(filters)
        preferences = [f"prefer{at}" for at in self.roles["prefer"]]
        carry = ["level_band", "level_rank", *preferences]
        scored = None
        if facts is not None:
            scored = rank_ops.person_depth(facts.filter(keep), self.claims, self.now, carry if self.has_must else ())
        if self.has_must:
            people = scored.filter("complete")
        else:
            people = population.filter(keep).select("emp_id", *carry).distinct()
            if scored is not None:
                people = people.join(scored.drop("complete"), "emp_id", "left").withColumn("depth", F.coalesce("depth", F.lit(1.0)))
            else:
                none = F.array().cast("array<struct<claim:int,segments:bigint,months:bigint,end_date:date>>")
                people = people.withColumn("depth", F.lit(1.0)).withColumn("basis", none)
        return rank_ops.raise_by_preferences(people, preferences).select("emp_id", "depth", "basis", "level_band", "level_rank")

    @cached_property
    def ranked(self) -> DataFrame:
        facts = self.facts if self.claims else None
        return self._ranked(facts, None if self.has_must else self.population, self.filters)

    @cached_property
    def candidates(self) -> DataFrame:
        """Everybody who would be listed if each unconfirmed segment went in their favour."""
        facts = self.all_facts if self.claims else None
        return self._ranked(facts, None if self.has_must else self.all_population, self.filters)

    def roster(self, limit: int = RESULT_PAGE) -> DataFrame:
        """The page: people in order with their rank; without a claim in id order and without a score."""
        if not self.claims:
            preferences = bool(self.roles["prefer"])
            page = rank_ops.top(self.ranked, limit) if preferences else self.ranked.orderBy("emp_id").limit(limit)
        else:
            page = rank_ops.top(self.ranked, limit)
        people = self.views["person"].select("emp_id", "name", "cur_dept", "cur_title", "cur_level")
        return rank_ops.numbered_page(page.join(people, "emp_id"))

    def total(self) -> int:
        return self.ranked.count()

    def facets(self) -> DataFrame:
        if self.has_must:
            return facet_ops.facets(self.facts, self.claims, self.filters)
        return facet_ops.population_facets(self.population, self.filters)

    def evidence(self, limit: int = RESULT_PAGE) -> DataFrame:
        """Counted segments behind the page: claim by claim, most engaged and longest first (`place`)."""
        kept = self.facts.filter(facet_ops.passes(self.filters))
        based = rank_ops.basis(kept)
        return rank_ops.ordered_evidence(kept, based.filter(rank_ops.enough_months(self.claims)), self.roster(limit))

    # --- what is still open -----------------------------------------------------------------------
    @cached_property
    def pending(self) -> DataFrame:
        """(cond, id, emp_id, boost): unconfirmed segments of candidates."""
        boosts = [at for at, c in enumerate(self.query.conditions) if c.mode == "boost"] or [-1]
        parts = []
        if self.claims:
            parts.append(self.unconfirmed.select("cond", "id", "emp_id"))
        if self.open_exclusions is not None:
            parts.append(self.open_exclusions.select("cond", "id", "emp_id"))
        if not parts:  # nothing is judged
            parts.append(self.views["experience"].select(F.lit(0).alias("cond"), "id", "emp_id").limit(0))
        rows = reduce(DataFrame.unionByName, parts)
        listed = self.candidates.select("emp_id", "depth", "level_rank", "level_band")
        return rows.join(listed, "emp_id").withColumn("boost", F.col("cond").isin(boosts))

    def incomplete(self) -> DataFrame:
        """One row when the list is not final: `above` is the lowest band that is confirmed throughout, or NULL."""
        bottom = F.lit(-2147483648)
        height = F.coalesce("level_rank", bottom)
        top = self.pending.filter("not boost").agg(F.max(height).alias("_top"), F.count("*").alias("open"))
        people = self.candidates.select(height.alias("_h"), "level_band")
        over = with_scalars(people, top).filter(F.col("_h") > F.col("_top"))
        lowest = over.agg(F.min_by("level_band", "_h").alias("above"))
        return with_scalars(top.filter("open > 0"), lowest).select("open", "above")

    def to_read(self) -> DataFrame:
        """Unconfirmed segments to be read now, in no order: what decides who is listed, boosts only once none of that is left."""
        listed = ("cond", "id", "emp_id", "level_rank", "depth")
        if not any(c.mode == "boost" and c.seek and c.seek.criterion and not c.off for c in self.query.conditions):
            return self.pending.select(*listed)  # no boost is judged: nothing has to wait
        first = self.pending.groupBy().agg(F.count_if(~F.col("boost")).alias("_deciding"))
        rows = with_scalars(self.pending, first).filter((F.col("_deciding") == 0) | ~F.col("boost"))
        return rows.select(*listed)

    def reading_list(self) -> DataFrame:
        """`to_read` with its `place` in reading order, from 1: the highest level first and no level last, then roster order,
        condition, segment."""
        return numbered(self.to_read(), reading_order(), name="place")

    # --- single conditions --------------------------------------------------------------------------
    def selection(self) -> DataFrame:
        """(cond, emp_id, id): what each enabled condition selects on its own; id is NULL for people."""
        parts = []
        seeking = [at for at, c in enumerate(self.query.conditions) if c.seek and not c.off]
        none = F.lit(None).cast("string")
        if seeking:
            parts.append(self.segments.select("cond", "emp_id", "id", "months").distinct())
        plain = {source: [at for at, c in enumerate(self.query.conditions) if not (c.off or c.seek) and c.source == source]
                 for source in ("person", "experience")}
        if plain["person"]:
            parts.append(conditions_met(self.views, "person", self._where(plain["person"])).select(
                F.explode("conds").alias("cond"), "emp_id", none.alias("id"), F.lit(0).alias("months")))
        if plain["experience"]:
            parts.append(conditions_met(self.views, "experience", self._where(plain["experience"])).select(
                F.explode("conds").alias("cond"), "emp_id", "id", "months"))
        rows = reduce(DataFrame.unionByName, parts)
        least = {at: c.min_months for at, c in enumerate(self.query.conditions) if c.min_months and not c.off}
        if least:
            need = reduce(lambda chain, item: chain.when(F.col("cond") == item[0], item[1]), least.items(), F).otherwise(0)
            enough = (rows.groupBy("cond", "emp_id").agg(F.sum("months").alias("_m")).filter(F.col("_m") >= need))
            rows = rows.join(enough.select("cond", "emp_id"), ["cond", "emp_id"], "left_semi")
        return rows.select("cond", "emp_id", "id")

    def probe(self) -> DataFrame:
        """(cond, people) for every enabled condition, zero included."""
        counted = self.selection().groupBy("cond").agg(F.count_distinct("emp_id").alias("people"))
        on = [at for at, c in enumerate(self.query.conditions) if not c.off]
        every = literal_table(self.views["person"].sparkSession, [(at,) for at in on], "cond int")
        return every.join(counted, "cond", "left").withColumn("people", F.coalesce("people", F.lit(0)))

    def fact_counts(self) -> DataFrame:
        return self.all_facts.groupBy("claim").agg(F.count("*").alias("facts"))

    def empty_reason(self) -> dict | None:
        """Why nobody is listed; None when somebody is."""
        if not any(self.roles.values()):
            return {"kind": "allDisabled" if self.query.conditions else "noConditions"}
        if not self.ranked.limit(1).isEmpty():
            return None
        marker = self.incomplete().collect()
        if marker:
            return {"kind": "incomplete", "above": marker[0]["above"]}
        if self.filters.narrows:
            return {"kind": "filtered"}
        counts = {row["cond"]: row["people"] for row in self.probe().collect()}
        nobody = [c.id for at, c in enumerate(self.query.conditions) if not c.off and c.mode == "must" and not counts[at]]
        return {"kind": "unmet", "nobody": nobody}


def overflow_contributors(counts: DataFrame, limit: int) -> DataFrame:
    """(claim): the fewest claims whose removal brings the facts under `limit`, largest first.

    `counts` has one row per claim of one query (at most CONDITION_MAX), so the running total is over a handful
    of rows.
    """
    order = Window.orderBy(F.desc("facts"), "claim")
    rows = (counts.withColumn("_before", F.sum("facts").over(order) - F.col("facts"))
            .withColumn("_total", F.sum("facts").over(Window.partitionBy())))
    return rows.filter(F.col("_total") - F.col("_before") > limit).select("claim", "facts")
