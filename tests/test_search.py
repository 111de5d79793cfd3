"""Search properties and the registered queries at the smallest scale."""

from dataclasses import replace

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect
from staffscope.checks import search as q
from staffscope.plans.query import Condition, Filters, Query, QueryError, Seek

SF = "/root/testdata/sf0.001"
KEYS = ["flagship", "rank_with_boost", "rank_judged", "rank_filtered", "facets_multi", "facets_filtered", "population_facets", "page_evidence", "incomplete",
        "probe_counts", "catalog_experience", "merge_adjacent", "dedup_revisions", "term_in_use", "scope_members", "export_roster", "plan_batches"]


@pytest.mark.parametrize("name", KEYS)
def test_agrees_with_sql(spark, name):
    line, ok = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], SF, connect(SF))
    assert ok, line


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["rank", "emp_id", "name", "cur_dept", "depth"]


def test_clicking_a_facet_gives_its_count(spark):
    found = q.search(spark, SF, q.FLAGSHIP)
    counts = {(r["dim"], r["value"]): r["n"] for r in found.facets().collect()}
    for dim, value, filters in [("level", "L2", Filters(level=("L2",))), ("kind", "internal", Filters(kind="internal")), ("min_months", "24", Filters(min_months=24)),
                                ("skill", "ring", Filters(skill=("ring",))), ("education", "本科", Filters(education=("本科",)))]:
        assert replace(found, filters=filters).total() == counts.get((dim, value), 0), (dim, value)


def test_a_longer_page_extends_the_same_order(spark):
    found = q.search(spark, SF, Query((q.RED,)))
    short, long = [[r["emp_id"] for r in found.roster(n).orderBy("rank").collect()] for n in (10, 40)]
    assert long[:10] == short


def test_filters_never_add_people(spark):
    found = q.search(spark, SF, q.FLAGSHIP)
    everybody = {r["emp_id"] for r in found.ranked.collect()}
    assert {r["emp_id"] for r in replace(found, filters=q.FILTERS).ranked.collect()} <= everybody


def test_why_nobody(spark):
    nobody = Condition("moon", "moon", "must", "person", where="p.school = :s", params={"s": "Moon {x}"})
    make = lambda query, filters=None: q.search(spark, SF, query, filters).empty_reason()
    assert make(Query()) == {"kind": "noConditions"}
    assert make(Query((replace(nobody, off=True),))) == {"kind": "allDisabled"}
    assert make(Query((q.SENIOR, nobody))) == {"kind": "unmet", "nobody": ["moon"]}
    assert make(Query((q.SENIOR,)), Filters(school=("nowhere",))) == {"kind": "filtered"}
    assert make(Query((q.SENIOR,))) is None


def test_conditions_are_checked():
    for bad in (dict(mode="exclude", source="person"), dict(mode="must", source="experience", min_months=0), dict(mode="maybe", source="person"),
                dict(mode="must", source="person", seek=Seek(("x",)))):
        with pytest.raises(QueryError):
            Condition("c", "label", **bad)
    with pytest.raises(QueryError):
        Seek()
    with pytest.raises(QueryError):
        Query(tuple(Condition(f"c{n}", "l", "must", "person") for n in range(13)))
