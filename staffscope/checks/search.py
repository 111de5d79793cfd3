"""Search, ranking and facets over the projected corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facets as facet_ops, rank as rank_ops
from ..operators.hits import (adjacent_pairs, consecutive_ratings, in_status, match_phrases, materialise_hits, never_value,
                              people_where, rating_count_since, segment_flags)
from ..plans.query import Condition, Filters, Query, Seek, person_where, segment_where
from ..plans.search import Search, overflow_contributors
from . import base
from .base import CRITERION
from .inputs import AS_OF, define, load
from .registry import check


def rounded(col="depth"):
    return F.round(F.col(col), 6).alias(col)


def _segment(**kind):
    where, params = segment_where(**kind)
    return {"where": where, "params": params}


def _person(*args, **kind):
    where, params = person_where(*args, **kind)
    return {"where": where, "params": params}


RING = Condition("ring", "worked on rings", "must", "experience", seek=Seek.words("ring"), min_months=12)
PLATE = Condition("plate", "worked on plates elsewhere", "must", "experience", seek=Seek.words("plate"), **_segment(kind="external"))
RED = Condition("red", "anything red", "boost", "experience", seek=Seek.words("red"))
SENIOR = Condition("senior", "level L1 or above", "must", "person", **_person("level_band", at_least="L1"))
NOT_SEVEN = Condition("not7", "never at supplier 7", "exclude", "experience", **_segment(company=["supplier#000000007"]))
BUILDER = Condition("builder", "came through building", "boost", "person", **_person("recruitment", ["BUILDING"]))
LONG_AWAY = Condition("away", "two years elsewhere", "must", "experience", min_months=24, **_segment(kind="external"))
BRAND = Condition("brand", "was at brand 3", "boost", "experience", **_segment(company_tag=["Brand#3"]))
WIDGET = Condition("widget", "widgets of some size", "must", "experience", seek=Seek.words("widget", criterion=CRITERION))
NO_ANVIL = Condition("anvil", "no anvils of some size", "exclude", "experience", seek=Seek.words("anvil", criterion=CRITERION))

FLAGSHIP = Query((RING, PLATE, SENIOR, NOT_SEVEN))
BOOSTED = Query((RING, RED, SENIOR, NOT_SEVEN, BUILDER, LONG_AWAY, BRAND))
JUDGED = Query((WIDGET, NO_ANVIL, RED))
PEOPLE = Query((SENIOR, NOT_SEVEN))
FILTERS = Filters(kind="external", level=("L1", "L2"), min_months=6)


def search(spark, sf, query, filters=None) -> Search:
    views = base.views(spark, sf)
    judged = any(c.seek and c.seek.criterion for c in query.conditions)
    verdicts = base.verdicts(spark, sf).filter("root = 'turn-1'") if judged else None
    return Search(views, query, AS_OF, verdicts, filters or Filters())


# --- shared SQL steps --------------------------------------------------------------------------------
def _caught(word):
    return f"regexp_matches(lower(text), '(^|[^a-z0-9]){word}([^a-z0-9]|$)')"


def _matched(cond, word):
    return f"""
select {cond} as cond, p.id as phrase_id, p.text from {{o_phrase}} p where {_caught(word)}
union select {cond}, p.id, p.text from {{o_phrase}} p join {{fx_term}} t on t.word = p.text
where t.canonical in (select g.canonical from {{o_phrase}} c join {{fx_term}} g on g.word = c.text where {_caught(word)})"""


FACTOR = ("case when route = 'skill' then case engagement when '主导' then 1.0::double when '做过' then 0.85::double "
          "when '提到' then 0.7::double else 0.85::double end else 1.0::double end")


def _hits(cond, word, where="true", judged=False):
    """Hits of one condition with the segment's columns."""
    fits = "v.fits" if judged else "true"
    verdict = "left join {fx_segment_verdict} v on v.content = e.content" if judged else ""
    drop = "and v.fits is distinct from false" if judged else ""
    return f"""
select {cond} as cond, {fits} as fits, ep.route, ep.phrase_id, ep.engagement, case when ep.route = 'skill' then m.text end as phrase,
  {FACTOR} as factor, e.*
from ({_matched(cond, word)}) m join {{o_edge}} ep on ep.phrase_id = m.phrase_id
  join {{cat_experience}} e on e.id = ep.experience_id {verdict} where {where} {drop}"""


NEVER_SEVEN = ("not exists (select 1 from {cat_experience} e where e.emp_id = p.emp_id "
               "and contains(lower(e.company), 'supplier#000000007'))")
define("q_senior", f"select p.* from {{cat_person}} p where p.level_rank >= 1 and {NEVER_SEVEN}")
define("q_boosted_people", f"""
select p.*, recruitment = 'BUILDING' as prefer_builder,
  exists (select 1 from {{cat_experience}} e where e.emp_id = p.emp_id and e.company_tag = 'Brand#3') as prefer_brand
from {{cat_person}} p where p.level_rank >= 1 and {NEVER_SEVEN}
  and (select coalesce(sum(e.months), 0) from {{cat_experience}} e where e.emp_id = p.emp_id and e.kind = 'external') >= 24""")


def _facts(hits):
    return f"""
select * from (select cond, fits, route, phrase_id, engagement, phrase, factor, id, emp_id, end_date, months, seq_l1, seq_l2, kind,
  company_tag, main_industries, skills, row_number() over (partition by cond, id
  order by factor desc, (route = 'description')::int, route, phrase_id nulls last) as n from ({hits})) where n = 1"""


define("q_flag_hits", _hits(0, "ring") + " union all " + _hits(1, "plate", "e.kind = 'external'"))
define("q_flag_facts", _facts("select * from {q_flag_hits} where emp_id in (select emp_id from {q_senior})"))
define("q_boost_hits", _hits(0, "ring") + " union all " + _hits(1, "red"))
define("q_boost_facts", _facts("select * from {q_boost_hits} where emp_id in (select emp_id from {q_boosted_people})"))
define("q_judged_hits", _hits(0, "widget", judged=True) + " union all " + _hits(1, "anvil", judged=True) + " union all " + _hits(2, "red"))
define("q_judged_people", """
select * from {cat_person} where emp_id not in (select emp_id from {q_judged_hits} where cond = 1 and fits)""")
define("q_judged_all", _facts("select * from {q_judged_hits} where cond in (0, 2) and emp_id in (select emp_id from {q_judged_people})"))
define("q_judged_open", """
select distinct cond, id, emp_id from {q_judged_hits} where cond = 1 and fits is null and emp_id in (select emp_id from {q_judged_people})""")
define("q_judged_facts", "select * from {q_judged_all} where fits and emp_id not in (select emp_id from {q_judged_open})")


def _basis(facts):
    return f"""select emp_id, cond, count(*) as segments, cast(sum(months) as bigint) as months,
  case when count(*) filter (end_date is null) > 0 then null else max(end_date) end as end_date, max(factor) as factor
from {facts} group by emp_id, cond"""


DEPTH = ("factor * (months / (months + 48.0::double)) * (36.0::double / (36.0::double + case when end_date is null then 0 else "
         "greatest(0, 2002 * 12 + 1 - (year(end_date) * 12 + month(end_date))) end))")
define("q_flag_basis", _basis("{q_flag_facts}"))
define("q_flag_depth", f"select *, {DEPTH} as depth from {{q_flag_basis}}")
define("q_flag_rank", """
select a.emp_id, a.depth * b.depth as depth from {q_flag_depth} a join {q_flag_depth} b on a.emp_id = b.emp_id
where a.cond = 0 and b.cond = 1 and a.months >= 12""")
define("q_boost_depth", f"select *, {DEPTH} as depth from (" + _basis("{q_boost_facts}") + ")")
define("q_boost_rank", """
select a.emp_id, a.depth * coalesce(1 + 0.5::double * b.depth, 1) * case when p.prefer_builder then 1.5::double else 1 end
  * case when p.prefer_brand then 1.5::double else 1 end as depth
from {q_boost_depth} a join {q_boosted_people} p on p.emp_id = a.emp_id
  left join {q_boost_depth} b on a.emp_id = b.emp_id and b.cond = 1 where a.cond = 0 and a.months >= 12""")


def _judged_rank(facts):
    return f"""
select a.emp_id, a.depth * coalesce(1 + 0.5::double * b.depth, 1) as depth
from (select *, {DEPTH} as depth from ({_basis(facts)}) where cond = 0) a
  left join (select *, {DEPTH} as depth from ({_basis(facts)}) where cond = 2) b on a.emp_id = b.emp_id"""


define("q_judged_rank", _judged_rank("{q_judged_facts}"))
define("q_judged_candidates", _judged_rank("{q_judged_all}"))
define("q_judged_pending", """
select u.cond, u.id, u.emp_id, u.cond = 2 as boost, c.depth, p.level_rank, p.level_band
from (select cond, id, emp_id from {q_judged_all} where fits is null union all select cond, id, emp_id from {q_judged_open}) u
  join {q_judged_candidates} c on c.emp_id = u.emp_id join {cat_person} p on p.emp_id = u.emp_id""")


# --- conditions and gates ----------------------------------------------------------------------------
@check("match_phrases", "select cast(cond as int) as cond, phrase_id, text from (" + _matched(0, "widget") + " union all " + _matched(1, "ring") + ")")
def match_phrases_(spark, sf):
    t = base.tables(spark, sf)
    return match_phrases(t["phrase"], t["term"], {0: Seek.words("widget").patterns, 1: Seek.words("ring").patterns})


@check("materialise_hits", """
select cast(cond as int) as cond, id, emp_id, route, fits, phrase, engagement from (""" + _hits(0, "widget", judged=True) + """)
union all select 1, id, emp_id, case when kind = 'internal' then 'role' else 'title' end, true, null, null from {cat_experience}""")
def hits_(spark, sf):
    query = Query((WIDGET, Condition("any", "any segment", "boost", "experience", seek=Seek(criterion="x"))))
    s = search(spark, sf, query)
    out = materialise_hits(s.views["edge"], s.views["experience"], s.matched, [1], {0: base.verdicts(spark, sf).first()["criterion_key"], 1: None}, s.verdicts)
    return out.select("cond", "id", "emp_id", "route", "fits", "phrase", "engagement")


@check("catalog_person", """
select emp_id, level_band, level_rank, education, education_rank, school, school_tier, overseas, recruitment, cur_dept from {cat_person}""")
def catalog_person(spark, sf):
    return base.views(spark, sf)["person"].select(
        "emp_id", "level_band", "level_rank", "education", "education_rank", "school", "school_tier", "overseas", "recruitment", "cur_dept")


@check("catalog_experience", """
select id, emp_id, kind, months, company, company_tag, company_name, company_group, array_to_string(main_industries, ',') as main_industries,
  array_to_string(industries, ',') as industries, array_to_string(company_circles, ',') as company_circles, department, title, seq_l1, seq_l2,
  array_to_string(skills, ',') as skills from {cat_experience}""")
def catalog_experience(spark, sf):
    e = base.views(spark, sf)["experience"]
    text = lambda c: F.array_join(c, ",").alias(c)
    return e.select("id", "emp_id", "kind", "months", "company", "company_tag", "company_name", "company_group", text("main_industries"),
                    text("industries"), text("company_circles"), "department", "title", "seq_l1", "seq_l2", text("skills"))


@check("catalog_rating", "select * from {cat_rating}")
def catalog_rating(spark, sf):
    return base.views(spark, sf)["rating"].drop("stream")


@check("catalog_status", "select * from {cat_status}")
def catalog_status(spark, sf):
    return base.views(spark, sf)["status"].drop("stream")


@check("gate_background", """
select emp_id from {cat_person} p where exists (select 1 from {cat_experience} e where e.emp_id = p.emp_id and e.company_tag = 'Brand#3')""")
def gate_background(spark, sf):
    gate = Condition("b", "was at brand 3", "must", "experience", **_segment(company_tag=["Brand#3"]))
    return search(spark, sf, Query((gate,))).eligible.select("emp_id")


@check("gate_background_months", """
select emp_id from {cat_person} p where (select coalesce(sum(e.months), 0) from {cat_experience} e
  where e.emp_id = p.emp_id and e.kind = 'external') >= 24""")
def gate_background_months(spark, sf):
    return search(spark, sf, Query((LONG_AWAY,))).eligible.select("emp_id")


@check("gate_exclude", "select emp_id from {cat_person} p where " + NEVER_SEVEN)
def gate_exclude(spark, sf):
    return search(spark, sf, Query((NOT_SEVEN,))).eligible.select("emp_id")


@check("gate_exclude_judged", "select emp_id from {q_judged_people}")
def gate_exclude_judged(spark, sf):
    return search(spark, sf, JUDGED).eligible.select("emp_id")


@check("gate_person_rank", """
select emp_id from {cat_person} p where p.level_rank >= (select max(s.rank) from {o_scale} s where s.stream = 'level' and s.value = 'L2')
  and education in ('本科', '硕士') and contains(lower(school), 'school 1')""")
def gate_person_rank(spark, sf):
    gates = (Condition("l", "L2 up", "must", "person", **_person("level_band", at_least="L2")),
             Condition("e", "education", "must", "person", **_person("education", ["本科", "硕士"])),
             Condition("s", "school", "must", "person", **_person("school", ["School 1"])))
    return search(spark, sf, Query(gates)).eligible.select("emp_id")


def _gate(spark, sf, pair):
    views = base.views(spark, sf)
    return people_where(views, {0: pair}).select("emp_id")


@check("rating_count_since", """
select emp_id from {cat_person} p where (select count(*) from {cat_rating} r where r.emp_id = p.emp_id
  and r.period_end >= date '1999-01-01' and r.value_rank >= 3) >= 2""")
def rating_count_since_(spark, sf):
    return _gate(spark, sf, rating_count_since("3-MEDIUM", 2, "1999-01-01", "perf"))


@check("consecutive_ratings", """
select emp_id from {cat_person} p where exists (select 1 from {cat_rating} a join {cat_rating} b on a.emp_id = b.emp_id
  and b.period_start = a.period_end + 1 where a.emp_id = p.emp_id and a.value_rank >= 3 and b.value_rank >= 3)""")
def consecutive_ratings_(spark, sf):
    return _gate(spark, sf, consecutive_ratings("3-MEDIUM", "perf"))


@check("adjacent_pairs", """
select distinct a.emp_id from {cat_rating} a join {cat_rating} b on a.emp_id = b.emp_id
  and b.period_start = a.period_end + 1 where a.value_rank >= 4 and b.value_rank >= 4""")
def adjacent_pairs_(spark, sf):
    return adjacent_pairs(base.views(spark, sf)["rating"], 4).select("emp_id")


@check("never_value", """
select emp_id from {cat_person} p where exists (select 1 from {cat_rating} r where r.emp_id = p.emp_id)
  and not exists (select 1 from {cat_rating} r where r.emp_id = p.emp_id and r.value = '5-LOW')""")
def never_value_(spark, sf):
    return _gate(spark, sf, never_value("5-LOW", "perf"))


@check("in_status", """
select emp_id from {cat_person} p where exists (select 1 from {cat_status} s where s.emp_id = p.emp_id and s.value = 'signup'
  and s.valid_from <= date '2024-01-15' and (s.valid_to is null or s.valid_to >= date '2024-01-15'))""")
def in_status_(spark, sf):
    return _gate(spark, sf, in_status("signup", "pool", "2024-01-15"))


@check("view_filters", """
select emp_id from {cat_person} p where exists (select 1 from {cat_experience} e where e.emp_id = p.emp_id
    and (contains(lower(e.company), '#000000001') or contains(lower(e.company), '#000000002')))
  and exists (select 1 from {cat_experience} e where e.emp_id = p.emp_id and (contains(lower(e.department), 'asia') or contains(lower(e.department_path), 'asia')))
  and contains(lower(school), 'school 2')""")
def view_filters(spark, sf):
    names = Filters(company=("#000000001", "#000000002"), department=("asia",), school=("school 2",))
    return search(spark, sf, Query((Condition("all", "all", "must", "person"),)), names).eligible.select("emp_id")


# --- facts and population ------------------------------------------------------------------------------
@check("claim_facts", "select cast(cond as int) as claim, id, emp_id, route, phrase, engagement, factor, months, end_date from {q_flag_facts}")
def claim_facts(spark, sf):
    return search(spark, sf, FLAGSHIP).facts.select("claim", "id", "emp_id", "route", "phrase", "engagement", "factor", "months", "end_date")


@check("split_facts", """
select cond = 2 as boost, fits is null as open, count(*) as facts, count(distinct emp_id) as people from {q_judged_all} group by 1, 2""")
def split_facts(spark, sf):
    return (search(spark, sf, JUDGED).all_facts.groupBy((F.col("claim") == 1).alias("boost"), F.col("fits").isNull().alias("open"))
            .agg(F.count("*").alias("facts"), F.count_distinct("emp_id").alias("people")))


@check("population", "select p.emp_id, e.id, e.months, p.level_band from {q_senior} p left join {cat_experience} e on e.emp_id = p.emp_id")
def population(spark, sf):
    return search(spark, sf, PEOPLE).population.select("emp_id", "id", "months", "level_band")


@check("preferred", "select emp_id, coalesce(prefer_builder, false) as builder, coalesce(prefer_brand, false) as brand from {q_boosted_people}")
def preferred(spark, sf):
    people = search(spark, sf, BOOSTED).eligible
    return people.select("emp_id", F.coalesce("prefer4", F.lit(False)).alias("builder"), F.coalesce("prefer6", F.lit(False)).alias("brand"))


@check("unconfirmed", "select cast(cond as int) as cond, id, emp_id from {q_judged_all} where fits is null union all select cast(cond as int), id, emp_id from {q_judged_open}")
def unconfirmed(spark, sf):
    s = search(spark, sf, JUDGED)
    return s.unconfirmed.select("cond", "id", "emp_id").unionByName(s.open_exclusions.select("cond", "id", "emp_id"))


@check("candidates", "select emp_id, round(depth, 6) as depth from {q_judged_candidates}")
def candidates(spark, sf):
    return search(spark, sf, JUDGED).candidates.select("emp_id", rounded())


@check("incomplete", """
select (select count(*) from {q_judged_pending} where not boost) as open,
  (select min_by(p.level_band, p.level_rank) from {q_judged_candidates} c join {cat_person} p on p.emp_id = c.emp_id
   where p.level_rank > (select max(level_rank) from {q_judged_pending} where not boost)) as above
where (select count(*) from {q_judged_pending} where not boost) > 0""")
def incomplete(spark, sf):
    return search(spark, sf, JUDGED).incomplete()


define("q_counts", "select cond as claim, count(*) as facts from {q_boost_facts} group by cond")


@check("overflow_contributors", """
select cast(claim as int) as claim, facts from (
  select *, sum(facts) over () as total, sum(facts) over (order by facts desc, claim) - facts as before from {q_counts})
where total - before > 3000""")
def overflow(spark, sf):
    return overflow_contributors(search(spark, sf, BOOSTED).fact_counts(), 3000)


SELECTED = """
select 0 as cond, emp_id, id, months from {q_boost_hits} where cond = 0
union select 1, emp_id, id, months from {q_boost_hits} where cond = 1
union select 2, emp_id, null, 0 from {cat_person} where level_rank >= 1
union select 3, emp_id, id, months from {cat_experience} where contains(lower(company), 'supplier#000000007')
union select 4, emp_id, null, 0 from {cat_person} where recruitment = 'BUILDING'
union select 5, emp_id, id, months from {cat_experience} where kind = 'external'
union select 6, emp_id, id, months from {cat_experience} where company_tag = 'Brand#3'"""
define("q_selected_rows", SELECTED)
define("q_selected", """
select cond, emp_id, id from (select *, sum(months) over (partition by cond, emp_id) as total from {q_selected_rows})
where case cond when 0 then total >= 12 when 5 then total >= 24 else true end""")


@check("selection", "select cond, emp_id, id from {q_selected}")
def selection(spark, sf):
    return search(spark, sf, BOOSTED).selection()


@check("probe_counts", "select cond, count(distinct emp_id) as people from {q_selected} group by cond")
def probe_counts(spark, sf):
    return search(spark, sf, BOOSTED).probe()


# --- ranking ---------------------------------------------------------------------------------------------
@check("claim_basis", "select emp_id, cast(cond as int) as claim, segments, months, end_date, factor from {q_flag_basis}")
def claim_basis(spark, sf):
    return rank_ops.basis(search(spark, sf, FLAGSHIP).facts)


@check("claim_depth", "select emp_id, cast(cond as int) as claim, round(depth, 6) as depth from {q_flag_depth}")
def claim_depth(spark, sf):
    return rank_ops.claim_depth(rank_ops.basis(search(spark, sf, FLAGSHIP).facts), AS_OF).select("emp_id", "claim", rounded())


@check("rank_roster", "select emp_id, round(depth, 6) as depth from {q_flag_rank}")
def rank_roster(spark, sf):
    return search(spark, sf, FLAGSHIP).ranked.select("emp_id", rounded())


FLAGSHIP_SQL = """
select r.rank, r.emp_id, p.name, p.cur_dept, r.depth from (
  select emp_id, round(depth, 6) as depth, cast(row_number() over (order by depth desc, emp_id) as int) as rank from {q_flag_rank}) r
join {cat_person} p on p.emp_id = r.emp_id where rank <= 50"""


@check("flagship", FLAGSHIP_SQL)
def flagship(spark, sf):
    return search(spark, sf, FLAGSHIP).roster().select("rank", "emp_id", "name", "cur_dept", rounded())


@check("rank_with_boost", "select emp_id, round(depth, 6) as depth from {q_boost_rank}")
def rank_with_boost(spark, sf):
    return search(spark, sf, BOOSTED).ranked.select("emp_id", rounded())


@check("rank_judged", "select emp_id, round(depth, 6) as depth from {q_judged_rank}")
def rank_judged(spark, sf):
    return search(spark, sf, JUDGED).ranked.select("emp_id", rounded())


@check("people_roster", "select emp_id from {q_senior} order by emp_id limit 500")
def people_roster(spark, sf):
    return search(spark, sf, PEOPLE).roster(500).select("emp_id")


KEEP = "kind = 'external' and months >= 6 and level_band in ('L1', 'L2')"
define("q_flag_dims", "select f.*, p.level_band, p.level_rank, p.recruitment, p.education, p.education_rank, p.school_tier, p.overseas from {q_flag_facts} f join {cat_person} p on p.emp_id = f.emp_id")
define("q_kept_depth", f"select *, {DEPTH} as depth from (" + _basis(f"(select * from {{q_flag_dims}} where {KEEP})") + ")")


@check("rank_filtered", """
select a.emp_id, round(a.depth * b.depth, 6) as depth from {q_kept_depth} a join {q_kept_depth} b on a.emp_id = b.emp_id
where a.cond = 0 and b.cond = 1 and a.months >= 12""")
def rank_filtered(spark, sf):
    return search(spark, sf, FLAGSHIP, FILTERS).ranked.select("emp_id", rounded())


# --- facets -----------------------------------------------------------------------------------------------
def _dims(source):
    one = lambda dim, col, rank="null": (f"select emp_id, cond, months, kind, level_band, full_months, '{dim}' as dim, {col} as value, {rank} as rank from {source} "
                                         f"where {col} is not null and {col} not in ('', '未知')")
    return " union all ".join([
        f"select emp_id, cond, months, kind, level_band, full_months, 'seq' as dim, concat(seq_l1, chr(1), seq_l2) as value, null as rank from {source} where seq_l1 <> '' and seq_l2 <> ''",
        one("level", "level_band", "level_rank"), one("kind", "kind"),
        f"select emp_id, cond, months, kind, level_band, full_months, 'min_months', cast(b as varchar), null from {source}, (values (6), (12), (24), (36)) t(b) where months >= b",
        one("company_tag", "company_tag"),
        f"select emp_id, cond, months, kind, level_band, full_months, 'industry', unnest(main_industries), null from {source}",
        f"select emp_id, cond, months, kind, level_band, full_months, 'skill', unnest(skills), null from {source}",
        one("recruitment", "recruitment"), one("education", "education", "education_rank"), one("school_tier", "school_tier"),
        one("overseas", "overseas")])


define("q_facet_rows", _dims("(select *, months as full_months from {q_flag_dims})"))


def _facet_sql(live):
    return f"""
select dim, value, cast(count(*) filter (lr >= 12 and lp > 0) as bigint) as n, cast(min(rank) as int) as rank from (
  select dim, value, emp_id, min(rank) as rank, sum(months) filter (cond = 0) as r, count(*) filter (cond = 1) as p,
    sum(months) filter (cond = 0 and ({live})) as lr, count(*) filter (cond = 1 and ({live})) as lp
  from {{q_facet_rows}} group by dim, value, emp_id)
group by dim, value having count(*) filter (r >= 12 and p > 0) > 0"""


@check("facets_multi", _facet_sql("true"))
def facets_multi(spark, sf):
    return search(spark, sf, FLAGSHIP).facets()


@check("facets_filtered", _facet_sql("(dim = 'kind' or kind = 'external') and (dim = 'min_months' or full_months >= 6) and (dim = 'level' or level_band in ('L1', 'L2'))"))
def facets_filtered(spark, sf):
    return search(spark, sf, FLAGSHIP, FILTERS).facets()


@check("facets_single", """
select dim, value, cast(count(*) as bigint) as n, cast(min(rank) as int) as rank from (
  select dim, value, emp_id, min(rank) as rank from {q_facet_rows} where cond = 0 group by 1, 2, 3 having sum(months) >= 12) group by dim, value""")
def facets_single(spark, sf):
    return search(spark, sf, Query((RING, SENIOR, NOT_SEVEN))).facets()


define("q_population_rows", _dims("""(select p.emp_id, 0 as cond, e.months, e.months as full_months, e.kind, p.level_band, p.level_rank, e.seq_l1, e.seq_l2, e.company_tag,
  e.main_industries, e.skills, p.recruitment, p.education, p.education_rank, p.school_tier, p.overseas
  from {q_senior} p left join {cat_experience} e on e.emp_id = p.emp_id)"""))


@check("population_facets", """
select dim, value, count(distinct emp_id) as n, cast(min(rank) as int) as rank from {q_population_rows} group by dim, value""")
def population_facets(spark, sf):
    return search(spark, sf, PEOPLE).facets()


# --- evidence -----------------------------------------------------------------------------------------------
define("q_flag_page", "select * from {q_flag_rank} order by depth desc, emp_id limit 50")
define("q_flag_evidence", """
select f.emp_id, f.cond, f.id, f.route, f.phrase, f.engagement, f.months, b.segments, b.months as basis_months, f.kind,
  row_number() over (partition by f.emp_id, f.cond order by f.factor desc, f.months desc, f.id) as place
from {q_flag_facts} f join {q_flag_page} p on p.emp_id = f.emp_id
  join {q_flag_basis} b on b.emp_id = f.emp_id and b.cond = f.cond where b.cond = 1 or b.months >= 12""")


@check("page_evidence", "select emp_id, cast(cond as int) as claim, id, route, phrase, engagement, months, cast(place as int) as place from {q_flag_evidence}")
def page_evidence(spark, sf):
    return search(spark, sf, FLAGSHIP).evidence().select("emp_id", "claim", "id", "route", "phrase", "engagement", "months", "place")


@check("best_evidence", "select emp_id, cast(cond as int) as claim, id, route from {q_flag_evidence} where place = 1")
def best_evidence(spark, sf):
    return search(spark, sf, FLAGSHIP).evidence().filter("place = 1").select("emp_id", "claim", "id", "route")
