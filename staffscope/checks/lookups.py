"""Exploration, verdict reading, logs and evaluation over the projected corpus."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.text import contains_ci
from ..operators import evals, explore, logs, reading
from ..operators.companies import leaf_industries
from ..operators.derive import first_write
from ..operators.hits import criterion_key, save_verdicts
from ..operators.numbering import numbered
from ..operators.rank import ranked_all
from ..operators.terms import term_closure
from ..plans.export import export_roster
from ..plans.lint import lint_query
from ..plans.query import Condition, Query, Seek
from ..session import with_scalars
from . import base
from .inputs import AS_OF, define, load
from .registry import check
from .search import BOOSTED, FLAGSHIP, JUDGED, NO_ANVIL, RED, RING, SENIOR, WIDGET, rounded, search
from .words import in_use

# --- values, names, phrases ---------------------------------------------------------------------------


@check("values_of", """
select name, count(distinct emp_id) as people, cast(null as int) as rank from (select emp_id, unnest(industries) as name from {cat_experience}) group by name""")
def values_of(spark, sf):
    return explore.values_of(base.views(spark, sf)["experience"], "industries")


def _vocab(dim, column, relation, rank="null"):
    return f"select '{dim}' as dim, {column} as name, count(distinct emp_id) as people, cast(min({rank}) as int) as rank from {{cat_{relation}}} where {column} not in ('', '未知') group by {column}"


@check("vocabularies", " union all ".join([
    _vocab("company_tag", "company_tag", "experience"), _vocab("level", "level_band", "person", "level_rank"), _vocab("recruitment", "recruitment", "person"),
    _vocab("education", "education", "person", "education_rank"), _vocab("school_tier", "school_tier", "person"), _vocab("overseas", "overseas", "person")]))
def vocabularies(spark, sf):
    return explore.vocabularies(base.views(spark, sf))


def _lookup(name, shown, columns, relation):
    test = " or ".join(f"contains(lower({c}), lower('{name}'))" for c in columns)
    return f"""select * from (select '{name}' as query, {shown} as name, count(distinct emp_id) as people from {{cat_{relation}}} where {test} group by {shown}
  order by people desc, {shown} limit 8), (select count(distinct emp_id) as total from {{cat_{relation}}} where {test})"""


@check("lookup_names", " union all ".join("select * from (" + _lookup(n, "company", ["company"], "experience") + ")" for n in ("#00000001", "supplier#00000009", "%")))
def lookup_names(spark, sf):
    return explore.lookup_names(base.views(spark, sf), "company", ["#00000001", "supplier#00000009", "%", "#00000001"])


@check("lookup_departments", "select * from (" + _lookup("ASIA", "department", ["department", "department_path"], "experience") + ")")
def lookup_departments(spark, sf):
    return explore.lookup_names(base.views(spark, sf), "department", ["ASIA"])


def _find(pattern, regex):
    rows = f"""(select distinct e.text, s.emp_id from {{o_edge}} e join {{o_experience}} s on s.id = e.experience_id
  where e.route <> 'description' and not s.unemployed and regexp_matches(lower(e.text), '{regex}'))"""
    return f"""select '{pattern}' as pattern, text as name, count(distinct emp_id) as people, null as phrases from {rows} group by text order by people desc, text limit 40"""


def _found(pattern, regex):
    return f"""select '{pattern}' as pattern, cast(null as varchar) as name, count(distinct emp_id) as people, count(distinct text) as phrases from {{o_edge}} e
  join {{o_experience}} s on s.id = e.experience_id where e.route <> 'description' and not s.unemployed and regexp_matches(lower(e.text), '{regex}')"""


@check("find_phrases", " union all ".join(f"select * from ({part})" for part in (
    _find("RING|gear$", "ring|gear$"), _found("RING|gear$", "ring|gear$"), _find("^red", "^red"), _found("^red", "^red"))))
def find_phrases(spark, sf):
    v = base.views(spark, sf)
    return explore.find_phrases(v["edge"], v["phrase"], v["experience"], ["RING|gear$", "^red"])


@check("suggest", """
select value, people, lead from (select coalesce(t.canonical, e.text) as value, count(distinct s.emp_id) as people, bool_or(starts_with(lower(e.text), 'co')) as lead
  from {o_edge} e join {o_experience} s on s.id = e.experience_id left join {fx_term} t on t.word = e.text
  where e.route in ('title', 'skill') and not s.unemployed and contains(lower(e.text), 'co') and not coalesce(t.excluded, false) group by 1)
order by lead desc, people desc, value limit 8""")
def suggest(spark, sf):
    return explore.suggest(base.views(spark, sf), "what", "CO")


@check("suggest_company", """
select value, count(distinct emp_id) as people, starts_with(lower(value), 'supplier#00000001') as lead from (select company as value, emp_id from {cat_experience})
where contains(lower(value), 'supplier#00000001') group by value order by lead desc, people desc, value limit 8""")
def suggest_company(spark, sf):
    return explore.suggest(base.views(spark, sf), "company", "Supplier#00000001")


# --- coverage -------------------------------------------------------------------------------------------
@check("stream_facts", """
select stream, label, kind, people, periods, first, latest, latest_end, vals as "values" from (
  select s.stream, s.label, s.kind, count(distinct r.emp_id) as people, count(distinct r.period_start) as periods, min(r.period_start) as first, max(r.period_start) as latest
  from (values ('perf', 'Performance', 'rating'), ('pool', 'Talent pool', 'status')) s(stream, label, kind) left join {o_record} r on r.stream = s.stream group by 1, 2, 3) a
join (select stream as st, max(period_end) as latest_end from {o_record} r where period_start = (select max(m.period_start) from {o_record} m where m.stream = r.stream) group by 1) l on l.st = a.stream
join (select 'perf' as sv, string_agg(value, ',' order by rank) as vals from {o_scale} where stream = 'perf'
  union all select 'pool', string_agg(value, ',' order by n desc, value) from (select value, count(distinct emp_id) as n from {o_record} where stream = 'pool' group by value)) v on v.sv = a.stream""")
def stream_facts(spark, sf):
    t = base.tables(spark, sf)
    return explore.stream_facts(t["record_stream"], t["employee_record"], t["scale"]).drop("period").withColumn("values", F.array_join("values", ","))


@check("company_facts", """
with people as (select i.name, i.parent, coalesce(m.n, 0) as main, coalesce(a.n, 0) as n_any from {fx_industry} i
  left join (select u as name, count(distinct emp_id) as n from (select emp_id, unnest(main_industries) as u from {cat_experience}) group by 1) m on m.name = i.name
  left join (select u as name, count(distinct emp_id) as n from (select emp_id, unnest(industries) as u from {cat_experience}) group by 1) a on a.name = i.name)
select p.name, p.parent, p.main, p.n_any as "any", case when p.parent is null then concat('-', p.n_any, ':', p.name) else concat('-', u.n_any, ':', u.name, '>-', p.n_any, ':', p.name) end as path
from people p left join people u on u.name = p.parent""")
def company_facts(spark, sf):
    t = base.views(spark, sf)
    rows = explore.company_facts(t["experience"], load(spark, sf, "fx_industry"))
    step = lambda s: F.concat(s["less"].cast("string"), F.lit(":"), s["at"])
    return rows.withColumn("path", F.array_join(F.transform("path", step), ">"))


@check("company_coverage", "select count(*) as segments, count(company_name) as recognized, count(industries) as labelled from {cat_experience} where kind = 'external'")
def company_coverage(spark, sf):
    return explore.company_coverage(base.views(spark, sf)["experience"])


@check("overview", """
select 'person' as relation, count(*) as rows from {cat_person} union all select 'experience', count(*) from {cat_experience} union all select 'rating', count(*) from {cat_rating}
union all select 'status', count(*) from {cat_status} union all select 'scale', count(*) from {o_scale}""")
def overview(spark, sf):
    return explore.overview(base.views(spark, sf), ("person", "experience", "rating", "status", "scale"))


# --- people ------------------------------------------------------------------------------------------------
@check("list_employees", """
select p.emp_id, p.name, p.cur_dept, count(s.id) as segments, count(s.id) filter (s.derived_identity is distinct from 'v2') as pending
from (select * from {fx_person} where contains(lower(name), '7') or contains(lower(emp_id), '7') order by emp_id limit 50 offset 50) p left join {fx_segment} s on s.emp_id = p.emp_id
group by p.emp_id, p.name, p.cur_dept""")
def list_employees(spark, sf):
    identity = load(spark, sf, "fx_segment").select("id", "emp_id", "derived_identity")
    return explore.list_employees(base.employee(spark, sf), identity, "v2", "7", page=2).drop("cur_title")


@check("employee_detail", """
select e.id, e.start_date, e.months, e.title, coalesce((select string_agg(text || coalesce('/' || engagement, ''), ',' order by text) from {o_edge} x where x.experience_id = e.id and x.route = 'skill'), '') as skills
from {o_experience} e where e.emp_id = '77'""")
def employee_detail(spark, sf):
    t = base.tables(spark, sf)
    rows = explore.employee_segments(t["experience"], t["experience_phrase"], t["phrase"], F.col("emp_id") == "77", "v2")
    said = F.array_join(F.transform("skills", lambda s: F.concat_ws("/", s["text"], s["engagement"])), ",")
    return rows.select("id", "start_date", "months", "title", F.coalesce(said, F.lit("")).alias("skills"))


@check("employee_timeline", """
select e.id, e.kind, coalesce((select string_agg(m, ',' order by m) from (select unnest(c.main_industries) as m) x
  where not exists (select 1 from {fx_industry} f where f.parent = x.m and list_contains(c.main_industries, f.name))), '') as main_industries
from {o_experience} e left join {o_spelling} s on s.company = e.company left join {o_company} c on c.name = s.resolved where e.emp_id in ('7', '8')""")
def employee_timeline(spark, sf):
    t = base.tables(spark, sf)
    leaves = leaf_industries(t["company"], load(spark, sf, "fx_industry"))
    rows = explore.employee_timeline(t["experience"], t["company_alias"], leaves, F.col("emp_id").isin("7", "8"))
    return rows.select("id", "kind", F.coalesce(F.array_join("main_industries", ","), F.lit("")).alias("main_industries"))


@check("page", """
select id, kind, row_number() over (order by id) as n from {fx_segment}""")
def page(spark, sf):
    return numbered(load(spark, sf, "fx_segment").select("id", "kind"), [F.col("id")])


# --- reading ---------------------------------------------------------------------------------------------------
@check("save_verdicts", """
select content, fits from (select content, fits, row_number() over (partition by content order by written_order) as n from {fx_verdict}) where n = 1""")
def save_verdicts_(spark, sf):
    v = load(spark, sf, "fx_verdict").withColumn("root", F.lit("r"))
    early = first_write(v.filter("not fits"), ["root", "criterion_key", "content"], F.col("written_order"))
    stored = first_write(v, ["root", "criterion_key", "content"], F.col("written_order")).join(early.select("content"), "content", "left_semi")
    return save_verdicts(stored.select("root", "criterion_key", "content", "fits"), v, F.col("written_order")).select("content", "fits")


define("q_reading", """
select cond, id, emp_id, level_rank, depth from {q_judged_pending} where not boost or (select count(*) from {q_judged_pending} where not boost) = 0""")


@check("reading_list", """
select cast(cond as int) as cond, id, emp_id, level_rank, round(r.depth, 6) as depth,
  row_number() over (order by level_rank desc nulls last, r.depth desc, emp_id, r.cond, id) as place from {q_reading} r""")
def reading_list(spark, sf):
    return search(spark, sf, JUDGED).reading_list().select("cond", "id", "emp_id", "level_rank", rounded(), "place")


def _reading_order():
    return [F.desc_nulls_last("level_rank"), F.desc("depth"), F.col("emp_id"), F.col("cond"), F.col("id")]


@check("plan_batches", """
select cast(cond as int) as cond, id, cast(floor((n - 1) / 40) as bigint) as batch, cast((n - 1) % 40 + 1 as int) as n from (
  select cond, id, row_number() over (partition by cond order by level_rank desc nulls last, round(depth, 9) desc, emp_id, id) as n from {q_reading})""")
def plan_batches(spark, sf):
    rows = search(spark, sf, JUDGED).to_read().withColumn("depth", F.round("depth", 9))
    return reading.plan_batches(rows, _reading_order(), 40).select("cond", "id", "batch", "n")


define("q_text", """
select e.id, concat_ws(chr(10), case when kind = 'internal' then concat('公司内的任职，部门：', coalesce(nullif(department_path, ''), nullif(department, ''), '未登记'))
    else concat('入职前的经历，公司：', coalesce(nullif(company, ''), '未登记')) end,
  case when kind = 'internal' then concat('序列：', seq_l1, ' · ', seq_l2) end, concat('岗位：', coalesce(nullif(title, ''), '未登记')),
  (select '技能：' || string_agg(concat_ws(' ', engagement, text), '、' order by text) from {o_edge} x where x.experience_id = e.id and x.route = 'skill'),
  case when description <> '' then concat('简历原文：', description) end) as text from {o_experience} e""")


@check("segment_text", "select id, text from {q_text}")
def segment_text(spark, sf):
    t = base.tables(spark, sf)
    return reading.segment_text(t["experience"], t["experience_phrase"], t["phrase"]).select("id", "text")


def _long_titles(criterion, texts):
    """A judge for the checks: the text names the larger part sizes."""
    return [n + 1 for n, text in enumerate(texts) if "LARGE" in text or "PROMO" in text]


@check("judge_batches", """
select cast(cond as int) as cond, r.id, contains(text, 'LARGE') or contains(text, 'PROMO') as fits from {q_reading} r join {q_text} t on t.id = r.id""")
def judge_batches(spark, sf):
    t = base.tables(spark, sf)
    texts = reading.segment_text(t["experience"], t["experience_phrase"], t["phrase"])
    batches = reading.plan_batches(search(spark, sf, JUDGED).to_read(), _reading_order())
    criteria = {at: c.seek.criterion for at, c in enumerate(JUDGED.conditions) if c.seek and c.seek.criterion}
    return reading.judge_batches(batches.join(texts, "id"), _long_titles, criteria).select("cond", "id", "fits")


# --- logs ------------------------------------------------------------------------------------------------------------
def _turns(spark, sf):
    t = load(spark, sf, "fx_turn")
    return t.withColumn("created_at", F.timestamp_add("MINUTE", F.col("seq"), F.to_timestamp(F.lit("2024-01-01"))))


@check("thread", "select t.id, cast(t.seq as bigint) as depth from {fx_turn} t where root_turn_id = '5-0'")
def thread(spark, sf):
    return logs.thread(load(spark, sf, "fx_turn"), "5-1").select("id", "depth")


@check("recent", """
select t.id, r.raw_text as title, coalesce(case when t.role = 'user' then t.raw_text end, case when p.role = 'user' then p.raw_text end) as spec
from (select * from {fx_turn} t where owner_id = '3' and not exists (select 1 from {fx_turn} n where n.parent_turn_id = t.id) order by seq desc, id desc limit 11) t
join {fx_turn} r on r.id = t.root_turn_id left join {fx_turn} p on p.id = t.parent_turn_id""")
def recent(spark, sf):
    turns = _turns(spark, sf).withColumn("spec", F.when(F.col("role") == "user", F.col("raw_text")))
    return logs.recent(turns, "3", 10).select("id", "title", "spec")


@check("recent_page", """
with chains as (select t.*, row_number() over (order by seq desc, id desc) as n from {fx_turn} t where owner_id = '3' and not exists (select 1 from {fx_turn} f where f.parent_turn_id = t.id))
select t.id, r.raw_text as title, (select count(*) from {fx_turn} o where o.owner_id = '3' and o.parent_turn_id is null) as total
from chains t join {fx_turn} r on r.id = t.root_turn_id where t.n between 5 and 10""")
def recent_page(spark, sf):
    """The page behind a cursor, the last row of the page before, and how many chains there are."""
    turns = _turns(spark, sf).withColumn("spec", F.col("raw_text"))
    seen = logs.recent(turns, "3", 3).orderBy(F.desc("created_at"), F.desc("id")).collect()
    after = logs.recent(turns, "3", 5, after=(seen[-1].created_at, seen[-1].id))
    return with_scalars(after.select("id", "title"), logs.chains_of(turns, "3"))


@check("delete_chain", "select id from {fx_turn} where root_turn_id <> '13-0'")
def delete_chain(spark, sf):
    return logs.delete_chain(load(spark, sf, "fx_turn"), "13-1", "3").select("id")


# a turn's conditions are the distinct words of its text; every second one is switched off
define("o_turn_words", "select id, parent_turn_id, list_sort(list_distinct(list_filter(string_split(lower(raw_text), ' '), lambda w: length(w) = 4))) as words from {fx_turn}")


@check("turn_changes", """
select t.id, array_to_string(list_filter(t.words, lambda w: not list_contains(p.words, w)), ' ') as added, array_to_string(list_filter(p.words, lambda w: not list_contains(t.words, w)), ' ') as removed,
  t.words = p.words as same from {o_turn_words} t join {o_turn_words} p on p.id = t.parent_turn_id""")
def turn_changes(spark, sf):
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("raw_text"), " "), lambda w: F.char_length(w) == 4)))
    turns = load(spark, sf, "fx_turn").withColumn("conditions", F.transform(words, lambda w: F.struct(w.alias("key"), (F.char_length(w) % 2 == 0).alias("off"))))
    out = logs.turn_changes(turns)
    return out.select("id", F.array_join("added", " ").alias("added"), F.array_join("removed", " ").alias("removed"), "same")


@check("history", """
select id, greatest(0, total - 4) as skipped from (select id, row_number() over (partition by root_turn_id order by seq) as first, row_number() over (partition by root_turn_id order by seq desc) as last,
  count(*) over (partition by root_turn_id) as total from {fx_turn}) where first = 1 or last <= 3""")
def history(spark, sf):
    return logs.history(load(spark, sf, "fx_turn"), 4).select("id", "skipped")


@check("attempt_status", """
select event_id, case when event_type in ('view', 'purchase') then 'done' when event_type = 'error' or ts < timestamp '2024-01-29 23:59:00' then 'failed' else 'working' end as status from events""")
def attempt_status(spark, sf):
    e = load(spark, sf, "events")
    turns = e.select("event_id", F.when(F.col("event_type") != "view", "a").alias("attempt"), (F.col("event_type") == "purchase").alias("attempt_done"),
                     F.when(F.col("event_type") == "error", "fault").alias("attempt_fault"), F.col("ts").alias("attempt_heartbeat_at"), F.col("ts").alias("attempt_started_at"))
    return turns.select("event_id", logs.attempt_status(datetime(2024, 1, 30)).alias("status"))


@check("task_lanes", """
select id, kind, n, total, case when seconds is null then 'running' when error is not null then 'failed' else 'done' end as outcome from (
  select *, cast(row_number() over (partition by kind order by started_at desc, id desc) as int) as n, count(*) over (partition by kind) as total from {fx_task_run})
where case kind when 'view' then n > 10 and n <= 20 else n <= 10 end""")
def task_lanes(spark, sf):
    return logs.task_lanes(load(spark, sf, "fx_task_run"), {"view": 2}).select("id", "kind", "n", "total", "outcome")


@check("list_audit", """
select a.id, a.user_id, a.action, a.emp_id, p.name as emp_name, a.text from {fx_audit} a left join {fx_person} p on p.emp_id = a.emp_id
where contains(lower(concat('user-', a.user_id)), '77') or contains(a.emp_id, '77') or contains(lower(p.name), '77') or contains(lower(a.text), '77')
order by a.id desc limit 50 offset 50""")
def list_audit(spark, sf):
    events = load(spark, sf, "fx_audit").withColumn("account_id", F.lit(None).cast("string"))
    accounts = events.select("user_id").distinct().select("user_id", F.concat(F.lit("user-"), "user_id").alias("username"), F.lit("").alias("display"))
    rows = logs.list_audit(events, accounts, base.employee(spark, sf), "77", page=2)
    return rows.select("id", "user_id", "action", "emp_id", "emp_name", "text")


@check("audit_activity", """
select user_id, date_trunc('hour', "at") as hour, count(*) as events from {fx_audit} group by 1, 2""")
def audit_activity(spark, sf):
    from ..streaming.jobs import activity
    return activity(load(spark, sf, "fx_audit")).select("user_id", "hour", "events")


# --- evaluation --------------------------------------------------------------------------------------------------------
@check("eval_search", """
with ranked as (select emp_id, row_number() over (order by depth desc, emp_id) as rank from {q_flag_rank}),
cases as (select concat('case-', education_level) as name, emp_id, recruitment = 'BUILDING' as expected from {fx_person} where recruitment in ('BUILDING', 'MACHINERY'))
select name, count(*) filter (expected) as expected, count(*) filter (expected and rank is not null) as found, count(*) filter (not expected and rank is not null) as intruders,
  cast(min(rank) filter (expected) as int) as best_rank, count(*) filter (expected) = count(*) filter (expected and rank is not null) and count(*) filter (not expected and rank is not null) = 0 as ok
from cases left join ranked using (emp_id) group by name""")
def eval_search(spark, sf):
    people = load(spark, sf, "fx_person").filter("recruitment in ('BUILDING', 'MACHINERY')")
    cases = people.select(F.concat(F.lit("case-"), "education_level").alias("name"), "emp_id", (F.col("recruitment") == "BUILDING").alias("expected"))
    ranked = ranked_all(search(spark, sf, FLAGSHIP).ranked).select("emp_id", F.col("rank").cast("int").alias("rank"))
    results = cases.select("name", "emp_id").join(ranked, "emp_id")
    return evals.eval_search(cases, results)


define("o_gold", "select cast(p_partkey as varchar) as name, 0 as item, p_name as word, case when p_size > 25 then '主导' end as depth from part union all select cast(p_partkey as varchar), 1, upper(p_type), '提到' from part")
define("o_items", """
select distinct cast(l_partkey as varchar) as name, concat('　', upper(p_name)) as text, case when l_quantity >= 25 then '主导' else '做过' end as engagement from lineitem join part on p_partkey = l_partkey
union select distinct cast(l_partkey as varchar), concat(p_type, '建设'), null from lineitem join part on p_partkey = l_partkey""")


@check("eval_extract", """
with said as (select name, text, engagement, lower(replace(replace(text, '　', ''), ' ', '')) as w from {o_items}),
want as (select name, item, depth, lower(replace(word, ' ', '')) as w from {o_gold}),
pairs as (select g.*, s.text, s.engagement from want g left join said s on s.name = g.name and s.w = g.w),
item as (select name, item, bool_or(text is not null) as hit, bool_or(depth is not null) as graded, bool_or(coalesce(engagement = depth, false)) as r,
  bool_and(coalesce(abs(case engagement when '主导' then 1 when '做过' then 2 when '提到' then 3 end - case depth when '主导' then 1 when '做过' then 2 when '提到' then 3 end) >= 2, true)) filter (text is not null and depth is not null) as f
  from pairs group by name, item),
recalled as (select name, count(*) as gold, count(*) filter (hit) as hit, count(*) filter (hit and graded) as judged, count(*) filter (hit and graded and r) as "right", count(*) filter (hit and graded and not r and f) as far from item group by name),
written as (select s.name, count(*) as written, count(*) filter (exists (select 1 from want g where g.name = s.name and g.w = s.w)) as fine, count(*) filter (text like '%建设') as action_tails,
  count(*) filter (length(text) > 8) as over_8 from said s group by s.name),
kept as (select k.name, count(*) as keep, count(*) filter (exists (select 1 from said s where s.name = k.name and contains(s.text, k.part))) as kept from (select cast(p_partkey as varchar) as name, upper(split_part(p_name, ' ', 1)) as part from part) k group by k.name),
leaks as (select s.name, count(distinct s.text) as leaks from said s join part p on cast(p.p_partkey as varchar) = s.name where contains(s.text, p.p_type) group by s.name)
select name, coalesce(gold, 0) as gold, coalesce(hit, 0) as hit, coalesce(judged, 0) as judged, coalesce("right", 0) as "right", coalesce(far, 0) as far, coalesce(written, 0) as written, coalesce(fine, 0) as fine,
  coalesce(action_tails, 0) as action_tails, coalesce(over_8, 0) as over_8, coalesce(keep, 0) as keep, coalesce(kept, 0) as kept, coalesce(leaks, 0) as leaks
from recalled full join written using (name) full join kept using (name) full join leaks using (name)""")
def eval_extract(spark, sf):
    part, line = load(spark, sf, "part"), load(spark, sf, "lineitem")
    key = F.col("p_partkey").cast("string").alias("name")
    none = F.lit(None).cast("string")
    gold = part.select(key, F.lit(0).alias("item"), F.col("p_name").alias("word"), F.when(F.col("p_size") > 25, "主导").alias("depth")).unionByName(
        part.select(key, F.lit(1).alias("item"), F.upper("p_type").alias("word"), F.lit("提到").alias("depth")))
    sold = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    items = sold.select(key, F.concat(F.lit("　"), F.upper("p_name")).alias("text"),
                                                     F.when(F.col("l_quantity") >= 25, "主导").otherwise("做过").alias("engagement")).unionByName(
        sold.select(key, F.concat("p_type", F.lit("建设")).alias("text"), none.alias("engagement"))).distinct()
    ok = part.select(key, F.lit("other").alias("word"))
    keep = part.select(key, F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("part"))
    return evals.eval_extract(gold, ok, items, keep, part.select(key, F.col("p_type").alias("part")))


@check("eval_carries", """
select a.word as query, b.word, coalesce(g.ancestor is not null, false) or coalesce(q.canonical, a.word) = b.canonical as carried
from (select word, canonical from {fx_term}) b join (select word as w, split_part(word, ' ', 2) as word from {fx_term} where word like '% %'
  union select word, 'widget' from {fx_term} union select word, canonical from {fx_term}) a on a.w = b.word
  left join {fx_term} q on q.word = a.word left join {o_above} g on g.name = b.canonical and g.ancestor = coalesce(q.canonical, a.word)""")
def eval_carries(spark, sf):
    t = base.terms(spark, sf)
    noun = F.when(F.col("word").contains(" "), F.split_part("word", F.lit(" "), F.lit(2)))
    asked = F.array_distinct(F.array_compact(F.array(noun, F.lit("widget"), F.col("canonical"))))
    return evals.carries(term_closure(t), t, t.select("word", F.explode(asked).alias("query")))


@check("selection_equivalence", """
with s as (select cond, emp_id, coalesce(id, '') as id from {q_selected}),
pairs as (select * from (values (0, 1), (2, 4), (3, 3), (5, 6)) p(a, b))
select a, b, (select count(*) from (select emp_id, id from s where cond = a except select emp_id, id from s where cond = b)) as only_a,
  (select count(*) from (select emp_id, id from s where cond = b except select emp_id, id from s where cond = a)) as only_b,
  (select count(*) from (select emp_id, id from s where cond = a except select emp_id, id from s where cond = b)) + (select count(*) from (select emp_id, id from s where cond = b except select emp_id, id from s where cond = a)) = 0 as same from pairs""")
def selection_equivalence(spark, sf):
    return evals.same_selection(search(spark, sf, BOOSTED).selection(), [(0, 1), (2, 4), (3, 3), (5, 6)])


# --- export and lint -------------------------------------------------------------------------------------------------
@check("export_roster", """
with e as (select f.*, case when f.route = 'skill' then '技能' when f.route = 'role' then '任职记录' when f.route = 'title' then '岗位' else '简历原文' end as label from {q_flag_evidence} f where place = 1),
t as (select e.emp_id, e.cond, concat_ws(' · ', case when route = 'description' then '简历原文' else concat(label, ' ', case route when 'skill' then concat_ws(' · ', engagement, phrase)
    when 'title' then x.title else concat_ws(' · ', x.title, nullif(coalesce(nullif(x.company, ''), x.department), '')) end) end,
  concat(case when segments > 1 then '累计' when e.kind = 'external' then '入职前' else '公司内' end, ' ',
    case when basis_months >= 119.4 then cast(cast(round(basis_months / 12.0) as int) as varchar) else printf('%.1f', round(basis_months / 12.0, 1)) end, ' 年')) as text
  from e join {o_experience} x on x.id = e.id)
select r.rank as "序号", r.emp_id as "工号", p.name as "姓名", p.cur_dept as "部门", a.ring as "worked on rings", a.plate as "worked on plates elsewhere"
from (select emp_id, cast(row_number() over (order by depth desc, emp_id) as int) as rank from {q_flag_page}) r join {cat_person} p on p.emp_id = r.emp_id
  left join (select emp_id, max(text) filter (cond = 0) as ring, max(text) filter (cond = 1) as plate from t group by emp_id) a on a.emp_id = r.emp_id""")
def export_roster_(spark, sf):
    return export_roster(search(spark, sf, FLAGSHIP)).drop("岗位", "职级")


@check("query_lint", """
select c.id, p.problem, p.hard from (values ('ring', 'worked on rings', false), ('nobody', 'works on the moon', true), ('broken', 'a column that is not there', true),
  ('pattern', 'a pattern nobody can read', true), ('words', '词表 of reds', false), ('senior', 'level L1 or above', true)) c(id, label, fine)
join (select 'internal_words' as problem, true as hard union all select 'no_criterion', true union all select 'selects_nobody', false union all select 'does_not_run', true) p on
  (p.problem = 'internal_words' and contains(c.label, '词表')) or (p.problem = 'no_criterion' and not c.fine)
  or (p.problem = 'does_not_run' and c.id in ('broken', 'pattern'))
  or (p.problem = 'selects_nobody' and ((c.id = 'nobody' and not exists (select 1 from {fx_person} where school = 'Moon'))
    or (c.id = 'senior' and not exists (select 1 from {fx_person} where level_rank >= 1))
    or (c.id = 'words' and not exists (select 1 from {o_phrase} where contains(lower(text), 'red')))))""")
def query_lint(spark, sf):
    """A condition per kind of problem, one of them a pattern that cannot be read, and one without any."""
    nobody = Condition("nobody", "works on the moon", "must", "person", where="p.school = 'Moon'")
    broken = Condition("broken", "a column that is not there", "must", "person", where="p.no_such_column = 1")
    pattern = Condition("pattern", "a pattern nobody can read", "boost", "experience", seek=Seek(("(open",), "is about it"))
    words = Condition("words", "词表 of reds", "boost", "experience", seek=Seek.words("red"))
    return lint_query(search(spark, sf, Query((RING, nobody, broken, pattern, words, SENIOR))))


@check("reading_loop", f"""
select 'turn' as root, '{criterion_key(base.CRITERION)}' as criterion_key, content, fits from {{fx_segment_verdict}}
union all select distinct 'turn', '{criterion_key(base.CRITERION)}', r.id, contains(text, 'LARGE') or contains(text, 'PROMO') from {{q_reading}} r join {{q_text}} t on t.id = r.id""")
def reading_loop(spark, sf):
    """What the judge says about the candidates of a search, read round by round until nobody is left open."""
    from ..plans.reading import read_until_done
    t = base.tables(spark, sf)
    texts = reading.segment_text(t["experience"], t["experience_phrase"], t["phrase"])
    return read_until_done(search(spark, sf, Query((WIDGET, NO_ANVIL))), texts, _long_titles)


@check("eval_review", """
with c as (select word, canonical, case when word like '% %' and split_part(word, ' ', 2) <> 'bolt' then split_part(word, ' ', 2) else 'ring' end as query, word not like 'old %' as expected from {fx_term}),
carried as (select c.*, coalesce(g.ancestor is not null, false) or coalesce(q.canonical, c.query) = c.canonical as carried from c left join {fx_term} q on q.word = c.query
  left join {o_above} g on g.name = c.canonical and g.ancestor = coalesce(q.canonical, c.query))
select (select count(*) from carried where expected and not carried) as missed, (select count(*) from carried where not expected and carried) as mixed,
  (select count(*) from {fx_term} where word in ('bolt', 'rod') and not excluded) as kept, (select count(*) from {fx_term} where excluded and word not in ('bolt', 'rod')) as dropped,
  (select count(*) from {fx_term} where length(parent) > 8) as unclickable, (select count(distinct parent) from {fx_term}) as names""")
def eval_review(spark, sf):
    t = base.terms(spark, sf)
    noun = F.split_part("word", F.lit(" "), F.lit(2))
    query = F.when(F.col("word").contains(" ") & (noun != "bolt"), noun).otherwise("ring")
    pairs = t.select("word", query.alias("query"), (~F.col("word").startswith("old ")).alias("expected"))
    carried = evals.carries(term_closure(t), t, pairs.select("query", "word")).join(pairs, ["query", "word"])
    excluded = t.filter(F.col("word").isin("bolt", "rod")).select("word")
    return evals.eval_review(carried, excluded, t, t.select("word"))


@check("condition_functions", """
select o_orderkey, o_totalprice between least(200000, 100000) and greatest(200000, 100000) as between_symmetric, cast(o_orderkey // 7 as bigint) as int_div,
  cast(datediff('day', cast(o_orderdate as date), date '2002-01-01') as int) as days, concat(o_orderstatus, case when o_totalprice > 250000 then o_orderpriority end) as joined,
  cast(nullif(list_position(['F', 'O'], o_orderstatus), 0) as bigint) as place, o_orderstatus is distinct from 'F' as differs, list_has_all(['F', 'O', 'P'], [o_orderstatus]) as contained,
  not list_contains(['F', 'P'], o_orderstatus) as none_of, o_orderdate < timestamp '1999-01-01' and timestamp '1997-01-01' < o_orderdate + interval 30 day as overlaps,
  regexp_matches(lower(o_orderpriority), 'high|low') as named from orders""")
def condition_functions(spark, sf):
    from ..functions import conditions as c
    o, status, day = load(spark, sf, "orders"), F.col("o_orderstatus"), F.col("o_orderdate")
    words = lambda *items: F.array(*[F.lit(i) for i in items])
    return o.select(
        "o_orderkey", c.between_symmetric(F.col("o_totalprice"), F.lit(200000), F.lit(100000)).alias("between_symmetric"),
        c.int_div(F.col("o_orderkey"), F.lit(7)).alias("int_div"), c.days_between(F.lit(AS_OF), day.cast("date")).alias("days"),
        c.concat_present(status, F.when(F.col("o_totalprice") > 250000, F.col("o_orderpriority"))).alias("joined"),
        c.position_or_null(words("F", "O"), status).alias("place"), c.is_distinct(status, F.lit("F")).alias("differs"),
        c.contained_in(F.array(status), words("F", "O", "P")).alias("contained"), c.none_equals(status, words("F", "P")).alias("none_of"),
        c.periods_overlap(day, day + F.expr("interval 30 days"), F.to_timestamp(F.lit("1997-01-01")), F.to_timestamp(F.lit("1999-01-01"))).alias("overlaps"),
        c.regex_ci(F.col("o_orderpriority"), "HIGH|low").alias("named"))


# --- whole tables of cases -------------------------------------------------------------------------------------------
# a case per noun: its words, answers as in `apply_judgments`, more people write "blue x" than "large x"; later nouns have fewer faults
@check("eval_review_cases", """
with w as (select word, split_part(word, ' ', 1) as adj, split_part(word, ' ', 2) as noun from {fx_term} where word like '% %'),
f as (select noun as name, bool_or(adj = 'red') as red, bool_or(adj = 'blue') as blue, bool_or(adj = 'new') as fresh,
  count(*) filter (adj not in ('red', 'blue', 'small', 'new')) as rest, noun < 'h' as early, noun >= 'p' as late from w group by noun),
s as (select name, case when late then 2 else 3 end as found, (not red)::int + (not blue)::int + (not late)::int as missed, case when late then 1 else 2 end as not_found,
  (blue and not late)::int as mixed, case when early then 2 else 1 end as expected, case when early then (not fresh)::int + 1 when late then (not fresh)::int else 1 end as kept,
  (fresh and not early and not late)::int as dropped, red::int as names, (red and length(name) + 5 > 8)::int as unclickable, case when late then 0 else rest end as unanswered from f)
select *, missed + mixed + kept + dropped + unclickable + unanswered = 0 as ok from s""")
def eval_review_cases(spark, sf):
    from .words import NOW, _raw_judgments
    adj, noun = F.split_part("word", F.lit(" "), F.lit(1)), F.split_part("word", F.lit(" "), F.lit(2))
    words = base.terms(spark, sf).filter("word like '% %'").select("word", adj.alias("adj"), noun.alias("name"))
    early, late = F.col("name") < "h", F.col("name") >= "p"
    of = lambda first: F.concat(F.lit(first + " "), "name")
    work = F.concat("name", F.lit(" work"))
    pairs = lambda *two: F.array(*[F.array(a, b) for a, b in two])
    own = words.groupBy("name").agg(F.collect_list(F.struct("word", F.when(F.col("adj") == "blue", 9).otherwise(1).cast("long").alias("people"))).alias("words"))
    cases = own.select(
        "name", "words", F.when(early, F.array(of("new"), of("old"))).when(late, F.array(of("new"))).otherwise(F.array(of("old"))).alias("excluded"),
        F.when(late, pairs((work, of("red")), (of("large"), of("blue")))).otherwise(pairs((work, of("red")), (of("large"), of("blue")), (of("small"), of("red")))).alias("found"),
        F.when(late, pairs((work, of("small")))).otherwise(pairs((work, of("small")), (of("blue"), of("large")))).alias("not_found"))
    asked = F.col("adj").isin("red", "blue", "small", "new") | ~late
    answers = _raw_judgments(spark, sf).join(words, "word").filter(asked).select(
        "name", (F.ascii("word") * 100 + F.length("adj")).alias("at"), "word", "near", "judgment")
    return evals.eval_review_cases(cases, answers, NOW)


# a case per way of recruitment, over the page of the flagship search
@check("eval_rosters", """
with page as (select emp_id, row_number() over (order by depth desc, emp_id) as rank from {q_flag_page}),
r as (select p.recruitment as name, g.emp_id, g.rank, b.months from page g join {fx_person} p on p.emp_id = g.emp_id join {q_flag_basis} b on b.emp_id = g.emp_id and b.cond = 0),
ends as (select e.name, e.a, e.z, x.rank < y.rank as right_way from (select name, min(emp_id) as a, max(emp_id) as z from r group by name having min(emp_id) <> max(emp_id)) e
  join r x on x.emp_id = e.a join r y on y.emp_id = e.z)
select recruitment as name, 'missing' as problem, emp_id as subject from {fx_person} where level_rank >= 3 and emp_id not in (select emp_id from page)
union all select recruitment, 'intruding', emp_id from {fx_person} where school_tier = '985' and emp_id in (select emp_id from page)
union all select name, 'misplaced', case when right_way then concat(z, ' before ', a) else concat(a, ' before ', z) end from ends
union all select distinct recruitment, 'no evidence', 'nobody' from {fx_person}
union all select name, 'other months', concat(emp_id, ' ', months) from r where months <> 12
union all select distinct r.name, 'elsewhere', concat(e.emp_id, ' ', coalesce(nullif(x.company, ''), x.department)) from {q_flag_evidence} e join r on r.emp_id = e.emp_id
  join {o_experience} x on x.id = e.id where not contains(coalesce(nullif(x.company, ''), x.department), 'Supplier')""")
def eval_rosters(spark, sf):
    """Rosters of a table of cases with planted errors of every kind: people, order, months and places of the evidence."""
    found = search(spark, sf, FLAGSHIP)
    people = load(spark, sf, "fx_person")
    way = people.select("emp_id", F.col("recruitment").alias("name"))
    rosters = found.roster().select("emp_id", "rank", F.col("basis")[0]["months"].alias("months")).join(way, "emp_id")
    evidence = found.evidence().select("emp_id", "company", "department").join(way, "emp_id")
    ends = rosters.groupBy("name").agg(F.min("emp_id").alias("a"), F.max("emp_id").alias("z"), F.collect_list("emp_id").alias("listed"))
    wanted = people.groupBy(F.col("recruitment").alias("name")).agg(
        F.collect_list(F.when(F.col("level_rank") >= 3, F.col("emp_id"))).alias("includes"), F.collect_list(F.when(F.col("school_tier") == "985", F.col("emp_id"))).alias("excludes"))
    shape = lambda who, months, place: F.struct(who.alias("emp_id"), F.lit(months).cast("long").alias("months"), F.lit(place).alias("place"))
    none = F.array().cast("array<array<string>>")
    two = F.when(F.col("a") != F.col("z"), F.array(F.array("a", "z"), F.array("z", "a"))).otherwise(none)
    listed = F.coalesce("listed", F.array().cast("array<string>"))
    cases = wanted.join(ends, "name", "left").select(
        "name", "includes", "excludes", F.coalesce(two, none).alias("before"),
        F.concat(F.transform(listed, lambda who: shape(who, 12, "Supplier")), F.array(shape(F.lit("nobody"), 12, None))).alias("evidence"))
    return evals.roster_problems(cases, rosters, evidence)
