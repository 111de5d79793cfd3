"""Cleaning, segments, companies, reconciling and deriving over the projected tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import duration_months, parse_date
from ..functions.text import org_path, tag, words_in
from ..operators import clean, companies as company_ops, corpus as corpus_ops, derive, segments as segment_ops
from ..operators.trees import closure, depths
from ..plans import sync as sync_plan
from ..session import literal_table
from ..sources.contract import flag_state, parse_flag
from . import base
from .inputs import AS_OF, define, load
from .registry import check

# --- text and dates ------------------------------------------------------------------------------
# every third spelling of a date is one the parser has to refuse or to clean
RAW_DATE = """case o_orderpriority when '1-URGENT' then strftime(o_orderdate, '%Y/%m/%d')
  when '2-HIGH' then concat('　', strftime(o_orderdate, '%Y-%m-%d'), ' 00:00:00 ') when '3-MEDIUM' then ''
  when '4-NOT SPECIFIED' then concat(cast(year(o_orderdate) as varchar), '-02-', cast(10 + month(o_orderdate) * 2 as varchar))
  else concat(cast(year(o_orderdate) as varchar), '-', cast(month(o_orderdate) as varchar), '-01') end"""


@check("parse_date", f"""
select o_orderkey, case when o_orderpriority = '3-MEDIUM' then 'absent'
    when o_orderpriority = '5-LOW' and month(o_orderdate) < 10 then 'invalid'
    when o_orderpriority = '4-NOT SPECIFIED' and try_cast(raw as date) is null then 'invalid' else 'value' end as state,
  case when o_orderpriority in ('1-URGENT', '2-HIGH') then cast(o_orderdate as date)
    when o_orderpriority = '4-NOT SPECIFIED' then try_cast(raw as date)
    when o_orderpriority = '5-LOW' and month(o_orderdate) >= 10 then try_cast(raw as date) end as value
from (select *, {RAW_DATE} as raw from orders)""")
def parse_date_(spark, sf):
    o = load(spark, sf, "orders")
    year, month = F.year("o_orderdate").cast("string"), F.month("o_orderdate")
    raw = (F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format("o_orderdate", "yyyy/MM/dd"))
           .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("　"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 00:00:00 ")))
           .when(F.col("o_orderpriority") == "3-MEDIUM", "")
           .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(year, F.lit("-02-"), (month * 2 + 10).cast("string")))
           .otherwise(F.concat(year, F.lit("-"), month.cast("string"), F.lit("-01"))))
    return o.select("o_orderkey", parse_date(raw).alias("d")).select("o_orderkey", "d.state", "d.value")


@check("parse_flag", """
select c_custkey, case c_mktsegment when 'BUILDING' then 'true' when 'FURNITURE' then 'false' when 'HOUSEHOLD' then 'blank' when 'MACHINERY' then 'true' else 'invalid' end as state,
  case when c_mktsegment in ('BUILDING', 'MACHINERY') then true when c_mktsegment = 'FURNITURE' then false end as value from customer""")
def parse_flag_(spark, sf):
    c = load(spark, sf, "customer")
    # fixed values: one spelling per segment
    spelled = F.create_map(*[F.lit(x) for x in ("BUILDING", " YES ", "FURNITURE", "否", "HOUSEHOLD", "  ", "MACHINERY", "1", "AUTOMOBILE", "maybe")])
    raw = F.element_at(spelled, F.col("c_mktsegment"))
    return c.select("c_custkey", flag_state(raw).alias("state"), parse_flag(raw).alias("value"))


@check("reject_report", """
select reason as reject_reason, count(*) as rows from (select case when start_date > date '2000-06-30' then 'start_in_future'
  when end_date > date '2000-06-30' then 'end_in_future' when end_date < start_date then 'inverted' end as reason from {fx_raw_interval})
where reason is not null group by reason""")
def reject_report(spark, sf):
    from datetime import date
    raw = load(spark, sf, "fx_raw_interval")
    blank = [F.lit("").alias(c) for c in ("department", "department_path", "title", "level", "seq_l1", "seq_l2", "seq_l3", "segment_key")]
    rows = raw.select("emp_id", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"), *blank)
    return clean.clean_internal(rows, date(2000, 6, 30))[1]


@check("clean_external", """
select reason, count(*) as rows, cast(sum(months) as bigint) as months from (select *, case when end_date is null and hire is null then 'no_end_and_no_hire_date'
    when coalesce(end_date, hire) < start_date then 'inverted' when start_date > date '2002-01-01' then 'start_in_future'
    when coalesce(end_date, hire) > date '2002-01-01' then 'end_in_future' when coalesce(end_date, hire) > hire then 'end_after_hire' else 'kept' end as reason,
  greatest(1, cast(round((datediff('day', start_date, coalesce(end_date, hire)) + 1) / 30.44) as int)) as months
  from (select s.emp_id, s.start_date, s.end_date, h.hire from {fx_segment} s left join
    (select cast(o_custkey as varchar) as emp_id, cast(max(o_orderdate) as date) as hire from orders where o_orderstatus = 'F' group by 1) h on h.emp_id = s.emp_id
    where kind = 'external')) group by reason""")
def clean_external(spark, sf):
    s = load(spark, sf, "fx_segment").filter("kind = 'external'")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    hires = (load(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").cast("string").alias("emp_id"))
             .agg(F.max("o_orderdate").cast("date").alias("hire_date")))
    rows = s.select("emp_id", text("start_date"), text("end_date"), "company", "title", "description", "company_tag", F.lit("").alias("nature"), "unemployed")
    marked = clean.mark_external(rows, hires, AS_OF)
    return marked.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("rows"), F.sum("months").alias("months"))


@check("duration_months", """
select segment_id, cast(greatest(1, round((datediff('day', least(start_date, end_date), greatest(start_date, end_date)) + 1) / 30.44)) as int) as months from {fx_raw_interval}""")
def duration_months_(spark, sf):
    r = load(spark, sf, "fx_raw_interval")
    return r.select("segment_id", duration_months(F.least("start_date", "end_date"), F.greatest("start_date", "end_date")).alias("months"))


@check("org_path", """
select distinct user_id, array_to_string(list_filter(list_transform(string_split(org_path, '>'), lambda x: trim(x)), lambda x: x <> ''), '>') as path from {fx_scope}""")
def org_path_(spark, sf):
    return load(spark, sf, "fx_scope").select("user_id", org_path(F.col("org_path")).alias("path")).distinct()


@check("tag_words", """
select page_id, regexp_replace(regexp_replace(regexp_replace(nfkc, '[\\s　]+', ' ', 'g'), '^[ ·,，;；]+', ''), '[ ·,，;；]+$', '') as tag
from (select page_id, replace(replace(url, 'http://', '　;'), '/', ' ·  ') as nfkc from pages)""")
def tag_words(spark, sf):
    raw = F.replace(F.replace(F.col("url"), F.lit("http://"), F.lit("　;")), F.lit("/"), F.lit(" ·  "))
    return load(spark, sf, "pages").select("page_id", tag(raw).alias("tag"))


# fixed values: words to look for and a phrase in which they are allowed
BANNED, ALLOWED = ("the", "les", "ation", "http"), ("the the",)


@check("banned_words", """
select doc_id, array_to_string(list_filter(['the', 'les', 'ation', 'http'], lambda w: contains(replace(text, 'the the', ''), w)), ',') as words from documents
where len(list_filter(['the', 'les', 'ation', 'http'], lambda w: contains(replace(text, 'the the', ''), w))) > 0""")
def banned_words(spark, sf):
    found = words_in(F.col("text"), BANNED, ALLOWED)
    return load(spark, sf, "documents").withColumn("_w", found).filter(F.size("_w") > 0).select("doc_id", F.array_join("_w", ",").alias("words"))


# --- profiles, bands, records --------------------------------------------------------------------------
@check("profile_conflicts", """
select user_id as emp_id, count(*) as rows from (select distinct cast(user_id as varchar) as user_id, event_type from events) group by 1 having count(*) > 1""")
def profile_conflicts(spark, sf):
    rows = load(spark, sf, "events").select(F.col("user_id").cast("string").alias("emp_id"), "event_type")
    return clean.unique_profiles(rows)[1]


@check("clean_profiles", """
select emp_id, name, cast(null as date) as hire_date, case when education_rank < 5 then education_level else '' end as education_level, school from {fx_person}""")
def clean_profiles(spark, sf):
    p = load(spark, sf, "fx_person")
    raw = p.select(F.concat(F.lit(" "), "emp_id").alias("emp_id"), F.concat("name", F.lit("　")).alias("name"), F.lit("2024-13-01").alias("hire_date"),
                   F.when(F.col("education_rank") < 5, F.col("education_level")).otherwise("研究员").alias("education_level"), "school", "school_tier",
                   "overseas_educated", "recruitment")
    return clean.clean_profiles(raw)[0].select("emp_id", "name", "hire_date", "education_level", "school")


@check("population_semi", "select segment_id from {fx_raw_interval} where emp_id in (select emp_id from {fx_person} where recruitment = 'BUILDING')")
def population_semi(spark, sf):
    people = load(spark, sf, "fx_person").filter("recruitment = 'BUILDING'")
    return clean.in_population(load(spark, sf, "fx_raw_interval"), people).select("segment_id")


@check("level_bands", """
select (select count(*) from {fx_person} where level_rank is null) as incomplete,
  (select count(*) from (select level_band from {fx_person} group by 1 having count(distinct level_rank) > 1)) as level_in_two_bands,
  (select count(*) from (select recruitment from {fx_person} group by 1 having count(distinct level_rank) > 1)) as band_with_two_heights""")
def level_bands(spark, sf):
    p = load(spark, sf, "fx_person")
    return clean.level_problems(clean.shaped_levels(p.select(
        F.concat("level_band", F.lit(" ")).alias("level"), F.col("recruitment").alias("band"), F.col("level_rank").cast("string").alias("rank"))
        .withColumn("band", F.col("level")).unionByName(p.select(
            F.concat(F.lit("x"), "level_band", "recruitment").alias("level"), F.col("recruitment").alias("band"), F.col("level_rank").cast("string").alias("rank")))))


@check("scale_union", "select stream, value, cast(rank as int) as rank from {o_scale}")
def scale_union(spark, sf):
    return base.scale(spark, sf)


@check("mark_records", """
select reason, count(*) as rows from (select case when value in ('click', 'error') then 'unknown_stream' when day > 28 then 'invalid_date' when value = 'purchase' and amount > 60 then 'rating_without_end'
    when value = 'purchase' and amount < 10 then 'rating_off_scale' when ends < starts then 'inverted' else 'kept' end as reason
  from (select event_type as value, day(ts) as day, value as amount, cast(ts as date) as starts, case when value > 60 then null else cast(ts as date) + 10 end as ends from events)) group by reason""")
def mark_records(spark, sf):
    e = load(spark, sf, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    stream = F.when(F.col("event_type") == "purchase", "perf").when(F.col("event_type").isin("view", "signup"), "pool").otherwise(F.col("event_type"))
    rows = e.select(
        F.col("user_id").cast("string").alias("emp_id"), stream.alias("stream"), day.alias("period_start"),
        F.when(F.col("value") > 60, "").otherwise(F.date_add(F.col("ts").cast("date"), 10).cast("string")).alias("period_end"),
        F.when(F.col("value") < 10, "off").otherwise("1-URGENT").alias("value"),
        F.when(F.dayofmonth("ts") > 28, "2024-02-30").otherwise(day).alias("recorded_at"))
    marked = clean.mark_records(rows, base.streams(spark), base.scale(spark, sf), __import__("datetime").date(2025, 1, 1))
    return marked.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("rows"))


@check("dedup_revisions", "select emp_id, stream, period_start, period_end, value from {o_record}")
def dedup_revisions(spark, sf):
    return base.records(spark, sf)


@check("revision_report", """
select (select count(*) from (select emp_id, stream, period_start from {o_distinct_record} group by 1, 2, 3 having count(*) > 1)) as revised,
  (select count(distinct (emp_id, stream, period_start)) from {o_final_record} where tied > 1) as ambiguous""")
def revision_report(spark, sf):
    perf = load(spark, sf, "fx_record").select("emp_id", "stream", "period_start", "period_end", "value", "recorded_at")
    pool = load(spark, sf, "fx_status").select("emp_id", "stream", F.col("valid_from").alias("period_start"), F.col("valid_to").alias("period_end"),
                                               "value", F.col("valid_from").alias("recorded_at"))
    return clean.dedup_revisions(perf.unionByName(pool))[1]


@check("current_position", """
select p.emp_id, coalesce(case when o.n = 1 then o.department end, '') as cur_dept, coalesce(case when o.n = 1 then o.title end, '') as cur_title, coalesce(o.n, 0) > 1 as position_conflict
from {fx_person} p left join (select emp_id, count(*) as n, min(company) as department, min(title) as title from {fx_segment} where end_date is null group by emp_id) o on o.emp_id = p.emp_id""")
def current_position(spark, sf):
    p = load(spark, sf, "fx_person")
    profiles = p.select("emp_id", "name", F.lit(None).cast("date").alias("hire_date"), "education_level", "school", "school_tier", "overseas_educated", "recruitment")
    s = load(spark, sf, "fx_segment").select("emp_id", F.col("company").alias("department"), "department_path", "title", "seq_l1", "seq_l2",
                                             F.lit("").alias("seq_l3"), F.lit("").alias("level"), "end_date")
    bands = p.select(F.col("level_band").alias("level"), F.col("level_band").alias("band"), F.col("level_rank").alias("rank")).distinct()
    return clean.build_employee(profiles, s, bands).select("emp_id", "cur_dept", "cur_title", "position_conflict")


# --- segments -------------------------------------------------------------------------------------------------
define("o_merge_rows", """
select emp_id, title, start_date, end_date, coalesce(end_date, date '2002-01-01') as stop, row_number() over () as rn
from (select emp_id, title, start_date, end_date from {fx_segment})""")
define("o_merge_flag", """
select *, case when start_date > max(stop) over (partition by emp_id, title order by start_date, stop, rn rows between unbounded preceding and 1 preceding) + 1 then 1 else 0 end as fresh
from {o_merge_rows}""")
define("o_merge_island", "select *, sum(fresh) over (partition by emp_id, title order by start_date, stop, rn rows unbounded preceding) as island from {o_merge_flag}")


@check("merge_adjacent", """
select emp_id, title, min(start_date) as start_date, case when count(*) filter (end_date is null) > 0 then null else max(end_date) end as end_date,
  count(*) as rows, cast(greatest(1, round((datediff('day', min(start_date), max(stop)) + 1) / 30.44)) as int) as months
from {o_merge_island} group by emp_id, title, island""")
def merge_adjacent(spark, sf):
    s = load(spark, sf, "fx_segment")
    rows = s.select("emp_id", F.col("title").alias("segment_key"), "title", "start_date", "end_date", *[
        F.lit("").alias(c) for c in ("department", "department_path", "level", "seq_l1", "seq_l2", "seq_l3")])
    return segment_ops.merge_adjacent(rows, AS_OF).select("emp_id", "title", "start_date", "end_date", "rows", "months")


@check("merge_report", """
select (select count(distinct (emp_id, title, island)) from {o_merge_island}) + (select count(*) from {fx_segment} where title like 'S%') as segments,
  (select count(*) from {fx_segment} where title not like 'S%') - (select count(distinct (emp_id, title, island)) from {o_merge_island}) as merged_rows,
  (select count(*) from {fx_segment} where title like 'S%') as without_key""".replace("from {o_merge_island}", "from {o_merge_island} where title not like 'S%'"))
def merge_report(spark, sf):
    s = load(spark, sf, "fx_segment")
    key = F.when(F.col("title").startswith("S"), "").otherwise(F.col("title"))
    rows = s.select("emp_id", key.alias("segment_key"), "title", "start_date", "end_date", *[
        F.lit("").alias(c) for c in ("department", "department_path", "level", "seq_l1", "seq_l2", "seq_l3")])
    return segment_ops.merge_report(segment_ops.merge_adjacent(rows, AS_OF))


@check("content_key", """
select id, md5(concat_ws(chr(31), emp_id, kind, case when unemployed then 'true' else 'false' end, cast(datediff('day', date '1970-01-01', start_date) as varchar),
  coalesce(cast(datediff('day', date '1970-01-01', end_date) as varchar), ''), company, department, department_path,
  case when company_tag <> '' then concat('{"company_tag":"', company_tag, '"}') else '' end, title, seq_l1, seq_l2, '', '', description)) as content_key from {fx_segment}""".replace('{"', '{{"').replace('{{"', '{"'))
def content_key(spark, sf):
    return segment_ops.content_key(base.experience(spark, sf)).select("id", "content_key")


@check("sync_report", """
select kind, count(*) as segments, count(*) filter (unemployed) as unemployed, count(distinct emp_id) as people from {fx_segment} group by kind""")
def sync_report(spark, sf):
    return base.experience(spark, sf).groupBy("kind").agg(
        F.count("*").alias("segments"), F.count_if("unemployed").alias("unemployed"), F.count_distinct("emp_id").alias("people"))


# what the steps of a sync leave, in SQL: profiles, rows of the population with the first rule they break
LADDER = "('高中及以下', '大专', '本科', '硕士', '博士')"
define("o_profile", f"""
select trim(emp_id) as emp_id, name, case hire_date when '1996-06-01' then date '1996-06-01' end as hire_date, hire_date = 'soon' as unreadable,
  case when trim(education_level) in {LADDER} then trim(education_level) else '' end as education_level,
  case when trim(education_level) not in {LADDER} then trim(education_level) end as off, school, school_tier, overseas_educated, recruitment
from {{fx_raw_profile}}""")
define("o_distinct_profile", """
select distinct emp_id, name, hire_date, education_level, school, school_tier, overseas_educated, recruitment from {o_profile} where emp_id <> ''""")
define("o_population", "select emp_id, max(hire_date) as hire_date from {o_distinct_profile} group by emp_id having count(*) = 1")
define("o_sync_row", """
select s.*, 'L' || cast(cast(quantity as int) % 6 as varchar) as level, case when kind = 'internal' then end_date else coalesce(end_date, hire_date) end as closed,
  case when kind = 'internal' then case when start_date > date '1997-01-01' then 'start_in_future' when end_date > date '1997-01-01' then 'end_in_future' end
    when coalesce(end_date, hire_date) is null then 'no_end_and_no_hire_date' when coalesce(end_date, hire_date) < start_date then 'inverted'
    when start_date > date '1997-01-01' then 'start_in_future' when coalesce(end_date, hire_date) > date '1997-01-01' then 'end_in_future'
    when coalesce(end_date, hire_date) > hire_date then 'end_after_hire' end as reason
from {fx_segment} s join {o_population} p on p.emp_id = s.emp_id""")
define("o_sync_segment", """
select emp_id, kind, unemployed, start_date, closed, company, department, department_path, company_tag, title, case when kind = 'internal' then seq_l1 else '' end as seq,
  case when kind = 'internal' then level else '' end as level, case when kind = 'external' and not unemployed then description else '' end as description, count(*) as n
from {o_sync_row} where reason is null group by all""")
define("o_sync_open", """
select p.emp_id, count(*) filter (s.kind = 'internal' and s.closed is null and s.emp_id is not null) as open,
  max(s.level) filter (s.kind = 'internal' and s.closed is null) as level
from {o_population} p left join {o_sync_row} s on s.emp_id = p.emp_id and s.reason is null group by p.emp_id""")


@check("sync_build_report", """
with lines as (
  select 'employees' as "table", 'missing_emp_id' as what, null as value, count(*) as rows from {o_profile} where emp_id = ''
  union all select 'employees', 'hire_date_unreadable', null, count(*) from {o_profile} where unreadable
  union all select 'employees', 'education_off_ladder', off, count(*) from {o_profile} where off is not null group by off
  union all select 'employees', 'repeated_rows', null, (select count(*) from {o_profile} where emp_id <> '') - (select count(*) from {o_distinct_profile})
  union all select 'employees', 'conflicting_people', null, count(*) from (select emp_id from {o_distinct_profile} group by 1 having count(*) > 1)
  union all select 'employees', 'population', null, count(*) from {o_population}
  union all select case kind when 'internal' then 'assignments' else 'external' end, 'not_in_population', null, count(*) from {fx_segment}
    where emp_id not in (select emp_id from {o_population}) group by kind
  union all select case kind when 'internal' then 'assignments' else 'external' end, reason, null, count(*) from {o_sync_row} where reason is not null group by kind, reason
  union all select 'assignments', what, null, count(*) from {o_sync_row}, (values ('segments'), ('without_key')) w(what) where kind = 'internal' and reason is null group by what
  union all select 'employees', 'position_conflicts', null, count(*) from {o_sync_open} where open > 1
  union all select 'employees', 'people_without_path', null, count(*) from {o_sync_open} where open <> 1
  union all select 'employees', 'levels_without_band', null, count(*) from {o_sync_open} where open = 1 and level > 'L3'
  union all select 'employees', 'level_without_band', level, count(*) from {o_sync_open} where open = 1 and level > 'L3' group by level
  union all select 'experience', 'repeated_segments', null, cast(sum(n - 1) as bigint) from {o_sync_segment}
  union all select 'external', 'segments', null, count(*) from {o_sync_segment} where kind = 'external'
  union all select 'external', 'unemployed', null, count(*) from {o_sync_segment} where unemployed
  union all select 'companies', what, null, count(*) from {o_sync_segment}, (values ('segments'), ('resolved'), ('labelled')) w(what)
    where kind = 'external' and not unemployed and company <> '' group by what)
select * from lines where rows > 0""")
def sync_build_report(spark, sf):
    """The report of a sync over a source with every kind of fault in its profiles and segments."""
    from datetime import date
    return sync_plan.build(sync_bundle(spark, sf), date(1997, 1, 1))[1]


def sync_bundle(spark, sf) -> dict:
    """The driver's tables as a source: raw profiles, segments of both kinds, companies with their industries."""
    s, c = load(spark, sf, "fx_segment"), load(spark, sf, "fx_company")
    blank = lambda *names: [F.lit("").alias(name) for name in names]
    day = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    none = lambda *names: s.limit(0).select(*blank(*names))
    level = F.concat(F.lit("L"), (F.col("quantity").cast("int") % 6).cast("string")).alias("level")
    levels = literal_table(spark, [(f"L{n}", f"band {n}", str(n)) for n in range(4)], "level string, band string, rank string")
    return {
        "employees": load(spark, sf, "fx_raw_profile"), "levels": levels,
        "assignments": s.filter("kind = 'internal'").select("emp_id", day("start_date"), day("end_date"), "department", "department_path", "title", level,
                                                            "seq_l1", *blank("seq_l2", "seq_l3", "segment_key")),
        "external": s.filter("kind = 'external'").select("emp_id", day("start_date"), day("end_date"), "company", "title", "description", "company_tag",
                                                         *blank("nature"), "unemployed"),
        "industries": load(spark, sf, "fx_industry"), "companies": c.select("name", "group_name"),
        "company_industries": c.select(F.col("name").alias("company"), "industry", "main"), "company_circles": none("company", "circle"),
        "company_aliases": none("raw_name", "company"), "streams": none("stream", "kind", "label", "period", "notes"),
        "scales": none("stream", "value", "rank"), "records": none("emp_id", "stream", "period_start", "period_end", "value", "recorded_at")}


# --- companies --------------------------------------------------------------------------------------------------
@check("tree_closure", """
select name, name as ancestor, 0 as depth from {fx_industry} union all select name, parent, 1 from {fx_industry} where parent is not null""")
def tree_closure(spark, sf):
    return closure(load(spark, sf, "fx_industry"))


@check("alias_resolution", "select company, resolved from {o_spelling}")
def alias_resolution(spark, sf):
    worked = company_ops.employed_outside(base.experience(spark, sf))
    return company_ops.resolve_spellings(worked, load(spark, sf, "fx_company_alias"), load(spark, sf, "fx_company"))


@check("company_arrays", """
select name, group_name, array_to_string(industries, ',') as industries, array_to_string(main_industries, ',') as main_industries, array_to_string(circles, ',') as circles from {o_company}""")
def company_arrays(spark, sf):
    text = lambda c: F.array_join(c, ",").alias(c)
    return base.companies(spark, sf)[1].select("name", "group_name", text("industries"), text("main_industries"), text("circles"))


@check("leaf_industries", """
select c.name, i.m as industry from (select name, main_industries, unnest(main_industries) as m from {o_company}) i join {o_company} c on c.name = i.name
where not exists (select 1 from {fx_industry} f where f.parent = i.m and list_contains(i.main_industries, f.name))""")
def leaf_industries(spark, sf):
    return company_ops.leaf_industries(base.companies(spark, sf)[1], load(spark, sf, "fx_industry"))


@check("resolution_report", """
select count(*) as segments, count(s.resolved) as resolved, count(*) filter (c.main) as labelled,
  (select count(*) from (select lower(trim(raw_name)) from {fx_company_alias} group by 1 having count(distinct company) > 1)) as ambiguous_aliases
from {o_worked} w join {o_spelling} s on s.company = w.company left join {fx_company} c on c.name = s.resolved""")
def resolution_report(spark, sf):
    labelled = load(spark, sf, "fx_company").filter("main").select("name")
    return company_ops.resolution_report(base.experience(spark, sf), load(spark, sf, "fx_company_alias"), load(spark, sf, "fx_company"), labelled)


@check("unresolved_spellings", """
select w.company, count(distinct emp_id) as people from {o_worked} w join {o_spelling} s on s.company = w.company where s.resolved is null
group by w.company order by people desc, w.company limit 30""")
def unresolved_spellings(spark, sf):
    return company_ops.unresolved_spellings(base.experience(spark, sf), load(spark, sf, "fx_company_alias"), load(spark, sf, "fx_company"))


# --- reconcile and constraints ---------------------------------------------------------------------------------------
# the stored side holds what shipped before 2001, the new side what was ordered after 1996
@check("reconcile_counts", """
select count(*) filter (n.segment_id is null) as gone, count(*) filter (o.segment_id is not null and n.segment_id is not null) as same, count(*) filter (o.segment_id is null) as added
from (select distinct segment_id from {fx_raw_interval} where end_date < date '2001-01-01') o
full join (select distinct segment_id from {fx_raw_interval} where start_date >= date '1997-01-01') n on n.segment_id = o.segment_id""")
def reconcile_counts(spark, sf):
    r = load(spark, sf, "fx_raw_interval")
    return corpus_ops.reconcile_counts(r.filter("end_date < date '2001-01-01'"), r.filter("start_date >= date '1997-01-01'"), "segment_id")


@check("reconcile", """
select s.id, case when s.start_date < date '1999-01-01' then s.derived_identity end as derived_identity, case when s.start_date < date '1999-01-01' then s.seq_inferred_l1 else '' end as seq_inferred_l1
from {fx_segment} s where end_date is not null""")
def reconcile(spark, sf):
    e = base.experience(spark, sf)
    identity = load(spark, sf, "fx_segment").select("id", F.col("derived_identity").alias("_d"))
    stored = e.join(identity, "id").withColumn("derived_identity", F.col("_d")).drop("_d").filter("start_date < date '1999-01-01'")
    staged = e.filter("end_date is not null").withColumn("seq_inferred_l1", F.lit(""))
    return corpus_ops.reconcile_experience(stored, staged).select("id", "derived_identity", "seq_inferred_l1")


@check("constraint_audit", """
select 'experience' as "table", 'kind_valid' as "constraint", cast(0 as bigint) as violations
union all select 'experience', 'place_by_kind', 0 union all select 'experience', 'unemployed_external', 0 union all select 'experience', 'months_positive', 0
union all select 'experience', 'unanswered_derived', 0 union all select 'experience', 'dates_ordered', (select count(*) from {fx_raw_interval} where end_date < start_date)
union all select 'experience', 'key', (select count(*) from (select segment_id from {fx_raw_interval} group by 1 having count(*) > 1))
union all select 'experience', 'emp_id in employee', (select count(*) from {fx_raw_interval} r where emp_id not in (select emp_id from {fx_person} where level_rank > 0))
union all select 'employee', 'level_band_ranked', 0 union all select 'employee', 'education_ranked', 0 union all select 'employee', 'key', 0
union all select 'term', 'parent_on_canonical', (select count(*) from {fx_term} where parent is not null and (canonical <> word or parent = word))
union all select 'term', 'excluded_alone', 0 union all select 'term', 'key', 0 union all select 'term', 'parent in term', 0""")
def constraint_audit(spark, sf):
    e = base.experience(spark, sf)
    raw = load(spark, sf, "fx_raw_interval").select(F.col("segment_id").alias("id"), F.col("start_date").alias("_s"), F.col("end_date").alias("_e"))
    e = e.join(raw, "id").withColumn("start_date", F.col("_s")).withColumn("end_date", F.col("_e"))
    return corpus_ops.check_constraints({"experience": e, "employee": base.employee(spark, sf).filter("cur_level_rank > 0"), "term": base.terms(spark, sf)})


# --- derive -------------------------------------------------------------------------------------------------------------
@check("phrase_plan", "select experience_id, route, text, engagement from {o_link}")
def phrase_plan(spark, sf):
    return base.links(spark, sf)


@check("phrase_dictionary", "select id, text from {o_phrase}")
def phrase_dictionary(spark, sf):
    return base.dictionary(spark, sf)[0]


@check("phrase_edges", "select experience_id, route, phrase_id, engagement from {o_edge}")
def phrase_edges(spark, sf):
    return base.dictionary(spark, sf)[1]


@check("prune_phrases", "select id, text from {o_phrase} where id in (select phrase_id from {o_edge} where route = 'title' or engagement = '主导')")
def prune_phrases(spark, sf):
    phrase, edges = base.dictionary(spark, sf)
    return derive.prune_phrases(phrase, edges.filter("route = 'title'"), edges.filter("engagement = '主导'"))


def _derived(spark, sf, segments=None):
    identity = (load(spark, sf, "fx_segment") if segments is None else segments).select("id", F.col("derived_identity").alias("_d"))
    return base.experience(spark, sf, segments).join(identity, "id").withColumn("derived_identity", F.col("_d")).drop("_d")


def _staged(spark, sf):
    s = load(spark, sf, "fx_segment").filter("quantity > 25 and derived_identity is distinct from 'v2'")
    return s.select(F.col("id").alias("experience_id"), F.lit("v2").alias("derived_identity"), F.lit("s1").alias("seq_inferred_l1"),
                    F.lit("s2").alias("seq_inferred_l2"), (F.col("discount") > 0.05).alias("unanswered"))


@check("underived", "select id from {fx_segment} where derived_identity is distinct from 'v2' and quantity <= 25")
def underived(spark, sf):
    return derive.underived(_derived(spark, sf), _staged(spark, sf), "v2").select("id")


@check("derive_progress", """
select count(*) as total, count(*) filter (derived_identity = 'v2' or quantity > 25) as done, bool_or(derived_identity <> 'v2') as staging from {fx_segment}""")
def derive_progress(spark, sf):
    return derive.derive_progress(_derived(spark, sf), _staged(spark, sf), "v2")


@check("promote", """
select id, case when derived_identity is distinct from 'v2' and quantity > 25 then 'v2' else derived_identity end as derived_identity,
  case when derived_identity is distinct from 'v2' and quantity > 25 then discount > 0.05 else false end as unanswered from {fx_segment}""")
def promote(spark, sf):
    return derive.promote_columns(_derived(spark, sf), _staged(spark, sf), "v2").select("id", "derived_identity", "unanswered")


@check("promote_edges", """
select experience_id, route, phrase_id, engagement from {o_edge} e join {fx_segment} s on s.id = e.experience_id
where (s.derived_identity = 'v2') or (s.derived_identity is distinct from 'v2' and route = 'skill')""")
def promote_edges(spark, sf):
    t = base.tables(spark, sf)  # segments and edges lie by segment there: neither side is made or dealt again
    edges = t["experience_phrase"]
    return derive.promote_edges(edges, edges.filter("route = 'skill'"), _derived(spark, sf, t["segment"]), "v2")


@check("seq_tree", "select distinct seq_l1, seq_l2 from {fx_segment} where kind = 'internal'")
def seq_tree(spark, sf):
    return derive.seq_tree(base.experience(spark, sf))


# answers built from a segment: a word twice with two depths, one word that holds the company name, one too long
@check("conform_extractions", """
select id as experience_id, concat_ws('|', concat(word, '=', case when quantity >= 25 then '主导' else '做过' end), case when company = '' then 'x=主导' end, concat(split_part(word, ' ', 1), '=?')) as items
from {fx_segment}""")
def conform_extractions(spark, sf):
    s = load(spark, sf, "fx_segment")
    item = lambda text, depth: F.struct(text.alias("text"), depth.alias("depth"))
    items = F.array(item(F.concat(F.lit("　"), "word", F.lit("；")), F.lit("做过")), item(F.concat("company", F.lit("x")), F.lit("主导")),
                    item(F.lit("a word that is much too long"), F.lit("主导")),
                    item(F.col("word"), F.when(F.col("quantity") >= 25, "主导").otherwise("提到")),
                    item(F.split_part("word", F.lit(" "), F.lit(1)), F.lit("other")), item(F.lit(" "), F.lit("主导")))
    told = F.to_json(F.struct(items.alias("items")))
    # items that are none, or whose text is none, are dropped alone; an answer that is no object at all gives no row
    told = F.replace(told, F.lit('{"items":['), F.lit('{"items":[5,null,{"text":{}},{"text":7,"depth":"主导"},[1],"bare",'))
    useless = [(F.concat(F.lit(name), "id"), F.lit(text)) for name, text in (("x", "{"), ("y", "[1]"), ("z", "7"))]
    every = [F.struct(name.alias("experience_id"), "company", answer.alias("answer")) for name, answer in [(F.col("id"), told), *useless]]
    answers = s.select(F.inline(F.array(*every)))  # the segments are made once
    out = derive.conform_extractions(answers)
    return out.select("experience_id", F.array_join(F.transform("items", lambda i: F.concat(
        i["text"], F.lit("="), F.coalesce(i["engagement"], F.lit("?")))), "|").alias("items"))


@check("conform_alignments", """
select id as experience_id, case when quantity < 10 then '' when quantity < 40 then split_part(word, ' ', 1) end as seq_l1,
  case when quantity < 10 then '' when quantity < 40 then split_part(word, ' ', 2) end as seq_l2 from {fx_segment}""")
def conform_alignments(spark, sf):
    s = load(spark, sf, "fx_segment")
    line = F.concat(F.split_part("word", F.lit(" "), F.lit(2)), F.lit("（"), F.split_part("word", F.lit(" "), F.lit(1)), F.lit("）"))
    said = F.when(F.col("quantity") < 10, " ").when(F.col("quantity") < 40, line).otherwise(F.concat(F.lit("- "), line))
    answers = s.select(F.col("id").alias("experience_id"), F.to_json(F.struct(said.alias("seq"))).alias("answer"))
    return derive.conform_alignments(answers, derive.seq_tree(base.experience(spark, sf)))


@check("first_write_cache", """
select content, fits from (select content, fits, row_number() over (partition by content order by written_order) as n from {fx_verdict}) where n = 1""")
def first_write_cache(spark, sf):
    return derive.first_write(load(spark, sf, "fx_verdict"), ["content"], F.col("written_order")).select("content", "fits")


@check("missing_inputs", "select distinct text, sha256(text) as text_sha from documents where text not in (select text from documents d join labels l on l.doc_id = d.doc_id)")
def missing_inputs(spark, sf):
    d = load(spark, sf, "documents")
    cache = d.join(load(spark, sf, "labels"), "doc_id").select(F.lit("id").alias("identity"), derive.text_sha(F.col("text")).alias("text_sha"))
    return derive.missing_inputs(d, cache, "id").select("text", "text_sha")


@check("turn_depths", "select id, root_turn_id as root, cast(seq as bigint) as depth from {fx_turn}")
def turn_depths(spark, sf):
    return depths(load(spark, sf, "fx_turn"), "id", "parent_turn_id")
