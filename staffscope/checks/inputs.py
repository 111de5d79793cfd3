"""The driver's tables seen as people, segments, records and words.

Every projection is one SQL text that runs unchanged in Spark (`{table}` bound to a DataFrame) and, as a
common table expression, in DuckDB. `load` builds the Spark side, `oracle` the other.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession

AS_OF = date(2002, 1, 1)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

SEGMENT_ID = ("concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), "
              "cast(l_partkey as string), cast(l_suppkey as string), cast(cast(l_shipdate as date) as string))")

VIEWS: dict[str, str] = {
    "fx_person": """
select cast(c_custkey as string) as emp_id, c_name as name,
  concat('Group>', r_name, '>', n_name) as cur_dept_path, n_name as cur_dept,
  cast(greatest(floor(c_acctbal / 2500), 0) as int) as level_rank,
  concat('L', cast(cast(greatest(floor(c_acctbal / 2500), 0) as int) as string)) as level_band,
  c_mktsegment as recruitment,
  cast(c_nationkey % 5 + 1 as int) as education_rank,
  case c_nationkey % 5 when 0 then '高中及以下' when 1 then '大专' when 2 then '本科' when 3 then '硕士' else '博士' end
    as education_level,
  concat('School ', cast(c_nationkey as string)) as school,
  case when c_nationkey < 8 then '985' when c_nationkey < 16 then '211' else '' end as school_tier,
  case when c_acctbal < 0 then null else c_acctbal > 5000 end as overseas_educated
from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    # profiles as a source gives them: without a number, off the ladder, told twice, told differently
    "fx_raw_profile": """
select case when cast(emp_id as int) % 50 = 0 then ' ' else concat(' ', emp_id) end as emp_id, name,
  case when education_rank = 1 then 'soon' when education_rank = 2 then '' else '1996-06-01' end as hire_date,
  case when level_rank = 2 then '研究员' when level_rank = 3 and education_rank = 4 then ' 学徒' else education_level end as education_level,
  school, school_tier, overseas_educated, recruitment
from {fx_person}
union all select concat(' ', emp_id), name, '', education_level, school, school_tier, overseas_educated, recruitment
from {fx_person} where cast(emp_id as int) % 7 = 0 and education_rank = 2 and level_rank < 2
union all select emp_id, concat(name, ' x'), '', education_level, school, school_tier, overseas_educated, recruitment
from {fx_person} where cast(emp_id as int) % 11 = 0 and cast(emp_id as int) % 50 <> 0""",
    "fx_raw_interval": f"""
select {SEGMENT_ID} as segment_id,
  cast(o_custkey as string) as emp_id, cast(o_orderdate as date) as start_date, cast(l_shipdate as date) as end_date,
  l_returnflag as flag, l_linestatus as status
from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey""",
    "fx_segment": f"""
select {SEGMENT_ID} as id,
  cast(o_custkey as string) as emp_id,
  case when l_returnflag = 'R' then 'internal' else 'external' end as kind,
  l_returnflag = 'A' and l_quantity < 3 as unemployed,
  cast(least(o_orderdate, l_shipdate) as date) as start_date,
  case when l_linestatus = 'O' and l_quantity > 45 then null else cast(greatest(o_orderdate, l_shipdate) as date) end
    as end_date,
  case when l_returnflag = 'R' then '' else s_name end as company,
  case when l_returnflag = 'R' then n_name else '' end as department,
  case when l_returnflag = 'R' then concat('Group>', r_name, '>', n_name) else '' end as department_path,
  case when l_returnflag = 'R' then '' else p_brand end as company_tag,
  case when l_returnflag = 'A' and l_quantity < 3 then '待业' else p_type end as title,
  case when l_returnflag = 'R' then split_part(p_name, ' ', 1) else '' end as seq_l1,
  case when l_returnflag = 'R' then split_part(p_name, ' ', 2) else '' end as seq_l2,
  case when l_returnflag <> 'R' and l_tax >= 0.04 then split_part(p_name, ' ', 1) else '' end as seq_inferred_l1,
  case when l_returnflag <> 'R' and l_tax >= 0.04 then split_part(p_name, ' ', 2) else '' end as seq_inferred_l2,
  case when l_returnflag <> 'R' and l_discount >= 0.05 then concat(p_name, ' for ', s_name) else '' end as description,
  case when l_tax >= 0.03 then 'v2' when l_tax >= 0.01 then 'v1' else null end as derived_identity,
  p_name as word, l_quantity as quantity, l_discount as discount
from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey join {{part}} on l_partkey = p_partkey
  join {{supplier}} on l_suppkey = s_suppkey join {{nation}} on s_nationkey = n_nationkey
  join {{region}} on n_regionkey = r_regionkey""",
    # what was read out of a segment: no row where nothing was read
    "fx_extraction": """
select id as experience_id, word, case when quantity >= 35 then '主导' when quantity >= 15 then '做过'
  when quantity >= 5 then '提到' else null end as engagement
from {fx_segment} where discount >= 0.03""",
    "fx_record": """
select cast(o_custkey as string) as emp_id, 'perf' as stream, o_orderpriority as value,
  6 - cast(substr(o_orderpriority, 1, 1) as int) as value_rank,
  make_date(cast(year(o_orderdate) as int), case when month(o_orderdate) <= 6 then 1 else 7 end, 1) as period_start,
  case when month(o_orderdate) <= 6 then make_date(cast(year(o_orderdate) as int), 6, 30)
       else make_date(cast(year(o_orderdate) as int), 12, 31) end as period_end,
  cast(o_orderdate as date) as recorded_at
from {orders}""",
    "fx_status": """
select cast(user_id as string) as emp_id, 'pool' as stream, event_type as value, cast(ts as date) as valid_from,
  case when value > 80 then null else cast(ts as date) + cast(floor(value / 10) as int) end as valid_to
from {events} where event_type in ('signup', 'purchase')""",
    "fx_industry": """
select r_name as name, cast(null as string) as parent from {region}
union all select n_name, r_name from {nation} join {region} on n_regionkey = r_regionkey""",
    "fx_company": """
select s_name as name, n_name as group_name, n_name as industry, s_acctbal >= 0 as main
from {supplier} join {nation} on s_nationkey = n_nationkey""",
    # suppliers in debt also name the first supplier of their nation: ambiguous unless they are that one
    "fx_company_alias": """
select concat(' ', upper(s_name), ' ') as raw_name, s_name as company from {supplier} where s_acctbal < 5000
union all select s.s_name, f.first_name from {supplier} s
  join (select s_nationkey as nation, min(s_name) as first_name from {supplier} group by s_nationkey) f
    on s.s_nationkey = f.nation where s.s_acctbal < 0""",
    # nouns are heads and "adjective noun" narrower; gizmo is an alias of widget, "hot x" of "cold x"; bolt is excluded
    "fx_term": """
select distinct split_part(p_name, ' ', 2) as word,
  case when split_part(p_name, ' ', 2) = 'gizmo' then 'widget' else split_part(p_name, ' ', 2) end as canonical,
  cast(null as string) as parent, split_part(p_name, ' ', 2) = 'bolt' as excluded
from {part}
union all
select distinct p_name, case when split_part(p_name, ' ', 1) = 'hot' then concat('cold ', split_part(p_name, ' ', 2)) else p_name end,
  case when split_part(p_name, ' ', 1) = 'hot' or split_part(p_name, ' ', 2) = 'bolt' then null
       when split_part(p_name, ' ', 2) = 'gizmo' then 'widget' else split_part(p_name, ' ', 2) end, false
from {part}""",
    # equal texts: the lowest doc_id was written first
    "fx_verdict": """
select md5(text) as content, 'criterion-1' as criterion_key, quality = 1 as fits, d.doc_id as written_order
from {documents} d join {labels} l on d.doc_id = l.doc_id""",
    # no row = not confirmed yet
    "fx_segment_verdict": """
select id as content, quantity >= 20 as fits from {fx_segment} where quantity < 30 or quantity >= 40""",
    "fx_turn": """
select concat(cast(conv_id as string), '-', cast(turn as string)) as id,
  concat(cast(conv_id as string), '-0') as root_turn_id,
  case when turn = 0 then null else concat(cast(conv_id as string), '-', cast(turn - 1 as string)) end as parent_turn_id,
  cast(conv_id % 10 as string) as owner_id, role, text as raw_text, turn as seq
from {conversations}""",
    "fx_task_run": """
select event_id as id, event_type as kind, ts as started_at, value as seconds,
  case when value > 90 then 'failed' else null end as error
from {events}""",
    "fx_audit": """
select event_id as id, ts as at, cast(user_id as string) as user_id,
  case event_type when 'view' then 'view' when 'purchase' then 'export' else 'search' end as action,
  case when event_type in ('view', 'purchase') then cast(event_id % 1500 as string) else null end as emp_id,
  case when event_type in ('view', 'purchase') then null else props end as text
from {events}""",
    # one account per region, one per nation, one that sees everybody
    "fx_scope": """
select 'all' as user_id, 'Group' as org_path
union all select concat('r-', r_name), concat('Group>', r_name) from {region}
union all select concat('m-', r_name), concat('Group>', r_name, '>', n_name)
  from {nation} join {region} on n_regionkey = r_regionkey
union all select concat('m-', r_name), concat(' Group > ', r_name, ' >> ') from {region} where r_name <= 'AMERICA'""",
}

_NAME = re.compile(r"\{(\w+)\}")


_PLANNED: dict[tuple[str, str, str], DataFrame] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or one of the projections above, as a DataFrame. Plans (not data) are kept per session, so
    that file footers are listed once."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _PLANNED:
        if name in TABLES:
            _PLANNED[key] = spark.read.parquet(f"{key[1]}/{name}.parquet")
        else:
            text = VIEWS[name]
            inputs = {need: load(spark, sf_dir, need) for need in sorted(set(_NAME.findall(text)))}
            _PLANNED[key] = spark.sql(text, **inputs)
    return _PLANNED[key]


# --- the other side -----------------------------------------------------------------------
MONTHS = "greatest(1, cast(round((datediff('day', start_date, coalesce(end_date, date '2002-01-01')) + 1) / 30.44) as int))"
CTES: dict[str, str] = {name: text for name, text in VIEWS.items()}


def define(name: str, text: str) -> None:
    """A named step shared by several oracle texts; refers to others as `{name}`."""
    CTES[name] = text


def oracle(text: str) -> str:
    """Full SQL for DuckDB: the needed steps as common table expressions, in dependency order.

    Steps are materialised: DuckDB 2.0 sometimes fails inside ("dict-surviving cache") when joins of several union
    branches flow into one another.
    """
    ordered: list[str] = []

    def visit(body: str) -> None:
        for need in _NAME.findall(body):
            if need in CTES and need not in ordered:
                visit(CTES[need])
                ordered.append(need)

    visit(text)
    plain = lambda body: _NAME.sub(lambda m: m.group(1), body)
    steps = ",\n".join(f"{name} as materialized ({plain(CTES[name]).strip()})" for name in ordered)
    body = plain(text).strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {steps},\n{body[15:]}" if ordered else body
    if body.lower().startswith("with "):  # the text brings steps of its own
        return f"with {steps},\n{body[5:]}" if ordered else body
    return (f"with {steps}\n" if ordered else "") + body
