"""The projected tables brought into stored shape by the library's own operators, and the same steps in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import duration_months
from ..operators.catalog import catalog
from ..operators.clean import company_meta, dedup_revisions, scale_union
from ..operators.companies import company_arrays, resolve_company
from ..operators.derive import build_dictionary, dictionary_of, phrases_of, spelled_edges
from ..operators.segments import SAME  # noqa: F401  (re-exported for the sync checks)
from ..operators.trees import closure
from ..session import LazyTables, cut_lineage, laid_by, literal_table
from .inputs import AS_OF, SEGMENT_ID, VIEWS, define, load

CRITERION = "a piece of work of some size"


def employee(spark, sf) -> DataFrame:
    p = load(spark, sf, "fx_person")
    blank = F.lit("")
    return p.select("emp_id", "name", "cur_dept", "cur_dept_path", blank.alias("cur_title"), blank.alias("cur_seq_l1"),
                    blank.alias("cur_seq_l2"), blank.alias("cur_seq_l3"), F.col("level_band").alias("cur_level"),
                    F.col("level_band").alias("cur_level_band"), F.col("level_rank").alias("cur_level_rank"),
                    F.lit(None).cast("date").alias("hire_date"), "education_level", "education_rank", "school",
                    "school_tier", "overseas_educated", "recruitment")


def experience(spark, sf, segments: DataFrame | None = None) -> DataFrame:
    s = load(spark, sf, "fx_segment") if segments is None else segments
    blank = F.lit("")
    return s.select("id", "emp_id", "kind", "unemployed", "start_date", "end_date", "company", "department",
                    "department_path", company_meta(F.col("company_tag"), blank).alias("company_meta"), "title",
                    "seq_l1", "seq_l2", blank.alias("seq_l3"), "seq_inferred_l1", "seq_inferred_l2",
                    blank.alias("level"), "description",
                    duration_months(F.col("start_date"), F.coalesce("end_date", F.lit(AS_OF))).alias("months"),
                    F.col("id").alias("content_key"), F.lit(None).cast("string").alias("derived_identity"),
                    F.lit(False).alias("unanswered"))


#: What a segment's columns are made of, before the small tables are looked up.
SEGMENT_PARTS = ("l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag, l_linestatus, l_quantity, l_tax, l_discount, "
                 "o_custkey, o_orderdate, p_name, p_brand, p_type, s_name, s_nationkey")


def segments(spark, sf) -> DataFrame:
    """`fx_segment`, dealt by id. The parts of its texts are dealt and put together where they arrive: half the bytes."""
    made, sources = VIEWS["fx_segment"].split("from {lineitem}")
    large, small = sources.split("join {nation}")
    joined = spark.sql(f"select {SEGMENT_PARTS} from {{lineitem}}{large}",
                       **{name: load(spark, sf, name) for name in ("lineitem", "orders", "part", "supplier")})
    dealt = joined.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.expr(SEGMENT_ID))
    return spark.sql(f"{made}from {{dealt}} join {{nation}}{small}", dealt=dealt, nation=load(spark, sf, "nation"), region=load(spark, sf, "region"))


def extractions(spark, sf, segments: DataFrame | None = None) -> DataFrame:
    x = load(spark, sf, "fx_extraction") if segments is None else spark.sql(VIEWS["fx_extraction"], fx_segment=segments)
    return x.select("experience_id", F.array(F.struct(F.col("word").alias("text"), "engagement")).alias("items"))


def links(spark, sf) -> DataFrame:
    return phrases_of(experience(spark, sf), extractions(spark, sf))


def terms(spark, sf) -> DataFrame:
    return load(spark, sf, "fx_term").select(
        "word", "canonical", F.lit(False).alias("alias_sent_back"), "parent", "excluded",
        F.lit(None).cast("timestamp").alias("reviewed_at"))


def companies(spark, sf) -> tuple[DataFrame, DataFrame]:
    raw = load(spark, sf, "fx_company")
    owned = raw.select(F.col("name").alias("company"), "industry", "main")
    circles = raw.filter("main").select(F.col("name").alias("company"), F.col("group_name").alias("circle"))
    return raw, company_arrays(raw, owned, circles, closure(load(spark, sf, "fx_industry")))


def streams(spark) -> DataFrame:
    return literal_table(spark, [("perf", "rating", "Performance", "half-year", ""), ("pool", "status", "Talent pool", "", "")],
                                 "stream string, kind string, label string, period string, notes string")


def scale(spark, sf) -> DataFrame:
    bands = load(spark, sf, "fx_person").select(F.col("level_band").alias("level"), F.col("level_band").alias("band"),
                                                F.col("level_rank").alias("rank")).distinct()
    perf = load(spark, sf, "fx_record").select("stream", "value", F.col("value_rank").alias("rank")).distinct()
    return scale_union(bands, perf)


def records(spark, sf) -> DataFrame:
    perf = load(spark, sf, "fx_record").select("emp_id", "stream", "period_start", "period_end", "value", "recorded_at")
    pool = load(spark, sf, "fx_status").select("emp_id", "stream", F.col("valid_from").alias("period_start"),
                                               F.col("valid_to").alias("period_end"), "value", F.col("valid_from").alias("recorded_at"))
    return dedup_revisions(perf.unionByName(pool))[0]


def verdicts(spark, sf) -> DataFrame:
    from ..operators.hits import criterion_key
    said = spark.sql(VIEWS["fx_segment_verdict"], fx_segment=tables(spark, sf)["segment"])
    return said.select(
        F.lit("turn-1").alias("root"), F.lit(criterion_key(CRITERION)).alias("criterion_key"), "content", "fits")


def dictionary(spark, sf) -> tuple[DataFrame, DataFrame]:
    return build_dictionary(links(spark, sf))


_STORED: dict[tuple[str, str], LazyTables] = {}
_VIEWS: dict[tuple[str, str], LazyTables] = {}


def tables(spark: SparkSession, sf: str) -> LazyTables:
    """The corpus behind the searches. Like any corpus it is derived once and then read by every query: each table
    is written on first use and kept for the session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        large = lambda make: lambda: cut_lineage(make(), even=True)
        small = lambda make: lambda: cut_lineage(make())
        t = LazyTables({
            "employee": large(lambda: employee(spark, sf)),
            # joined and dealt by segment once; what was read out of the segments, their columns and their verdicts are
            # projections of it, and edges and the view stay where their segments lie
            "segment": lambda: laid_by(segments(spark, sf), "id", dealt=True),
            "experience": lambda: experience(spark, sf, t["segment"]),
            "spelled": lambda: laid_by(spelled_edges(phrases_of(t["experience"], extractions(spark, sf, t["segment"]))),
                                       "experience_id", dealt=True),
            "phrase": small(lambda: dictionary_of(t["spelled"])[0]),
            "experience_phrase": lambda: dictionary_of(t["spelled"])[1],
            "term": small(lambda: terms(spark, sf)), "company": small(lambda: companies(spark, sf)[1]),
            "company_alias": small(lambda: resolve_company(t["experience"], load(spark, sf, "fx_company_alias"),
                                                           load(spark, sf, "fx_company"))),
            "industry": small(lambda: load(spark, sf, "fx_industry")), "record_stream": lambda: streams(spark),
            "scale": small(lambda: scale(spark, sf)), "employee_record": large(lambda: records(spark, sf)),
        })
        _STORED[key] = t
    return _STORED[key]


def views(spark, sf, people: DataFrame | None = None) -> LazyTables:
    if people is not None:
        return catalog(tables(spark, sf), people)
    key = (spark.sparkContext.applicationId, sf)
    if key not in _VIEWS:
        _VIEWS[key] = catalog(tables(spark, sf), store=True)
    return _VIEWS[key]


# --- the same steps in SQL ------------------------------------------------------------------------
define("o_experience", """
select *, cast(greatest(1, round((datediff('day', start_date, coalesce(end_date, date '2002-01-01')) + 1) / 30.44)) as int) as months
from {fx_segment}""")
define("o_link", """
select id as experience_id, case when kind = 'internal' then 'role' else 'title' end as route,
  case when kind = 'internal' then concat(seq_l1, ' · ', seq_l2, '｜', title) else title end as text,
  cast(null as varchar) as engagement
from {o_experience} where not unemployed
union all
select s.id, 'skill', x.word, x.engagement from {o_experience} s join {fx_extraction} x on x.experience_id = s.id where not unemployed
union all
select s.id, 'description', s.description, null from {o_experience} s left join {fx_extraction} x on x.experience_id = s.id
where not unemployed and x.experience_id is null and s.description <> ''""")
define("o_edge", "select distinct experience_id, route, text, md5(text) as phrase_id, engagement from {o_link}")
define("o_phrase", "select distinct text, phrase_id as id from {o_edge}")
define("o_above", """
select word as name, word as ancestor, 0 as depth from {fx_term} where word = canonical
union all select word, parent, 1 from {fx_term} where word = canonical and parent is not null""")
define("o_skill", """
select distinct e.experience_id as id, a.ancestor as skill
from {o_edge} e left join {fx_term} t on t.word = e.text
  join {o_above} a on a.name = coalesce(t.canonical, e.text)
where e.route = 'skill' and not coalesce(t.excluded, false)""")
define("o_skills", "select id, list(skill order by skill) as skills from {o_skill} group by id")
define("o_worked", "select * from {o_experience} where kind = 'external' and not unemployed and company <> ''")
define("o_spelling", """
select w.company, case when a.k is not null then a.only_one else n.only_one end as resolved
from (select distinct company from {o_worked}) w
left join (select lower(trim(raw_name)) as k, case when count(distinct company) = 1 then min(company) end as only_one
           from {fx_company_alias} group by 1) a on a.k = lower(trim(w.company))
left join (select lower(trim(name)) as k, case when count(distinct name) = 1 then min(name) end as only_one
           from {fx_company} group by 1) n on n.k = lower(trim(w.company))""")
define("o_up", """
select name, name as ancestor from {fx_industry} union select name, parent from {fx_industry} where parent is not null""")
define("o_company", """
select c.name, c.group_name, list_sort(list(distinct u.ancestor)) as industries,
  coalesce(list_sort(list(distinct u.ancestor) filter (c.main)), cast([] as varchar[])) as main_industries,
  case when c.main then [c.group_name] else cast([] as varchar[]) end as circles
from {fx_company} c join {o_up} u on u.name = c.industry group by c.name, c.group_name, c.main""")
define("cat_person", """
select emp_id, name, nullif(level_band, '') as level_band, level_rank, nullif(education_level, '') as education,
  education_rank, school, nullif(school_tier, '') as school_tier,
  case when overseas_educated then '是' when not overseas_educated then '否' end as overseas,
  recruitment, cur_dept, cur_dept_path from {fx_person}""")
define("cat_experience", """
select e.id, e.emp_id, e.kind, e.start_date, e.end_date, e.months, nullif(e.company, '') as company,
  nullif(e.company_tag, '') as company_tag, c.name as company_name, c.group_name as company_group,
  case when len(c.main_industries) > 0 then c.main_industries end as main_industries,
  case when len(c.industries) > 0 then c.industries end as industries,
  case when len(c.circles) > 0 then c.circles end as company_circles,
  nullif(e.department, '') as department, nullif(e.department_path, '') as department_path, nullif(e.title, '') as title,
  nullif(coalesce(nullif(e.seq_l1, ''), e.seq_inferred_l1), '') as seq_l1,
  nullif(coalesce(nullif(e.seq_l2, ''), e.seq_inferred_l2), '') as seq_l2,
  coalesce(k.skills, cast([] as varchar[])) as skills, e.id as content
from {o_experience} e left join {o_skills} k on k.id = e.id
  left join {o_spelling} s on s.company = e.company and e.kind = 'external'
  left join {o_company} c on c.name = s.resolved
where not e.unemployed""")
define("o_scale", """
select distinct 'level' as stream, level_band as value, level_rank as rank from {fx_person}
union all select * from (values ('education', '高中及以下', 1), ('education', '大专', 2), ('education', '本科', 3),
  ('education', '硕士', 4), ('education', '博士', 5)) l(stream, value, rank)
union all select distinct stream, value, value_rank from {fx_record}""")
define("o_raw_record", """
select emp_id, stream, period_start, period_end, value, recorded_at from {fx_record}
union all select emp_id, stream, valid_from, valid_to, value, valid_from from {fx_status}""")
define("o_distinct_record", "select distinct * from {o_raw_record}")
define("o_ranked_record", """
select *, count(*) over (partition by emp_id, stream, period_start) as revisions,
  rank() over (partition by emp_id, stream, period_start order by recorded_at desc) as place
from {o_distinct_record}""")
define("o_final_record", """
select *, count(*) over (partition by emp_id, stream, period_start) as tied from {o_ranked_record} where place = 1""")
define("o_record", """
select emp_id, stream, period_start, period_end, value from {o_final_record} where tied = 1""")
define("cat_rating", """
select r.emp_id, r.period_start, r.period_end, r.value, s.rank as value_rank
from {o_record} r join {o_scale} s on s.stream = r.stream and s.value = r.value where r.stream = 'perf'""")
define("cat_status", """
select emp_id, value, period_start as valid_from, period_end as valid_to from {o_record} where stream = 'pool'""")
