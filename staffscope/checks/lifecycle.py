"""Files in, versions out, guards and streams: what happens to a corpus before and after it is searched."""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, functions as F

from ..operators import clean, derive as derive_ops, reading, scope as scope_ops, segments as segment_ops
from ..operators.logs import audit_append, audit_rows
from ..operators.numbering import page
from ..operators.trees import TreeError, validate_tree
from ..plans import derive as derive_plan
from ..plans.query import Condition, Query
from ..plans.review import review_round
from ..plans.search import Filters
from ..session import checkpoint_dir, cut_lineage, literal_table
from ..sources.answers import AnswerCache
from ..sources.cases import CaseError, read_cases
from ..sources.contract import load_source, read_contract_dir, register_source
from ..sources.store import Corpus, publish
from ..streaming import jobs
from . import base
from .inputs import AS_OF, define, load
from .registry import check
from .search import JUDGED, SENIOR, search
from .words import GUIDE, NOW, in_use


def _folder(spark, kind: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def _refused(run, *errors) -> bool:
    try:
        run()
    except errors:
        return True
    return False


# --- reading files ---------------------------------------------------------------------------------------
def _csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


@check("read_contract_dir", """
select 'employees' as "table", emp_id, concat_ws('|', name, education_level, cast(overseas_educated as varchar)) as value from {fx_person}
union all select 'external', emp_id, concat_ws('|', id, concat(word, chr(10), 'said "yes", once'), cast(unemployed as varchar)) from {fx_segment} where kind = 'external'
union all select 'assignments', emp_id, concat(department, '|', title) from {fx_segment} where kind = 'internal'
union all select 'levels', level_band, cast(level_rank as varchar) from (select distinct level_band, level_rank from {fx_person})""")
def read_contract_dir_(spark, sf):
    """Written as CSV (quoted line breaks, an extra column, no key column, optional files absent) and read back."""
    folder, p, s = _folder(spark, "csv"), load(spark, sf, "fx_person"), load(spark, sf, "fx_segment")
    flag = lambda c: F.when(F.col(c), " 是 ").when(~F.col(c), "No").otherwise("")
    blank = lambda *names: [F.lit("").alias(name) for name in names]
    _csv(p.select("emp_id", F.col("name").alias(" name "), *blank("hire_date"), "education_level", "school", "school_tier",
                  flag("overseas_educated").alias("overseas_educated"), "recruitment", F.lit("z").alias("extra")), f"{folder}/employees.csv")
    _csv(s.filter("kind = 'internal'").select("emp_id", "start_date", "end_date", "department", "department_path", "title",
                                              *blank("level"), "seq_l1", "seq_l2", *blank("seq_l3")), f"{folder}/assignments.csv")
    said = F.concat("word", F.lit('\nsaid "yes", once'))
    _csv(s.filter("kind = 'external'").select("emp_id", "start_date", "end_date", F.col("id").alias("company"), "title", said.alias("description"),
                                              "company_tag", *blank("nature"), flag("unemployed").alias("unemployed")), f"{folder}/external.csv")
    _csv(p.select(F.col("level_band").alias("level"), F.col("level_band").alias("band"), F.col("level_rank").alias("rank")).distinct(), f"{folder}/levels.csv")
    bundle = read_contract_dir(spark, folder)
    row = lambda table, key, *parts: bundle[table].select(F.lit(table).alias("table"), F.col(key).alias("emp_id"), F.concat_ws("|", *parts).alias("value"))
    return (row("employees", "emp_id", "name", "education_level", F.col("overseas_educated").cast("string"))
            .unionByName(row("external", "emp_id", "company", "description", F.col("unemployed").cast("string")))
            .unionByName(row("assignments", "emp_id", "segment_key")).unionByName(row("levels", "level", "rank"))
            .unionByName(row("company_aliases", "raw_name", "company")))


@check("custom_source", """
select 'levels' as "table", cast(c_custkey as varchar) as key, case when c_acctbal < 0 then '' when c_acctbal > 9000 then '' else cast(cast(floor(c_acctbal) as bigint) as varchar) end as value from customer
union all select 'employees', cast(c_custkey as varchar), coalesce(case when c_nationkey > 3 then c_name end, '') from customer
union all select 'assignments', cast(o_custkey as varchar), case when o_orderkey % 2 = 0 then o_orderpriority else '' end from orders""")
def custom_source(spark, sf):
    """A callable as source: numbers, absent and infinite values become text; a blank key of its own stays blank."""
    c, o = load(spark, sf, "customer"), load(spark, sf, "orders")
    blank = lambda *names: [F.lit("").alias(name) for name in names]

    def extract(_):
        rank = F.when(F.col("c_acctbal") < 0, float("nan")).when(F.col("c_acctbal") > 9000, float("inf")).otherwise(F.floor("c_acctbal").cast("double"))
        return {
            "employees": c.select(F.col("c_custkey").alias("emp_id"), F.when(F.col("c_nationkey") > 3, F.col("c_name")).alias("name"),
                                  *blank("hire_date", "education_level", "school", "school_tier"), F.lit("1").alias("overseas_educated"), *blank("recruitment")),
            "levels": c.select(F.col("c_custkey").alias("level"), F.col("c_name").alias("band"), rank.alias("rank")),
            "assignments": o.select(F.col("o_custkey").alias("emp_id"), F.col("o_orderdate").alias("start_date"), *blank("end_date", "department",
                                    "department_path", "title", "level", "seq_l1", "seq_l2", "seq_l3"),
                                    F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("segment_key")),
            "external": c.limit(0).select(*blank("emp_id", "start_date", "end_date", "company", "title", "description", "company_tag", "nature", "unemployed"))}
    register_source("driver tables", extract)
    bundle = load_source(spark, "driver tables")
    row = lambda table, key, value: bundle[table].select(F.lit(table).alias("table"), F.col(key).alias("key"), F.col(value).alias("value"))
    return row("levels", "level", "rank").unionByName(row("employees", "emp_id", "name")).unionByName(row("assignments", "emp_id", "segment_key"))


@check("gold_cases", """
select 'search' as kind, cast(p_partkey as varchar) as name, concat(p_name, '|', p_brand) as value, true as refused_twice from part
union all select 'extract', cast(p_partkey as varchar), concat(p_name, '|', p_type), true from part
union all select 'review', cast(p_partkey as varchar), concat(p_name, '|', p_brand), true from part
union all select 'understand', cast(p_partkey as varchar), concat(p_name, '|', p_brand), true from part""")
def gold_cases(spark, sf):
    """Cases of all four kinds as JSON arrays, read back; the same file with every case twice is refused."""
    p = load(spark, sf, "part")
    name, list_of = F.col("p_partkey").cast("string").alias("name"), lambda c: F.array(F.col(c))
    cases = {
        "search": (p.select(name, F.col("p_name").alias("query"), list_of("p_brand").alias("expect")), ["query", F.col("expect")[0]]),
        "extract": (p.select(name, F.col("p_name").alias("title"), F.array(F.struct(list_of("p_type").alias("words"))).alias("gold")),
                    ["title", F.col("gold")[0]["words"][0]]),
        "review": (p.select(name, F.array(F.struct(F.col("p_name").alias("word"), F.lit(1).alias("people"))).alias("words"), F.array(list_of("p_brand")).alias("found")),
                   [F.col("words")[0]["word"], F.col("found")[0][0]]),
        "understand": (p.select(name, F.col("p_name").alias("say"), list_of("p_brand").alias("includes")), ["say", F.col("includes")[0]])}
    found = []
    for kind, (rows, shown) in cases.items():
        folder = _folder(spark, "cases")
        files = rows.withColumn("file", F.pmod(F.xxhash64("name"), F.lit(8))).groupBy("file").agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
        files.write.partitionBy("file").text(f"{folder}/once")
        files.unionByName(files.withColumn("file", F.col("file") + 8)).write.partitionBy("file").text(f"{folder}/twice")
        refused = _refused(lambda: read_cases(spark, f"{folder}/twice", kind), CaseError)
        found.append(read_cases(spark, f"{folder}/once", kind).select(
            F.lit(kind).alias("kind"), "name", F.concat_ws("|", *shown).alias("value"), F.lit(refused).alias("refused_twice")))
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


# --- versions of a corpus -----------------------------------------------------------------------------------
@check("pinned_version", """
select 'pinned' as read, 'employee' as "table", emp_id as key from {fx_person} union all select 'current', 'employee', emp_id from {fx_person} where level_rank > 0
union all select 'pinned', 'industry', name from {fx_industry} union all select 'current', 'industry', name from {fx_industry} where parent is not null
union all select 'pinned', 'company', name from {fx_company}""")
def pinned_version(spark, sf):
    """Two versions published one after the other: a reader that pinned the first keeps it, tables are replaced whole."""
    root, people, industry = _folder(spark, "corpus"), base.employee(spark, sf), load(spark, sf, "fx_industry")
    company = base.tables(spark, sf)["company"]
    publish(Corpus({"employee": people, "industry": industry, "company": company}), root)
    pinned = Corpus.at(spark, root)
    publish(pinned.replace(employee=people.filter("cur_level_rank > 0"), industry=industry.filter("parent is not null"), company=company.limit(0)), root)
    rows = [corpus[table].select(F.lit(read).alias("read"), F.lit(table).alias("table"), F.col(key).alias("key"))
            for read, corpus in (("pinned", pinned), ("current", Corpus.at(spark, root)))
            for table, key in (("employee", "emp_id"), ("industry", "name"), ("company", "name"))]
    first = rows[0]
    for more in rows[1:]:
        first = first.unionByName(more)
    return first


# --- cleaning ----------------------------------------------------------------------------------------------------
@check("unemployed_rows", """
select id, start_date, end_date, case when unemployed then '待业' else word end as title, case when unemployed then '' else concat(word, ' ', discount) end as description
from (select id, start_date, end_date, unemployed, word, case when discount >= 0.05 then 'much' else 'little' end as discount from {fx_segment} where kind = 'external' and end_date is not null)""")
def unemployed_rows(spark, sf):
    s = load(spark, sf, "fx_segment").filter("kind = 'external' and end_date is not null")
    said = F.concat_ws(" ", "word", F.when(F.col("discount") >= 0.05, "much").otherwise("little"))
    rows = s.select("emp_id", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"),
                    F.col("id").alias("company"), F.col("word").alias("title"), said.alias("description"), "company_tag", F.lit("").alias("nature"), "unemployed")
    profiles = load(spark, sf, "fx_person").select("emp_id", F.lit(None).cast("date").alias("hire_date"))
    return clean.mark_external(rows, profiles, AS_OF).select(F.col("company").alias("id"), "start_date", "end_date", "title", "description")


@check("stream_declarations", """
select event_type as stream, case when count(*) filter (value > 50) > 0 then 'rating' else 'status' end as kind, upper(event_type) as label,
  (select count(*) > count(distinct event_type) from events) as refused from events group by event_type""")
def stream_declarations(spark, sf):
    """Streams declared once each; the same declarations once per event are refused."""
    e = load(spark, sf, "events")
    shape = lambda df: df.select(F.concat("event_type", F.lit(" ")).alias("stream"), "kind", F.upper("event_type").alias("label"),
                                 F.lit("").alias("period"), F.lit("").alias("notes"))
    kind = F.when(F.count_if(F.col("value") > 50) > 0, "rating").otherwise("status").alias("kind")
    refused = _refused(lambda: clean.record_streams(shape(e.withColumn("kind", F.lit("rating")))), ValueError)
    return clean.record_streams(shape(e.groupBy("event_type").agg(kind))).select("stream", "kind", "label", F.lit(refused).alias("refused"))


define("o_both_sides", """
select emp_id, kind, unemployed, start_date, end_date, company, case when kind = 'external' then nullif(company_tag, '') end as company_tag, department, department_path, title,
  case when kind = 'internal' then seq_l1 else '' end as seq_l1, case when kind = 'external' then description else '' end as description from {fx_segment}""")


def _both_sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Raw segments of both sources, without an id, so that equal ones are repeats."""
    e = base.experience(spark, sf)
    inside = e.filter("kind = 'internal'").select("emp_id", "start_date", "end_date", "department", "department_path", "title", "level", "seq_l1",
                                                  F.lit("").alias("seq_l2"), F.lit("").alias("seq_l3"), "months")
    outside = e.filter("kind = 'external'").select("emp_id", "start_date", "end_date", "company", "company_meta", "title", "description", "unemployed", "months")
    return inside.withColumn("company_meta", F.lit(None).cast("struct<company_tag:string,nature:string>")), outside


@check("build_experience", "select distinct * from {o_both_sides}")
def build_experience(spark, sf):
    built = segment_ops.build_experience(*_both_sides(spark, sf))
    return built.select("emp_id", "kind", "unemployed", "start_date", "end_date", "company", "company_meta.company_tag", "department", "department_path",
                        "title", "seq_l1", "description")


@check("duplicate_segments", """
select count(*) as contents, coalesce(cast(sum(n - 1) as bigint), 0) as repeats from (
  select count(*) as n from (select * from {o_both_sides} union all select * from {o_both_sides} where kind = 'external' and title like 'S%')
  group by emp_id, kind, unemployed, start_date, end_date, company, company_tag, department, department_path, title, seq_l1, description) where n > 1""")
def duplicate_segments(spark, sf):
    """Earlier jobs of some titles are told twice."""
    inside, outside = _both_sides(spark, sf)
    found = segment_ops.duplicate_segments(inside, outside.unionByName(outside.filter("title like 'S%'")))
    return found.agg(F.count("*").alias("contents"), F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("repeats"))


define("o_tree_variant", """
select 'declared' as variant, name, parent from {fx_industry} union all select 'orphans', name, parent from {fx_industry} where parent is not null
union all select 'repeated', name, parent from {fx_industry} union all select 'repeated', name, parent from {fx_industry} where name < 'C'
union all select 'cycle', f.name, coalesce(f.parent, (select min(c.name) from {fx_industry} c where c.parent = f.name)) from {fx_industry} f""")


@check("validate_tree", """
select v.variant, count(*) > count(distinct v.name) or count(*) filter (v.parent is not null and v.parent not in (select name from {o_tree_variant} o where o.variant = v.variant)) > 0
  or count(*) filter (v.name = (select min(g.parent) from {o_tree_variant} g where g.variant = v.variant and g.name = v.parent)) > 0 as refused
from {o_tree_variant} v group by v.variant""")
def validate_tree_(spark, sf):
    """The same links whole, without their roots, with repeats, and closed to rings."""
    tree = load(spark, sf, "fx_industry")
    below = tree.groupBy(F.col("parent").alias("_of")).agg(F.min("name").alias("_first"))
    ring = tree.join(below, tree["name"] == below["_of"], "left").select("name", F.coalesce("parent", "_first").alias("parent"))
    variants = {"declared": tree, "orphans": tree.filter("parent is not null"), "repeated": tree.unionByName(tree.filter("name < 'C'")), "cycle": ring}
    return literal_table(spark, [(name, _refused(lambda: validate_tree(edges), TreeError)) for name, edges in variants.items()], "variant string, refused boolean")


# --- standards and staging --------------------------------------------------------------------------------------
@check("standard_id", """
select sha256(concat('read it', (select string_agg(concat(seq_l2, '（', seq_l1, '）'), chr(10) order by seq_l1, seq_l2) from
  (select distinct seq_l1, seq_l2 from {fx_segment} where kind = 'internal' and seq_l1 <> '' and seq_l2 <> '')))) as identity""")
def standard_id_(spark, sf):
    """The identity of what is asked: instructions and the lines of the sequence tree."""
    lines = [f"{r['seq_l2']}（{r['seq_l1']}）" for r in derive_ops.seq_tree(base.experience(spark, sf)).orderBy("seq_l1", "seq_l2").collect()]
    return literal_table(spark, [(derive_ops.standard_id(["read it", "\n".join(lines)]),)], "identity string")


VERSIONS = ("v1", "v2", "v3")


@check("needs_staging", """
select v.version, exists (select 1 from {fx_segment} s where s.derived_identity <> v.version and (s.kind = 'internal' or v.version <> 'v1')) as staging from (values ('v1'), ('v2'), ('v3')) v(version)""")
def needs_staging(spark, sf):
    s = load(spark, sf, "fx_segment")
    every = lambda version: s if version != "v1" else s.filter("kind = 'internal'")
    return literal_table(spark, [(v, derive_ops.needs_staging(every(v), v)) for v in VERSIONS], "version string, staging boolean")


@check("one_standard", """
select 'every' as segments, count(distinct derived_identity) > 1 as refused from {fx_segment}
union all select 'newest', count(distinct derived_identity) > 1 from {fx_segment} where derived_identity is null or derived_identity = 'v2'""")
def one_standard(spark, sf):
    s = load(spark, sf, "fx_segment")
    parts = {"every": s, "newest": s.filter("derived_identity is null or derived_identity = 'v2'")}
    return literal_table(spark, [(name, _refused(lambda: derive_ops.assert_one_standard(rows), ValueError)) for name, rows in parts.items()],
                         "segments string, refused boolean")


@check("apply_answers", """
select s.id as experience_id, case when quantity < 40 then split_part(word, ' ', 1) else '' end as seq_inferred_l1, case when quantity < 40 then split_part(word, ' ', 2) else '' end as seq_inferred_l2,
  'v3' as derived_identity, kind = 'external' and not unemployed and ((x.experience_id is null and description <> '') or quantity >= 40) as unanswered
from {fx_segment} s left join (select experience_id from {fx_extraction} where engagement is not null) x on x.experience_id = s.id""")
def apply_answers(spark, sf):
    """Answers of the reader exist where an engagement was read, places in the tree where less than 40 was moved."""
    s = load(spark, sf, "fx_segment")
    read = load(spark, sf, "fx_extraction").filter("engagement is not null").select("experience_id")
    placed = s.filter("quantity < 40").select(F.col("id").alias("experience_id"), F.split_part("word", F.lit(" "), F.lit(1)).alias("seq_l1"),
                                               F.split_part("word", F.lit(" "), F.lit(2)).alias("seq_l2"))
    return derive_ops.apply_answers(s, read, placed, "v3")


@check("vector_cache", """
select p_name as text, case when p_name < 'f' then 'c' when p_name < 'n' then 'a' when p_name like '%bolt' then null else 'a' end as source,
  case when p_name < 'f' then 1.0 when p_name >= 'n' and p_name like '%bolt' then null else cast(length(p_name) as double) end as first from (select distinct p_name from part)""")
def vector_cache(spark, sf):
    """Words before f are cached, those before n with vectors of another size; nothing comes back for some."""
    words = load(spark, sf, "part").select(F.col("p_name").alias("text"))
    vector = F.when(F.col("text") < "f", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(2.0))).cast("array<float>")
    cache = words.distinct().filter("text < 'n'").select(F.lit("model-1").alias("identity"), derive_ops.text_sha(F.col("text")).alias("text_sha"), vector.alias("embedding"))

    def embed(batches):
        for rows in batches:
            yield rows.assign(embedding=[None if text >= "n" and text.endswith("bolt") else [float(len(text)), 1.0] for text in rows["text"]])

    answers = derive_ops.cached_embeddings(words, cache, "model-1", embed, 2)[0]
    place = F.col("embedding")
    return answers.select("text", F.when(place[1] == 0, "c").when(place[1] == 1, "a").alias("source"), place[0].cast("double").alias("first"))


@check("review_round", """
select t.word, case when u.word is null then t.canonical else t.word end as canonical, case when u.word is null then t.parent end as parent, t.excluded and u.word is null as excluded
from {fx_term} t left join (select distinct word from {o_in_use}) u on u.word = t.word
union all select distinct u.word, u.word, null, false from {o_in_use} u where u.word not in (select word from {fx_term})""")
def review_round_(spark, sf):
    """A whole round in which the judge lets every word stand on its own."""
    t = base.tables(spark, sf)
    corpus = Corpus({**{name: t[name] for name in ("experience", "experience_phrase", "phrase", "term")},
                     "review_word": literal_table(spark, [], "id long, guide_identity string, word string, people long, near array<struct<word:string,people:bigint>>, "
                                                             "collected_at timestamp, judge string, judgment string")})
    words = in_use(spark, sf).select("word").distinct()
    vectors = words.select("word", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda n: (F.pmod(F.xxhash64("word", n), F.lit(97)) + 1).cast("float")).alias("embedding"))
    alone = F.to_json(F.struct(F.lit("").alias("why"), F.lit("自成一项").alias("kind"), F.lit("").alias("target")))
    judge = lambda rows: rows.select("id", F.when(F.col("word").isNotNull(), alone).alias("judgment"))
    return review_round(corpus, vectors, GUIDE, NOW, judge)["term"].select("word", "canonical", "parent", "excluded")


# --- who sees whom, why nobody is found, pages, the trail --------------------------------------------------------------
@check("all_visible", """
select r.user_id, (select count(*) from (select min(emp_id) as e from {fx_person} union select max(emp_id) from {fx_person}) w
    where w.e not in (select p.emp_id from {fx_person} p where starts_with(concat(p.cur_dept_path, '>'), concat(r.org_path, '>')))) = 0 as both_seen
from (select concat('r-', r_name) as user_id, concat('Group>', r_name) as org_path from region union all select 'all', 'Group') r""")
def all_visible(spark, sf):
    """Whether each account sees two people, those whose ids come first and last."""
    people, accounts = base.tables(spark, sf)["employee"], cut_lineage(scope_ops.normalise_scopes(load(spark, sf, "fx_scope")))
    ids = list(people.agg(F.min("emp_id"), F.max("emp_id")).first())
    users = ["all"] + [f"r-{row['r_name']}" for row in load(spark, sf, "region").collect()]  # five regions
    return literal_table(spark, [(user, scope_ops.all_visible(scope_ops.visible(people, accounts, user), ids)) for user in users], "user_id string, both_seen boolean")


@check("empty_reason", """
select 'found' as query, case when (select count(*) from {cat_person} where level_rank >= 1) > 0 then null else 'unmet' end as kind, null as nobody
union all select 'none', 'noConditions', null union all select 'off', 'allDisabled', null
union all select 'filtered', case when (select count(*) from {cat_person} where level_rank >= 1 and level_band = 'L99') = 0 then 'filtered' end, null
union all select 'unmet', case when (select count(*) from {cat_person} where level_rank >= 1 and school = 'Moon') = 0 then 'unmet' end,
  array_to_string(list_filter([case when (select count(*) from {cat_person} where level_rank >= 1) = 0 then 'senior' end, case when (select count(*) from {cat_person} where school = 'Moon') = 0 then 'moon' end], lambda x: x is not null), ',')""")
def empty_reason(spark, sf):
    from dataclasses import replace
    moon = Condition("moon", "studied on the moon", "must", "person", where="p.school = 'Moon'")
    cases = {"found": (Query((SENIOR,)), None), "none": (Query(()), None), "off": (Query((replace(SENIOR, off=True),)), None),
             "filtered": (Query((SENIOR,)), Filters(level=("L99",))), "unmet": (Query((SENIOR, moon)), None)}
    rows = []
    for name, (query, filters) in cases.items():
        reason = search(spark, sf, query, filters).empty_reason() or {}
        rows.append((name, reason.get("kind"), ",".join(reason["nobody"]) if "nobody" in reason else None))
    return literal_table(spark, rows, "query string, kind string, nobody string")


@check("last_page", """
with n as (select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as n, count(*) over () as total from orders)
select o_orderkey, total, cast(ceil(total / 70.0) as bigint) as page, cast((ceil(total / 70.0) - 1) * 70 + 1 as bigint) as "from" from n where n > (ceil(total / 70.0) - 1) * 70""")
def last_page(spark, sf):
    """A page far behind the end is the last one."""
    rows, at = page(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 10 ** 9, 70)
    return rows.select("o_orderkey", F.lit(at["total"]).cast("long").alias("total"), F.lit(at["page"]).cast("long").alias("page"),
                       F.lit(at["from"]).cast("long").alias("from"))


@check("audit_append", """
select 'export' as action, emp_id, timestamp '2024-03-01 00:00:00' as "at" from {fx_person} union all select 'view', emp_id, timestamp '2024-03-01 00:00:00' from {fx_person} where level_rank > 1""")
def audit_append_(spark, sf):
    folder, people = _folder(spark, "trail"), load(spark, sf, "fx_person")
    audit_append(audit_rows("u", "export", NOW, people), folder)
    audit_append(audit_rows("u", "view", NOW, people.filter("level_rank > 1")), folder)
    return spark.read.parquet(folder).select("action", "emp_id", "at")


# --- functions that predicates use ----------------------------------------------------------------------------------------
# (Spark SQL, the same in DuckDB or None where the text is equal)
PREDICATES = {
    "year": ("cast(date_part('year', o_orderdate) as bigint)", None), "quarter": ("cast(extract(quarter from o_orderdate) as bigint)", None),
    "weekday": ("cast(extract(dow_iso from o_orderdate) as bigint)", "cast(extract(isodow from o_orderdate) as bigint)"),
    "month_start": ("cast(date_trunc('month', o_orderdate) as date)", None), "made": ("make_date(1999, month(o_orderdate), 1)", "make_date(1999, month(o_orderdate), 1)"),
    "written": ("date_format(o_orderdate, 'yyyy/MM')", "strftime(o_orderdate, '%Y/%m')"),
    "read_back": ("to_date(date_format(o_orderdate, 'dd.MM.yyyy'), 'dd.MM.yyyy')", "cast(strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y') as date)"),
    "alike": ("o_orderpriority like '%-H%'", None), "unlike": ("o_orderpriority not like '_-L%'", None),
    "alike_ci": ("o_orderpriority ilike '%URG%'", None), "unlike_ci": ("o_orderpriority not ilike '%low'", None),
    "at_dash": ("cast(position('-' in o_orderpriority) as bigint)", None), "second": ("split_part(o_orderpriority, '-', 2)", None),
    "head": ("left(o_orderpriority, 3)", None), "tail": ("right(o_orderpriority, 3)", None), "middle": ("substring(o_orderpriority, 2, 4)", None),
    "begins": ("startswith(o_orderpriority, '1')", "starts_with(o_orderpriority, '1')"), "size": ("cast(length(o_orderpriority) as bigint)", None),
    "number": ("try_cast(left(o_orderpriority, 1) as bigint)", None), "no_number": ("try_cast(o_orderpriority as bigint)", None),
    "no_date": ("try_cast(concat('1999-02-', o_orderstatus) as date)", None), "shortened": ("trim(both '1' from left(o_orderpriority, 1))", "trim(left(o_orderpriority, 1), '1')"),
    "upper_first": ("upper(left(lower(o_orderpriority), 3))", None), "swapped": ("replace(o_orderpriority, '-', '/')", None)}


@check("predicate_functions", "select o_orderkey, " + ", ".join(f"{other or same} as {name}" for name, (same, other) in PREDICATES.items()) + " from orders")
def predicate_functions(spark, sf):
    return load(spark, sf, "orders").selectExpr("o_orderkey", *[f"{text} as {name}" for name, (text, _) in PREDICATES.items()])


@check("predicate_aggregates", """
select o_custkey, bool_and(o_totalprice > 20000) as all_large, bool_or(o_totalprice > 300000) as one_huge, string_agg(o_orderstatus, ',' order by o_totalprice desc, o_orderkey) as by_price,
  string_agg(case when o_orderstatus <> 'F' then o_orderpriority end, '|' order by o_orderdate, o_orderkey) as open_by_day, cast(count(*) filter (o_orderstatus = 'F') as bigint) as done from orders group by o_custkey""")
def predicate_aggregates(spark, sf):
    from ..functions.conditions import string_agg
    text = F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))
    found = load(spark, sf, "orders").groupBy("o_custkey").agg(
        F.bool_and(F.col("o_totalprice") > 20000).alias("all_large"), F.bool_or(F.col("o_totalprice") > 300000).alias("one_huge"),
        string_agg(F.col("o_orderstatus"), ",", -F.col("o_totalprice"), F.col("o_orderkey")).alias("by_price"),
        string_agg(text, "|", F.col("o_orderdate"), F.col("o_orderkey")).alias("open_by_day"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return found.withColumn("open_by_day", F.nullif("open_by_day", F.lit("")))


@check("reversed_overlaps", """
select o_orderkey, least(o_orderdate, shipped) = date '1996-01-01' or
  (least(o_orderdate, shipped) < date '1997-01-01' and date '1996-01-01' < greatest(o_orderdate, shipped)) as overlaps
from (select o_orderkey, cast(o_orderdate as date) as o_orderdate, cast(o_orderdate as date) + cast(o_orderkey % 200 - 100 as int) as shipped from orders)""")
def reversed_overlaps(spark, sf):
    """Periods of either direction against a year given backwards."""
    from ..functions.conditions import periods_overlap
    day = F.col("o_orderdate").cast("date")
    other = F.date_add(day, (F.col("o_orderkey") % 200 - 100).cast("int"))
    return load(spark, sf, "orders").select("o_orderkey", periods_overlap(day, other, F.to_date(F.lit("1997-01-01")), F.to_date(F.lit("1996-01-01"))).alias("overlaps"))


# --- packing -----------------------------------------------------------------------------------------------------------
_HEADS = " ".join(f"""when {at} then strlen(cast(json_object('label', '{c.label}', 'criterion', '{c.seek.criterion}', 'segments', json('[]')) as varchar))"""
                  for at, c in enumerate(JUDGED.conditions) if c.seek and c.seek.criterion)
define("q_to_pack", f"""
select cond, id, cast(floor((n - 1) / 40) as bigint) as batch, cast((n - 1) % 40 + 1 as int) as n, bytes, case cond {_HEADS} end as head from (
  select r.cond, r.id, strlen(cast(to_json(t.text) as varchar)) + 18 as bytes,
    row_number() over (partition by r.cond order by level_rank desc nulls last, round(depth, 9) desc, emp_id, r.id) as n from {{q_reading}} r join {{q_text}} t on t.id = r.id)""")


@check("pack_by_bytes", """
with recursive packed as (
  select cond, batch, n, id, 0 as part, head + bytes as used from {q_to_pack} where n = 1
  union all
  select q.cond, q.batch, q.n, q.id, p.part + case when p.used + q.bytes > 2000 then 1 else 0 end, case when p.used + q.bytes > 2000 then q.head + q.bytes else p.used + q.bytes end
  from packed p join {q_to_pack} q on q.cond = p.cond and q.batch = p.batch and q.n = p.n + 1)
select cast(cond as int) as cond, batch, n, id, part from packed""")
def pack_by_bytes(spark, sf):
    t = base.tables(spark, sf)
    texts = reading.segment_text(t["experience"], t["experience_phrase"], t["phrase"]).select("id", "text")
    order = [F.desc_nulls_last("level_rank"), F.desc("depth"), F.col("emp_id"), F.col("cond"), F.col("id")]
    batches = reading.plan_batches(search(spark, sf, JUDGED).to_read().withColumn("depth", F.round("depth", 9)), order, 40)
    heads = {at: reading.request_head(c.label, c.seek.criterion) for at, c in enumerate(JUDGED.conditions) if c.seek and c.seek.criterion}
    return reading.pack_by_bytes(batches.join(texts, "id"), 2000, heads)


# --- streams, driven to the end of the events ------------------------------------------------------------------------------
@contextmanager
def _state_store(spark):
    """State with timers needs RocksDB; the setting of the session comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _events(spark, sf) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet").withColumn("at", F.col("ts").cast("timestamp"))


def _to_the_end(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def _written(spark, rows: DataFrame) -> DataFrame:
    """What a stream appends to a table, after its end."""
    folder = _folder(spark, "stream")
    _to_the_end(jobs.append_trail(rows, f"{folder}/rows", f"{folder}/state"))
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


@check("trail_stream", "select event_id, cast(user_id as varchar) as user_id, event_type as action, ts as at from events")
def trail_stream(spark, sf):
    rows = _events(spark, sf).select("event_id", F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("action"), "at")
    return _written(spark, rows)


@check("activity_stream", """
select cast(user_id as varchar) as user_id, date_trunc('hour', ts) as hour, count(*) as events from events group by 1, 2
having date_trunc('hour', min(ts)) + interval 1 hour <= (select max(ts) from events) - interval 10 minute""")
def activity_stream(spark, sf):
    """Windows that the watermark closed."""
    rows = _events(spark, sf).select(F.col("user_id").cast("string").alias("user_id"), "at")
    return _written(spark, jobs.activity(rows)).select("user_id", "hour", "events")


def _arriving(spark, segments: DataFrame, folder: str, times: int) -> DataFrame:
    """A stream over segments that arrive `times` times, in two batches of as many files as tasks can share."""
    needed = segments.select("id", "kind", "unemployed", "title", "seq_l1", "seq_l2", "seq_l3", "description")
    files = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # rows that lie in enough parts are not dealt again
    placed = needed.coalesce(files) if needed.rdd.getNumPartitions() >= files else needed.repartition(files)
    for _ in range(times):
        placed.write.mode("append").parquet(folder)
    return spark.readStream.schema(needed.schema).option("maxFilesPerTrigger", -(-files * times // 2)).parquet(folder)


@check("derive_stream", "select experience_id, route, phrase_id, engagement from {o_edge}")
def derive_stream(spark, sf):
    """Segments arrive in files; each batch adds the edges of segments that have none."""
    folder, t = _folder(spark, "derive"), base.tables(spark, sf)
    arriving = _arriving(spark, t["experience"], f"{folder}/in", 1)
    run = jobs.derive_batch(base.extractions(spark, sf, t["segment"]), f"{folder}/edges", f"{folder}/phrases")
    _to_the_end(arriving.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/state"))
    return spark.read.parquet(f"{folder}/edges").select("experience_id", "route", "phrase_id", "engagement")


@check("derive_state_stream", "select experience_id, route, phrase_id, engagement from {o_edge}")
def derive_state_stream(spark, sf):
    """Every segment arrives twice; the stream's own state leaves out the second, nothing stored is read again."""
    folder, t = _folder(spark, "derive"), base.tables(spark, sf)
    with _state_store(spark):
        arriving = jobs.unseen(_arriving(spark, t["experience"], f"{folder}/in", 2), ["id"])
        run = jobs.derive_batch(base.extractions(spark, sf, t["segment"]), f"{folder}/edges", f"{folder}/phrases", known="state")
        _to_the_end(arriving.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/state"))
    return spark.read.parquet(f"{folder}/edges").select("experience_id", "route", "phrase_id", "engagement")


@check("lease_stream", """
select cast(user_id as varchar) as attempt, case when bool_or(event_type = 'error') then 'done' else 'expired' end as status, epoch_us(max(ts)) // 1000 as at_ms from events group by user_id
having bool_or(event_type = 'error') or max(ts) + interval 60 second <= (select max(ts) from events) - interval 10 second""")
def lease_stream(spark, sf):
    """Every event is a heartbeat of its user, an error ends the attempt."""
    beats = _events(spark, sf).select(F.col("user_id").cast("string").alias("attempt"), "at", (F.col("event_type") == "error").alias("done"))
    with _state_store(spark):
        return _written(spark, jobs.lease_monitor(beats))


@check("intake_stream", "select distinct user_id, event_type from events")
def intake_stream(spark, sf):
    folder, keys = _folder(spark, "intake"), ["user_id", "event_type"]
    first = jobs.first_writes(_events(spark, sf).select(*keys, "at"), keys)
    _to_the_end(first.writeStream.foreachBatch(jobs.intake_batch(keys, f"{folder}/rows")).option("checkpointLocation", f"{folder}/state"))
    return spark.read.parquet(f"{folder}/rows").select(*keys)


@check("first_write_stream", "select user_id, event_type, min(ts) as at from events group by user_id, event_type")
def first_write_stream(spark, sf):
    """The earliest event per user and kind; the same events a day later add nothing."""
    folder, keys = _folder(spark, "first"), ["user_id", "event_type"]
    events = spark.read.parquet(f"{sf}/events.parquet").select(*keys, F.col("ts").cast("timestamp").alias("at"))
    with _state_store(spark):
        for later in (0, 1):
            events.withColumn("at", F.col("at") + F.make_interval(days=F.lit(later))).write.mode("append").parquet(f"{folder}/in")
            arriving = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
            _to_the_end(jobs.append_trail(jobs.first_by_state(arriving, keys), f"{folder}/rows", f"{folder}/state"))
    return spark.read.schema(events.schema).parquet(f"{folder}/rows")


# --- runs that stop and go on -------------------------------------------------------------------------------------
@check("derive_resumed", """
select 'stopped' as state, 'segments of the new standard that searches read' as what, cast(null as varchar) as key, '0' as value
union all select 'stopped', 'segments left', null, cast(count(*) - 2 * cast(ceil(count(*) / 5.0) as bigint) as varchar) from {fx_segment}
union all select 'lost', 'segments left', null, cast(count(*) - 3 * cast(ceil(count(*) / 5.0) as bigint) as varchar) from {fx_segment}
union all select 'done', 'segments left', null, '0'
union all select 'done', 'staged rows', null, '0'
union all select 'done', 'segment', s.id, concat_ws('|', 'v3', case when quantity < 40 then split_part(s.word, ' ', 1) else '' end,
  cast(kind = 'external' and not unemployed and ((x.experience_id is null and description <> '') or quantity >= 40) as varchar))
  from {fx_segment} s left join {fx_extraction} x on x.experience_id = s.id
union all select 'done', route, experience_id, concat_ws('|', phrase_id, engagement) from {o_edge}
union all select 'done', 'phrase', id, text from {o_phrase}""")
def derive_resumed(spark, sf):
    """A new standard over a corpus that searches read: stopped after two slices, lost in the fourth, then run to its end."""
    s = base.tables(spark, sf)["segment"]  # made once, and lies by id
    own = s.select("id", F.col("derived_identity").alias("_own"))
    experience = cut_lineage(base.experience(spark, sf, s).join(own, "id").withColumn("derived_identity", F.col("_own")).drop("_own"))
    nothing = base.extractions(spark, sf, s).limit(0)
    old_phrase, old_edges = derive_ops.build_dictionary(derive_ops.phrases_of(experience.filter("derived_identity is not null"), nothing))
    root = _folder(spark, "derived")
    publish(Corpus({"experience": experience, "experience_phrase": old_edges, "phrase": old_phrase}), root)
    line = F.when(F.col("quantity") < 40, F.split("word", " "))
    answers = (cut_lineage(base.extractions(spark, sf, s)),
               cut_lineage(s.select(F.col("id").alias("experience_id"), line[0].alias("seq_l1"), line[1].alias("seq_l2")).filter("seq_l1 is not null")))
    rows, asked = -(-experience.count() // 5), []

    def answer(segments):
        asked.append(segments)
        if len(asked) == 4:
            raise ConnectionError("nobody answers")
        return answers
    run = lambda **limits: derive_plan.derive_stored(spark, root, "v3", answer, slice_rows=rows, **limits)
    stopped = run(slices=2)
    read = Corpus.at(spark, root)["experience"].filter("derived_identity = 'v3'").count()
    _refused(run, ConnectionError)
    experience_next = Corpus.at(spark, root)["experience_next"]
    lost = derive_ops.underived(Corpus.at(spark, root)["experience"], experience_next, "v3").count()
    done, corpus = run(), Corpus.at(spark, root)
    staged = corpus["experience_next"].count() + corpus["experience_phrase_next"].count()
    facts = [("stopped", "segments of the new standard that searches read", None, str(read)), ("stopped", "segments left", None, str(stopped.left)),
             ("lost", "segments left", None, str(lost)), ("done", "segments left", None, str(done.left)), ("done", "staged rows", None, str(staged))]
    shown = lambda df, what, key, *parts: df.select(F.lit("done").alias("state"), what.alias("what"), F.col(key).alias("key"), F.concat_ws("|", *parts).alias("value"))
    return (literal_table(spark, facts, "state string, what string, key string, value string")
            .unionByName(shown(corpus["experience"], F.lit("segment"), "id", "derived_identity", "seq_inferred_l1", F.col("unanswered").cast("string")))
            .unionByName(shown(corpus["experience_phrase"], F.col("route"), "experience_id", "phrase_id", "engagement"))
            .unionByName(shown(corpus["phrase"], F.lit("phrase"), "id", "text")))


@check("stored_answers", """
with asked(text) as (select p_name from part union select s_name from supplier union select text from documents where text is not null)
select sha256(text) as digest, concat(md5(text), case when text in (select p_name from part) and text not like 'b%' then '|first' else '|second' end) as answer,
  1 as batches, false as shuffles_the_cache, 0 as asked_again from asked""")
def stored_answers(spark, sf):
    """Names asked first, some of the answers no use; then names, suppliers and texts; then all again after compaction."""
    names = load(spark, sf, "part").select(F.col("p_name").alias("text"))
    every = (names.unionByName(load(spark, sf, "supplier").select(F.col("s_name").alias("text")))
             .unionByName(load(spark, sf, "documents").select("text")))

    def says(run):
        def answer(batches):
            for batch in batches:
                useless = run == "first"
                batch["answer"] = ["?" if useless and text.startswith("b") else f"{hashlib.md5(text.encode()).hexdigest()}|{run}" for text in batch["text"]]
                yield batch
        return answer
    cache, valid = AnswerCache(spark, _folder(spark, "answers")), F.col("answer") != "?"
    cache.ask(names, "standard", says("first"), valid)
    cache.ask(every, "standard", says("second"), valid)
    cache.compact("standard", valid)
    batches, before = len(cache.batches("standard")), cache.stored("standard").count()
    found = cut_lineage(cache.ask(every, "standard", says("third"), valid))
    plan = cache.entries("standard", valid)._jdf.queryExecution().executedPlan().toString()
    again = cache.stored("standard").count() - before
    cache.close()
    return found.select(F.sha2("text", 256).alias("digest"), "answer", F.lit(batches).alias("batches"),
                        F.lit("Exchange" in plan).alias("shuffles_the_cache"), F.lit(again).alias("asked_again"))
