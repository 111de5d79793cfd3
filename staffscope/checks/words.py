"""The vocabulary, the judging queue, and scope over the projected corpus."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import scope as scope_ops, terms as term_ops
from ..operators.neighbours import nearest
from ..operators.numbering import numbered
from ..session import with_scalars
from . import base
from .inputs import define, load
from .registry import check

NOW = datetime(2024, 3, 1)
GUIDE = "guide-2"

define("o_written", """
select distinct e.text as word, coalesce(t.canonical, e.text) as head, s.emp_id
from {o_edge} e join {o_experience} s on s.id = e.experience_id left join {fx_term} t on t.word = e.text
where e.route in ('title', 'skill') and not s.unemployed""")
define("o_rolled", """
select distinct coalesce(a.ancestor, w.head) as word, w.emp_id from {o_written} w left join {o_above} a on a.name = w.head""")
define("o_in_use", """
select u.word, u.people, coalesce(o.writers, 0) as writers, false as alias
from (select word, count(*) as people from {o_rolled} group by word) u
  left join (select word, count(*) as writers from {o_written} where word = head group by word) o on o.word = u.word
union all select word, count(*), count(*), true from {o_written} where word <> head group by word""")


def in_use(spark, sf):
    t = base.tables(spark, sf)
    return term_ops.term_in_use(t["experience_phrase"], t["phrase"], t["experience"], t["term"])


@check("term_in_use", "select word, people, writers, alias from {o_in_use}")
def term_in_use(spark, sf):
    return in_use(spark, sf)


@check("vocabulary", "select word, people from {o_in_use} where not alias")
def vocabulary(spark, sf):
    return term_ops.vocabulary(in_use(spark, sf))[0]


# the same table with three kinds of damage, derived from its rows
define("o_bad_term", """
select word, case when parent = 'ring' then 'gizmo' else canonical end as canonical,
  case when parent = 'ring' then null when parent = 'plate' then 'gizmo' when parent = 'rod' then 'bolt' else parent end as parent, excluded from {fx_term}""")


@check("term_validate", """
select 'alias of an alias' as problem, t.word from {o_bad_term} t join {o_bad_term} c on c.word = t.canonical where t.word <> t.canonical and c.canonical <> t.canonical
union select 'belongs to an alias', t.word from {o_bad_term} t join {o_bad_term} c on c.word = t.parent where c.canonical <> t.parent
union select 'linked to an excluded word', t.word from {o_bad_term} t join {o_bad_term} c on c.word = t.parent or (c.word = t.canonical and t.word <> t.canonical) where c.excluded""")
def term_validate(spark, sf):
    t = base.terms(spark, sf)
    ring = F.coalesce(F.col("parent") == "ring", F.lit(False))
    bad = t.withColumn("canonical", F.when(ring, "gizmo").otherwise(F.col("canonical"))).withColumn(
        "parent", F.when(ring, None).when(F.col("parent") == "plate", "gizmo").when(F.col("parent") == "rod", "bolt").otherwise(F.col("parent")))
    return term_ops.term_problems(bad)


@check("nearest_terms", """
select word, near, cast(place as int) as place, round(round(score, 9), 6) as score from (
  select *, row_number() over (partition by word order by round(score, 9) desc, near_id) as place from (
    select d.vec_id as word_id, cast(d.vec_id as varchar) as word, cast(p.vec_id as varchar) as near, p.vec_id as near_id,
      list_dot_product(cast(d.embedding as double[]), cast(p.embedding as double[])) / (sqrt(list_dot_product(cast(d.embedding as double[]), cast(d.embedding as double[])))
        * sqrt(list_dot_product(cast(p.embedding as double[]), cast(p.embedding as double[])))) as score
    from embeddings d join embeddings p on p.vec_id <> d.vec_id)) where place <= 8""")
def nearest_terms(spark, sf):
    v = load(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("word"), "embedding",
                                            F.lpad(F.col("vec_id").cast("string"), 20, "0").alias("pos"))
    return nearest(v, v.drop("pos")).withColumn("score", F.round(F.round("score", 9), 6))


def _reviewed(spark, sf):
    """Terms of which the narrower words were judged before."""
    return base.terms(spark, sf).withColumn("reviewed_at", F.when(F.col("parent").isNotNull(), F.lit(NOW)).cast("timestamp"))


def _queue(spark, sf):
    """One queue row per word; those that start with a c under today's guide, the others under an older one."""
    words = base.terms(spark, sf)
    near = F.array(F.struct(F.split_part("word", F.lit(" "), F.lit(2)).alias("word"), F.lit(1).cast("bigint").alias("people")))
    old = ~F.col("word").startswith("c")
    return words.select(F.xxhash64("word").alias("id"), F.when(old, "guide-1").otherwise(GUIDE).alias("guide_identity"), "word",
                        F.lit(1).cast("bigint").alias("people"), near.alias("near"), F.lit(NOW).cast("timestamp").alias("collected_at"),
                        F.when(F.col("word").endswith("r"), "model").alias("judge"), F.when(F.col("word").endswith("r"), "{}").alias("judgment"))


@check("due_words", """
select word, people from {o_in_use} where word not in (select word from {fx_term} where parent is not null)
  and word not in (select word from {fx_term} where word like 'c%')""")
def due_words(spark, sf):
    return term_ops.due_words(in_use(spark, sf), _reviewed(spark, sf), _queue(spark, sf), GUIDE)


define("o_word_vector", """
select w.word, v.embedding, sqrt(list_dot_product(cast(v.embedding as double[]), cast(v.embedding as double[]))) as norm
from (select word, (row_number() over (order by word) - 1) % (select count(*) from embeddings) as place from (select distinct word from {o_in_use})) w
  join (select embedding, row_number() over (order by vec_id) - 1 as place from embeddings) v on v.place = w.place""")
define("o_due", """
select word, people from {o_in_use} where word not in (select word from {fx_term} where parent is not null)
  and word not in (select word from {fx_term} where word like 'c%')""")


@check("collect_words", """
select d.word, d.people, coalesce(string_agg(n.near, ',' order by n.place), '') as near from {o_due} d left join (
  select *, row_number() over (partition by word order by score desc, near) as place from (
    select w.word, p.word as near, round(list_dot_product(cast(w.embedding as double[]), cast(p.embedding as double[])) / (w.norm * p.norm), 9) as score
    from {o_word_vector} w join {o_due} d on d.word = w.word join {o_word_vector} p on p.word <> w.word join {o_in_use} u on u.word = p.word and not u.alias
    where p.word not in (select word from {fx_term} where excluded))) n on n.word = d.word and n.place <= 8
group by d.word, d.people""")
def collect_words(spark, sf):
    """The given embeddings stand in for vectors of words, in word order."""
    used = in_use(spark, sf)
    vectors = numbered(load(spark, sf, "embeddings").select("vec_id", "embedding"), [F.col("vec_id")], name="place")
    size = load(spark, sf, "embeddings").agg(F.count("*").alias("size"))
    placed = with_scalars(numbered(used.select("word").distinct(), [F.col("word")], name="at"), size)
    words = placed.withColumn("place", (F.col("at") - 1) % F.col("size") + 1).join(vectors, "place").select("word", "embedding")
    found = term_ops.collect_words(used, _reviewed(spark, sf), _queue(spark, sf), words, GUIDE, NOW)
    return found.select("word", "people", F.array_join(F.transform("near", lambda n: n["word"]), ",").alias("near"))


# --- judgments -------------------------------------------------------------------------------------
def _raw_judgments(spark, sf):
    """One answer per word of the table, by its adjective; some are no judgments."""
    t = base.terms(spark, sf).filter("word like '% %'")
    adj, noun = F.split_part("word", F.lit(" "), F.lit(1)), F.split_part("word", F.lit(" "), F.lit(2))
    kind = (F.when(adj == "red", "属于").when(adj == "blue", "同一件事").when(adj == "small", "自成一项").when(adj == "new", "不是能力")
            .when(adj == "old", "同一件事").when(adj == "large", "属于").otherwise("?"))
    target = (F.when(adj == "red", F.concat(noun, F.lit(" work"))).when(adj == "blue", F.concat(F.lit("large "), noun))
              .when(adj == "large", F.concat(F.lit("far too long a name for "), noun)).when(adj == "old", F.concat(F.lit("unlisted "), noun)).otherwise(""))
    near = F.array(F.struct(F.concat(F.lit("large "), noun).alias("word"), F.lit(3).cast("bigint").alias("people")))
    told = F.to_json(F.struct(F.lit("").alias("why"), kind.alias("kind"), target.alias("target")))
    # answers that are no JSON, no object, and whose fields are no texts
    malformed = F.when(adj == "cold", '[{"kind":"自成一项"}]').when(adj == "hot", '{"why":"').when(adj == "large", '{"why":"","kind":["自成一项"],"target":3}')
    return t.select("word", F.col("word").alias("id"), near.alias("near"), F.coalesce(malformed, told).alias("judgment"))


@check("conform_judgments", """
select word, case split_part(word, ' ', 1) when 'red' then 'under' when 'blue' then 'same' when 'small' then 'alone' when 'new' then 'excluded' end as verdict,
  case split_part(word, ' ', 1) when 'red' then concat(split_part(word, ' ', 2), ' work') when 'blue' then concat('large ', split_part(word, ' ', 2)) end as target
from {fx_term} where word like '% %'""")
def conform_judgments(spark, sf):
    return term_ops.conform_judgments(_raw_judgments(spark, sf)).select("word", "verdict", "target")


# red x: belongs to "x work"; blue x: same as "large x"; small x: on its own; new x: no skill
@check("apply_judgments", """
with judged as (select word, split_part(word, ' ', 1) as adj, split_part(word, ' ', 2) as noun from {fx_term} where word like '% %')
select t.word, case when j.adj = 'blue' then concat('large ', j.noun) else t.canonical end as canonical,
  case when j.adj = 'red' then concat(j.noun, ' work') when j.adj in ('blue', 'small', 'new') then null else t.parent end as parent,
  coalesce(j.adj = 'new', false) or t.excluded as excluded, coalesce(j.adj in ('red', 'blue', 'small', 'new'), false) as reviewed
from {fx_term} t left join judged j on j.word = t.word
union all select distinct concat(noun, ' work'), concat(noun, ' work'), null, false, false from judged where adj = 'red'""")
def apply_judgments(spark, sf):
    judged = term_ops.conform_judgments(_raw_judgments(spark, sf))
    out = term_ops.apply_judgments(base.terms(spark, sf), judged, NOW)
    return out.select("word", "canonical", "parent", "excluded", F.col("reviewed_at").isNotNull().alias("reviewed"))


@check("rename_items", """
with best as (select canonical, word from (select t.canonical, t.word, row_number() over (partition by t.canonical
    order by coalesce(u.writers, 0) desc, t.word = t.canonical desc, t.word) as n
  from {fx_term} t left join (select word, max(writers) as writers from {o_in_use} group by word) u on u.word = t.word) where n = 1),
moved as (select b.canonical as old, b.word as fresh, h.parent as up from best b left join {fx_term} h on h.word = b.canonical where b.word <> b.canonical)
select t.word, coalesce(m.fresh, t.canonical) as canonical,
  case when m.fresh is null then coalesce(p.fresh, t.parent) when t.word = m.fresh then coalesce(mu.fresh, m.up) end as parent
from {fx_term} t left join moved m on m.old = t.canonical left join moved p on p.old = t.parent left join moved mu on mu.old = m.up""")
def rename_items(spark, sf):
    writers = in_use(spark, sf).groupBy("word").agg(F.max("writers").alias("writers"))
    return term_ops.rename_items(base.terms(spark, sf), writers).select("word", "canonical", "parent")


@check("send_back_branch", """
select word, canonical <> word and (canonical = 'widget' or canonical in (select word from {fx_term} where parent = 'widget')) as sent_back,
  not (canonical = 'widget' or canonical in (select word from {fx_term} where parent = 'widget')) and parent is not null as reviewed from {fx_term}""")
def send_back_branch(spark, sf):
    terms, _ = term_ops.send_back(_reviewed(spark, sf), _queue(spark, sf), "term", "gizmo", branch=True)
    return terms.select("word", F.col("alias_sent_back").alias("sent_back"), F.col("reviewed_at").isNotNull().alias("reviewed"))


@check("send_back_scopes", """
select 'all' as scope, word, canonical <> word as sent_back, false as reviewed, 0 as queued from {fx_term}
union all select 'excluded', word, false, not excluded and parent is not null, (select count(*) from {fx_term} q where not q.excluded) from {fx_term}
union all select 'term', word, canonical <> word and canonical = 'widget', canonical <> 'widget' and parent is not null,
  (select count(*) from {fx_term} q where q.canonical <> 'widget') from {fx_term}""")
def send_back_scopes(spark, sf):
    """Everything, what is no skill, and one item without its branch."""
    found = []
    for scope, word in (("all", None), ("excluded", None), ("term", "gizmo")):
        terms, queue = term_ops.send_back(_reviewed(spark, sf), _queue(spark, sf), scope, word)
        found.append(terms.select(F.lit(scope).alias("scope"), "word", F.col("alias_sent_back").alias("sent_back"), F.col("reviewed_at").isNotNull().alias("reviewed"),
                                  F.lit(queue.count()).alias("queued")))
    return found[0].unionByName(found[1]).unionByName(found[2])


@check("queue_open", "select word from {fx_term} where word like 'c%' and word not like '%r' order by word")
def queue_open(spark, sf):
    return term_ops.queue_open(_queue(spark, sf), GUIDE).select("word")


@check("judge_tally", "select 'model' as judge, count(*) as words from {fx_term} where word like '%r'")
def judge_tally(spark, sf):
    return term_ops.judge_tally(_queue(spark, sf))


@check("submit_first_wins", """
select e.user_id, e.event_id, case when w.w is null then 'missing' when e.n > 1 then 'taken' else 'accepted' end as outcome
from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as n from events) e
left join (select distinct user_id as w from events where value > 150) w on w.w = e.user_id""")
def submit_first_wins(spark, sf):
    e = load(spark, sf, "events")
    queue = e.filter("value > 150").select("user_id").distinct().select(
        F.col("user_id").alias("id"), F.lit(GUIDE).alias("guide_identity"), F.lit(None).cast("string").alias("judge"), F.lit(None).cast("string").alias("judgment"))
    said = e.select(F.col("user_id").alias("id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("judge"), F.lit("{}").alias("judgment"),
                    F.col("ts").alias("submitted_at"))
    return term_ops.submit(queue, said, GUIDE)[1].select(F.col("id").alias("user_id"), F.col("judge").cast("bigint").alias("event_id"), "outcome")


define("o_heads", """
select u.word, u.people, t.parent from {o_in_use} u left join {fx_term} t on t.word = u.word
where not u.alias and (t.word is null or t.word = t.canonical) and not coalesce(t.excluded, false)""")
define("o_spellings", "select t.canonical as head, t.word from {fx_term} t where t.word <> t.canonical and t.word in (select word from {o_in_use})")
define("o_queued", "select distinct coalesce(t.canonical, q.word) as head from (select word from {fx_term}) q left join {fx_term} t on t.word = q.word")


@check("list_terms", """
with shown as (select * from {o_heads} h where contains(lower(h.word), 'g') or contains(lower(h.parent), 'g')
    or h.word in (select head from {o_spellings} where contains(lower(word), 'g')) order by people desc, word limit 20)
select s.word as canonical, s.parent, coalesce((select string_agg(word, ',' order by word) from {o_spellings} x where x.head = s.word), '') as aliases,
  (select count(*) from {fx_term} t join {o_in_use} u on u.word = t.word and not u.alias where t.parent = s.word) as children, s.people,
  s.word in (select head from {o_queued}) as pending from shown s""")
def list_terms(spark, sf):
    rows = term_ops.list_terms(in_use(spark, sf), base.terms(spark, sf), _queue(spark, sf), "G", size=20)
    return rows.withColumn("aliases", F.array_join("aliases", ","))


@check("describe_term", """
select 'self' as relation, word, people, false as excluded, word in (select head from {o_queued}) as pending from {o_in_use} where word = 'cold widget' and not alias
union all select 'parent', word, people, null, null from {o_in_use} where word = 'widget' and not alias
union all select 'alias', word, people, null, null from {o_in_use} where word = 'hot widget' and alias
union all select 'child', u.word, u.people, null, null from {fx_term} t join {o_in_use} u on u.word = t.word and not u.alias where t.parent = 'cold widget'""")
def describe_term(spark, sf):
    return term_ops.describe_term(in_use(spark, sf), base.terms(spark, sf), _queue(spark, sf), "hot widget")


# --- scope -------------------------------------------------------------------------------------------
define("o_scope_path", """
select distinct user_id, array_to_string(list_filter(list_transform(string_split(org_path, '>'), lambda x: trim(x)), lambda x: x <> ''), '>') as org_path from {fx_scope}""")
define("o_scope", """
select * from {o_scope_path} a where not exists (select 1 from {o_scope_path} b where b.user_id = a.user_id and b.org_path <> a.org_path
  and starts_with(concat(a.org_path, '>'), concat(b.org_path, '>')))""")


@check("scope_normalise", "select user_id, org_path from {o_scope}")
def scope_normalise(spark, sf):
    return scope_ops.normalise_scopes(load(spark, sf, "fx_scope"))


@check("scope_members", """
select distinct s.user_id, p.emp_id from {fx_person} p join {o_scope} s on starts_with(concat(p.cur_dept_path, '>'), concat(s.org_path, '>'))""")
def scope_members(spark, sf):
    return scope_ops.scope_members(base.employee(spark, sf), scope_ops.normalise_scopes(load(spark, sf, "fx_scope")))


@check("scoped_segments", """
select count(*) as segments, count(distinct emp_id) as people from {cat_experience} where emp_id in (
  select p.emp_id from {fx_person} p join {o_scope} s on starts_with(concat(p.cur_dept_path, '>'), concat(s.org_path, '>')) where s.user_id = 'r-ASIA')""")
def scoped_segments(spark, sf):
    people = scope_ops.visible(base.employee(spark, sf), scope_ops.normalise_scopes(load(spark, sf, "fx_scope")), "r-ASIA")
    return base.views(spark, sf, people)["experience"].agg(F.count("*").alias("segments"), F.count_distinct("emp_id").alias("people"))


@check("owner_of_chain", """
select t.id, t.owner_id, count(p.emp_id) as people from {fx_turn} t left join {o_scope} s on s.user_id = case t.owner_id when '3' then 'r-ASIA' when '4' then 'all' else t.owner_id end
left join {fx_person} p on starts_with(concat(p.cur_dept_path, '>'), concat(s.org_path, '>')) where t.id in ('3-1', '4-0', '5-1') group by t.id, t.owner_id""")
def owner_of_chain(spark, sf):
    """A chain is read in the scope of the account that owns it; an account without organisations sees nobody."""
    turns, scopes = load(spark, sf, "fx_turn"), scope_ops.normalise_scopes(load(spark, sf, "fx_scope"))
    account = {"3": "r-ASIA", "4": "all"}
    rows = []
    for turn in ("3-1", "4-0", "5-1", "no such turn"):
        owner = scope_ops.owner_of_chain(turns, turn)
        if owner is not None:
            people = scope_ops.visible(base.employee(spark, sf), scopes, account.get(owner, owner))
            rows.append(people.agg(F.count("*").alias("people")).select(F.lit(turn).alias("id"), F.lit(owner).alias("owner_id"), "people"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@check("org_tree", """
select path, list_last(string_split(path, '>')) as name, cast(len(string_split(path, '>')) - 1 as int) as depth, cast(count(*) as bigint) as people from (
  select 'Group' as path from {fx_person} union all select concat('Group>', string_split(cur_dept_path, '>')[2]) from {fx_person} union all select cur_dept_path from {fx_person}) group by path""")
def org_tree(spark, sf):
    return scope_ops.org_tree(base.employee(spark, sf))


@check("account_scopes", """
select s.user_id, s.orgs, coalesce(m.people, 0) as people from (select user_id, string_agg(org_path, ',' order by org_path) as orgs from {o_scope} group by user_id) s
left join (select s.user_id, count(distinct p.emp_id) as people from {fx_person} p join {o_scope} s on starts_with(concat(p.cur_dept_path, '>'), concat(s.org_path, '>')) group by 1) m
  on m.user_id = s.user_id""")
def account_scopes(spark, sf):
    return scope_ops.account_scopes(base.employee(spark, sf), scope_ops.normalise_scopes(load(spark, sf, "fx_scope")))


@check("account_page", """
with accounts as (select distinct user_id, concat(upper(user_id), '@x') as username, concat('Name of ', reverse(user_id)) as name from {o_scope}),
found as (select *, count(*) over () as total, row_number() over (order by username, user_id) as n from accounts
  where contains(lower(username), 'r-a') or contains(lower(name), 'r-a')),
seen as (select s.user_id, count(distinct p.emp_id) as people from {fx_person} p join {o_scope} s on starts_with(concat(p.cur_dept_path, '>'), concat(s.org_path, '>')) group by 1),
orgs as (select user_id, string_agg(org_path, ',' order by org_path) as orgs from {o_scope} group by user_id)
select f.user_id, f.username, f.name, o.orgs, coalesce(s.people, 0) as people, f.total, 2 as page from found f join orgs o on o.user_id = f.user_id
left join seen s on s.user_id = f.user_id where f.n between 3 and 4""")
def account_page(spark, sf):
    """Second page of two of the accounts whose user name or name contains a text."""
    scopes = scope_ops.normalise_scopes(load(spark, sf, "fx_scope"))
    accounts = scopes.select("user_id").distinct().select("user_id", F.concat(F.upper("user_id"), F.lit("@x")).alias("username"),
                                                          F.concat(F.lit("Name of "), F.reverse("user_id")).alias("name"))
    rows, place = scope_ops.account_page(base.employee(spark, sf), scopes, accounts, " R-A ", 2, 2)
    return rows.withColumn("total", F.lit(place["total"]).cast("long")).withColumn("page", F.lit(place["page"]))
