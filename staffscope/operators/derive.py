"""From segments to phrases: routes, dictionary, versioned standard, staging, answer caches."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import blank_to_null, fits_tag, nfkc_each, tag_of_normal, text_field
from ..schema import ENGAGEMENTS, TAGS_PER_SEGMENT



# --- phrases -----------------------------------------------------------------------------------
def role_text() -> Column:
    """`l1 · l2 · l3｜title`, parts that are missing left out."""
    sequence = F.concat_ws(" · ", *[blank_to_null(F.col(c)) for c in ("seq_l1", "seq_l2", "seq_l3")])
    return F.concat_ws("｜", blank_to_null(sequence), blank_to_null(F.col("title")))


def phrases_of(segments: DataFrame, extractions: DataFrame) -> DataFrame:
    """(experience_id, route, text, engagement): what every employed segment says.

    `extractions` holds (experience_id, items array<struct<text,engagement>>); no row means "not read", which
    falls back to the whole description, while an empty list means "read, nothing found".
    """
    none = F.lit(None).cast("string")
    one = lambda route, text, engagement=none: F.struct(F.lit(route).alias("route"), text.alias("text"),
                                                        engagement.alias("engagement"))
    registered = F.when(F.col("kind") == "internal", one("role", role_text())).otherwise(one("title", F.col("title")))
    claimed = F.when(F.col("items").isNull(), F.array(one("description", F.col("description")))).otherwise(
        F.transform("items", lambda item: one("skill", item["text"], item["engagement"])))
    said = F.filter(F.concat(F.array(registered), claimed), lambda p: F.coalesce(p["text"], F.lit("")) != "")
    return (segments.filter(~F.col("unemployed"))
            # a row a segment: never small where segments are many, though its files may be
            .join(extractions.select(F.col("experience_id").alias("id"), "items").hint("merge"), "id", "left")
            .select(F.col("id").alias("experience_id"), F.explode(said).alias("p")).select("experience_id", "p.*"))


def spelled_edges(links: DataFrame) -> DataFrame:
    """(experience_id, route, phrase_id, text, engagement): one edge per segment, route and phrase, the text beside its md5.

    Links made by a join on the segment lie by segment already, so this shuffles nothing.
    """
    depth = F.array_position(F.array(*[F.lit(e) for e in ENGAGEMENTS]), F.col("engagement"))
    return (links.select("experience_id", "route", "text", F.nullif(depth, F.lit(0)).alias("_depth"))
            .groupBy("experience_id", "route", "text").agg(F.min("_depth").alias("_depth"))
            .select("experience_id", "route", F.md5("text").alias("phrase_id"), "text",
                    F.try_element_at(F.array(*[F.lit(e) for e in ENGAGEMENTS]), F.col("_depth").cast("int")).alias("engagement")))


def dictionary_of(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(phrase, experience_phrase) from `spelled_edges`."""
    return edges.select(F.col("phrase_id").alias("id"), "text").distinct(), edges.drop("text")


def build_dictionary(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(phrase, experience_phrase): distinct texts keyed by their md5, and one edge per segment, route and phrase."""
    return links.select(F.md5("text").alias("id"), "text").distinct(), dictionary_of(spelled_edges(links))[1]


def prune_phrases(phrase: DataFrame, *edge_tables: DataFrame) -> DataFrame:
    """Phrases some live or staged edge still uses."""
    used = edge_tables[0].select("phrase_id")
    for more in edge_tables[1:]:
        used = used.unionByName(more.select("phrase_id"))
    return phrase.join(used.select(F.col("phrase_id").alias("id")), "id", "left_semi")


# --- the standard and its versions ----------------------------------------------------------------
def standard_id(parts) -> str:
    """Identity of a standard: what is asked and how answers look, never who answers."""
    return hashlib.sha256("".join(p if isinstance(p, str) else json.dumps(p, ensure_ascii=False) for p in parts)
                          .encode()).hexdigest()


def seq_tree(experience: DataFrame) -> DataFrame:
    return (experience.filter((F.col("kind") == "internal") & (F.col("seq_l1") != "") & (F.col("seq_l2") != ""))
            .select("seq_l1", "seq_l2").distinct())


def outdated(version: str) -> Column:
    return ~F.col("derived_identity").eqNullSafe(F.lit(version))


def underived(experience: DataFrame, staged: DataFrame, version: str) -> DataFrame:
    """Segments without a result of this version, live or staged."""
    done = staged.filter(F.col("derived_identity") == version).select(F.col("experience_id").alias("id"))
    return experience.filter(outdated(version)).join(done, "id", "left_anti")


def needs_staging(experience: DataFrame, version: str) -> bool:
    """Whether searches still read another version, so that new results have to wait until all are there."""
    return not experience.filter(F.col("derived_identity") != version).limit(1).isEmpty()


def derive_progress(experience: DataFrame, staged: DataFrame, version: str) -> DataFrame:
    done = (staged.filter(F.col("derived_identity") == version)
            .select(F.col("experience_id").alias("id"), F.lit(True).alias("_staged")))
    ready = F.col("derived_identity").eqNullSafe(F.lit(version)) | F.coalesce("_staged", F.lit(False))
    return experience.join(done, "id", "left").agg(
        F.count("*").alias("total"), F.count_if(ready).alias("done"),
        F.coalesce(F.bool_or(F.col("derived_identity") != version), F.lit(False)).alias("staging"))


def assert_one_standard(experience: DataFrame) -> None:
    """Refuse a corpus in which segments follow different standards."""
    found = experience.select("derived_identity").filter("derived_identity is not null").distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError("segments follow more than one standard; finish deriving first")


def promote_edges(live: DataFrame, staged: DataFrame, experience: DataFrame, version: str) -> DataFrame:
    """Edges after promotion: current segments keep theirs, all others take the staged ones."""
    keys = ["experience_id", "route", "phrase_id", "engagement"]
    current = experience.filter(~outdated(version)).select(F.col("id").alias("experience_id"))
    return (live.join(current, "experience_id", "left_semi").select(keys)
            .unionByName(staged.join(current, "experience_id", "left_anti").select(keys)))


def promote_columns(experience: DataFrame, staged: DataFrame, version: str) -> DataFrame:
    columns = ["seq_inferred_l1", "seq_inferred_l2", "unanswered"]
    ready = staged.filter(F.col("derived_identity") == version).select(
        F.col("experience_id").alias("id"), *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_ready"))
    taken = F.coalesce("_ready", F.lit(False)) & outdated(version)
    joined = experience.join(ready, "id", "left")
    out = {c: F.when(taken, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    out["derived_identity"] = F.when(taken, version).otherwise(F.col("derived_identity"))
    return joined.withColumns(out).select(experience.columns)


# --- conforming answers -------------------------------------------------------------------------------
def conform_extractions(answers: DataFrame) -> DataFrame:
    """(experience_id, items) from raw JSON answers with (experience_id, company, answer).

    Words are tagged, over-long ones and ones that repeat the company name are dropped, a repeated word keeps
    its deepest engagement, and reading stops at the 30th kept word. An answer that is no JSON object gives no row.
    """
    answers, value = answers.filter(F.col("answer").rlike(r"^[ \t\n\r]*\{")), F.try_parse_json("answer")  # an object or nothing
    fields = lambda name: F.transform("_items", lambda item: F.coalesce(text_field(item, name), F.lit("")))
    # an item that is no object, or whose text is no text, is dropped alone; the texts of an answer are normalised in one call
    told = (answers.filter("experience_id is not null")
            .select("experience_id", F.coalesce("company", F.lit("")).alias("company"), F.try_variant_get(value, "$.items", "array<variant>").alias("_items"))
            .select("experience_id", "company", F.concat(fields("text"), fields("depth")).alias("_told"))
            .select("experience_id", "company", nfkc_each(F.col("_told")).alias("_told")))
    half = (F.size("_told") / 2).cast("int")
    depth = lambda at: F.nullif(F.array_position(F.array(*[F.lit(e) for e in ENGAGEMENTS]), tag_of_normal(F.get("_told", half + at))), F.lit(0))
    words = F.transform(F.slice("_told", F.lit(1), half), lambda text, at: F.struct(at.alias("pos"), tag_of_normal(text).alias("text"), depth(at).alias("depth")))
    inside = lambda text: (F.col("company") != "") & (F.contains(text, F.col("company")) | F.contains(F.col("company"), text))
    fit = F.filter(words, lambda word: fits_tag(word["text"]) & ~inside(word["text"]))
    # one answer is one model reply, so a list of its words is as small as the reply
    lists = (told.select("experience_id", fit.alias("_fit")).groupBy("experience_id")
             .agg(_walked(F.array_sort(F.flatten(F.collect_list("_fit")))).alias("_list")))
    engagement = lambda word: F.try_element_at(F.array(*[F.lit(e) for e in ENGAGEMENTS]), word["depth"].cast("int"))
    items = F.transform("_list", lambda word: F.struct(word["text"].alias("text"), engagement(word).alias("engagement")))
    empty = F.array().cast("array<struct<text:string,engagement:string>>")
    return (answers.filter(value.isNotNull()).select("experience_id").join(lists, "experience_id", "left")
            .select("experience_id", F.coalesce(items, empty).alias("items")))


def _walked(words: Column) -> Column:
    """The distinct words (text, depth) of (pos, text, depth) in order of pos, each with its deepest engagement. The walk stops once
    the 30th is in: a later mention of an earlier word is not read either."""
    firsts, kept = "array<int>", "array<struct<text:string,depth:bigint>>"

    def step(walk: Column, word: Column) -> Column:
        at, text, depth = word["pos"], word["text"], word["depth"]
        full = F.coalesce(F.get(walk["firsts"], F.lit(TAGS_PER_SEGMENT - 1)) < at, F.lit(False))
        deeper = F.transform(walk["kept"], lambda one: F.struct(
            one["text"].alias("text"), F.when(one["text"] == text, F.least(one["depth"], depth)).otherwise(one["depth"]).alias("depth")))
        added = F.array_append(walk["kept"], F.struct(text.alias("text"), depth.alias("depth"))).cast(kept)
        place = F.when(F.array_contains(walk["firsts"], at), walk["firsts"]).otherwise(F.array_append(walk["firsts"], at)).cast(firsts)
        both = lambda places, some: F.struct(places.alias("firsts"), some.alias("kept")).cast(f"struct<firsts:{firsts},kept:{kept}>")
        return (F.when(full, walk).when(F.exists(walk["kept"], lambda one: one["text"] == text), both(walk["firsts"], deeper.cast(kept)))
                .otherwise(both(place, added)))
    start = F.struct(F.array().cast(firsts).alias("firsts"), F.array().cast(kept).alias("kept"))
    return F.aggregate(words, start, step, lambda walk: walk["kept"])


def conform_alignments(answers: DataFrame, tree: DataFrame) -> DataFrame:
    """(experience_id, seq_l1, seq_l2): a line of the tree, or blank; any other answer counts as unanswered (NULL)."""
    lines = tree.select(F.concat("seq_l2", F.lit("（"), "seq_l1", F.lit("）")).alias("_line"), "seq_l1", "seq_l2")
    said = answers.withColumn("_line", F.trim(F.get_json_object("answer", "$.seq")))
    blank = F.col("_line") == ""
    return said.join(lines, "_line", "left").select(
        "experience_id", F.when(blank, "").otherwise(F.col("seq_l1")).alias("seq_l1"),
        F.when(blank, "").otherwise(F.col("seq_l2")).alias("seq_l2"))


def apply_answers(segments: DataFrame, extractions: DataFrame, alignments: DataFrame, version: str) -> DataFrame:
    """Staged columns per segment: inferred sequence and whether a needed answer is missing."""
    asked = ~F.col("unemployed") & (F.col("kind") == "external")
    read = extractions.select(F.col("experience_id").alias("id"), F.lit(True).alias("_read"))
    aligned = alignments.select(F.col("experience_id").alias("id"), F.col("seq_l1").alias("_l1"), F.col("seq_l2").alias("_l2"))
    missing = asked & ((F.col("_read").isNull() & (F.col("description") != "")) | F.col("_l1").isNull())
    return segments.join(read, "id", "left").join(aligned, "id", "left").select(
        F.col("id").alias("experience_id"), F.coalesce("_l1", F.lit("")).alias("seq_inferred_l1"),
        F.coalesce("_l2", F.lit("")).alias("seq_inferred_l2"), F.lit(version).alias("derived_identity"),
        missing.alias("unanswered"))


# --- get-or-compute caches ----------------------------------------------------------------------------
def text_sha(col: Column) -> Column:
    return F.sha2(col, 256)


def first_write(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The earliest row per key. `row_number() = 1` is pruned before the shuffle, so hot keys stay small."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_n", rank).filter("_n = 1").drop("_n")


def missing_inputs(df: DataFrame, cache: DataFrame, identity: str, text: str = "text") -> DataFrame:
    """Distinct texts the cache has no answer for."""
    known = cache.filter(F.col("identity") == identity).select("text_sha")
    return (df.select(F.col(text).alias("text")).distinct().withColumn("text_sha", text_sha(F.col("text")))
            .join(known, "text_sha", "left_anti"))


def cached_answers(df: DataFrame, cache: DataFrame, identity: str, answer, payload: str = "payload string",
                   valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers per text, cache rows to append). `answer` is a mapInPandas function adding the payload column."""
    name = payload.split()[0]
    good = cache.filter(F.col("identity") == identity)
    if valid is not None:
        good = good.filter(F.coalesce(valid, F.lit(False)))
    new = (missing_inputs(df, good, identity).mapInPandas(answer, f"text string, text_sha string, {payload}")
           .filter(F.col(name).isNotNull()).withColumn("identity", F.lit(identity)))
    both = good.select("text_sha", name).unionByName(new.select("text_sha", name))
    asked = df.select("text").distinct().withColumn("text_sha", text_sha(F.col("text")))
    return asked.join(both, "text_sha", "left").drop("text_sha"), new.select("identity", "text_sha", name)


def cached_embeddings(df, cache, identity: str, embed, dim: int):
    """As `cached_answers`, for vectors of one dimension; cached vectors of another size are asked again."""
    return cached_answers(df, cache, identity, embed, "embedding array<float>", F.size("embedding") == dim)
