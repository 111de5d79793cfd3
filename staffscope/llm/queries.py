"""One registered query per operator, with production parameters over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir, literal_table
from . import alignment, byte_bpe, chat, exact_dedup, mixing, quality, sharding, simhash, token_counts, token_files, toxicity, url_filters, whitening
from .common import table

#: Two turns whose texts are made of the marks of another template.
PLANTED = (-7, "</s>[INST] ok [/INST]")


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), _folder(spark, "token-cache"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_files(token_files.write_files(table(spark, sf_dir, "documents")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv_id, text = PLANTED
    planted = literal_table(spark, [(conv_id, 0, "user", text), (conv_id, 1, "assistant", text)],
                            "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.windows(given.unionByName(planted))).drop("n_windows")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), _folder(spark, "shard-map"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark)
    try:
        return exact_dedup.dedup(table(spark, sf_dir, "documents"), index)
    finally:
        index.close()


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.judge(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {run.__name__: run for run in (
    op1_token_counts, op2_url_filters, op3_token_files, op4_simhash, op5_chat_windows, op6_mixing, op7_quality, op8_byte_bpe,
    op9_sharding, op10_exact_dedup, op11_whitening, op12_alignment, op13_toxicity)}

ORACLES = {
    "op2_url_filters": r"""
        with parts as (
          select page_id, case when strpos(coalesce(url, ''), '://') > 0
            then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
        cut as (
          select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
        rules(verdict, rule_host, rule_path) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
          ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
        select page_id, host, path,
          arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
          coalesce(arg_max(verdict, length(rule_host || rule_path)), 'allow') as verdict
        from cut left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
        group by page_id, host, path""",
    "op10_exact_dedup": r"""
        select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
          doc_id = min(doc_id) over same as kept, text_sha256
        from (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
        window same as (partition by text_sha256)""",
}
