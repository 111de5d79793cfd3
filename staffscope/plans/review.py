"""One round of arranging the vocabulary."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..operators import terms as ops
from ..session import cut_lineage
from ..sources.store import Corpus


def _apply(terms: DataFrame, queue: DataFrame, guide: str, now: datetime) -> tuple[DataFrame, DataFrame]:
    judged = cut_lineage(ops.conform_judgments(ops.queue_judged(queue, guide)))
    ops.validate_terms(terms)
    placed = cut_lineage(ops.apply_judgments(terms, judged, now))
    return placed, queue.join(judged.select("id"), "id", "left_anti")


def review_round(corpus: Corpus, vectors: DataFrame, guide: str, now: datetime, judge=None,
                 rejudge: dict | None = None) -> Corpus:
    """Discard stale rows, apply what was judged, send back, collect, judge, apply, rename.

    `vectors` has (word, embedding). `judge` maps the open queue rows (id, word, near) to (id, judgment); without
    one the collected words wait for outside judges.
    """
    queue = ops.discard_stale(corpus["review_word"], guide)
    terms, queue = _apply(corpus["term"], queue, guide, now)
    if rejudge:
        terms, queue = ops.send_back(terms, queue, **rejudge)
        terms, queue = cut_lineage(terms), cut_lineage(queue)
    use = lambda: ops.term_in_use(corpus["experience_phrase"], corpus["phrase"], corpus["experience"], terms)
    new = ops.collect_words(use(), terms, queue, vectors, guide, now)
    new = new.withColumn("id", F.pmod(F.xxhash64("guide_identity", "word", F.col("collected_at").cast("string")), F.lit(2 ** 62)))
    columns = ["id", "guide_identity", "word", "people", "near", "collected_at", "judge", "judgment"]
    none = F.lit(None).cast("string")
    queue = cut_lineage(queue.select(columns).unionByName(
        new.withColumn("judge", none).withColumn("judgment", none).select(columns)))
    if judge is not None:
        said = judge(ops.queue_open(queue, guide).select("id", "word", "near"))
        answers = said.select("id", F.lit("model").alias("judge"), "judgment", F.lit(now).cast("timestamp").alias("submitted_at"))
        queue = cut_lineage(ops.submit(queue, answers, guide)[0])
        terms, queue = _apply(terms, queue, guide, now)
    writers = use().groupBy("word").agg(F.max("writers").alias("writers"))
    return corpus.replace(term=cut_lineage(ops.rename_items(terms, writers)), review_word=queue)
